"""Best-fit packing by minimum bin slack.

Pieces of one length are alike, so bins are planned over the histogram of lengths, which has at
most ``capacity`` entries at any input size. For each bin a subset-sum over the lengths that are
left, kept as the bits of one integer, finds the fullest combination that holds the longest
piece; the combination is used for as many bins as its counts allow and then removed. Pieces get
their place by their rank among the pieces of their length, counted in two steps so that no task
ranks all pieces of a common length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, steps, store, table
from .registry import query
from .tokens import coder, vocabulary

_PIECES = "part int, at long, rank long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, added: bool = False) -> DataFrame:
    """Documents as token pieces of at most ``capacity``; ``ids`` are little-endian unsigned 32-bit integers.

    A longer document is cut into full pieces, its first piece takes the rest. ``part, at`` name the
    task and the piece's place in it, ``rank`` counts the earlier pieces of that length in the task.
    """
    end, names = np.array([end_id], "<u4").tobytes(), [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches):
        part, at, seen = TaskContext.get().partitionId(), 0, [0] * (capacity + 1)
        for step in steps(batches):
            ids, texts = step.columns
            row, piece, start, length, rank, data = [], [], [], [], [], []
            for k, coded in enumerate(coder(path).code(texts.to_pylist(), added)):
                coded += end
                n = len(coded) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]
                for j, (a, b) in enumerate(zip(cuts, [*cuts[1:], n], strict=True)):
                    row.append(k)
                    piece.append(j)
                    start.append(a)
                    length.append(b - a)
                    rank.append(seen[b - a])
                    seen[b - a] += 1
                    data.append(coded[4 * a:4 * b])
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(row), pa.int32()), longs(range(at, at + len(row))), longs(rank), ids.take(longs(row)), pa.array(piece, pa.int32()),
                 longs(start), longs(length), longs(list(map(zlib.crc32, data))), pa.array(data, pa.binary())], names)
            at += len(row)

    return docs.mapInArrow(run, _PIECES)


def _fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Lengths and how often each: the fullest bin that holds the longest length left."""
    longest = int(np.flatnonzero(counts)[-1])
    room = capacity - longest
    full, reached, trail = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[:room + 1])[::-1].tolist():
        left, times = int(counts[length]) - (length == longest), 1
        left = min(left, room // length)
        while left > 0:  # 1, 2, 4, ... copies reach every number of copies
            times = min(times, left)
            before, reached = reached, (reached | reached << times * length) & full
            if reached != before:
                trail.append((length, times, before))
            left, times = left - times, times * 2
        if reached >> room & 1:
            break
    total, used = reached.bit_length() - 1, {longest: 1}
    for length, times, before in reversed(trail):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + times
            total -= times * length
    return sorted(used.items(), reverse=True)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``length, first rank, last rank + 1, first bin, times in each bin, offset``; counts[l] pieces have length l."""
    counts, taken, plan, bins = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), [], 0
    while counts.any():
        used = _fullest(counts, capacity)
        repeat = min(int(counts[length]) // times for length, times in used)
        offset = 0
        for length, times in used:
            n = repeat * times
            plan.append((length, int(taken[length]), int(taken[length]) + n, bins, times, offset))
            taken[length] += n
            counts[length] -= n
            offset += times * length
        bins += repeat
    return plan


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         added: bool = False) -> tuple[DataFrame, DataFrame]:
    """The place of every piece, and the table of the pieces with their ids.

    Places: ``part, at, doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Rules for odd
    input: null or empty text is the end id alone; a row with a null or repeated id is a document of
    its own; an empty table gives no rows. With ``added``, names of special tokens in a text are these tokens.
    """
    made, _ = store(pieces(columns_of(docs, id_col, text_col), path, capacity, end_id, added), "pieces", compression="zstd")
    sizes, _ = store(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    plan = np.array(plan_bins(counts, capacity), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    # Plan rows are ordered by (length, first rank): one search over both. A rank has room for 2 ** 50 pieces.
    order = (plan[:, 0] << 50) + plan[:, 1]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    names = ["part", "at", "doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (names.index("length"), len(names)))
            _, first, _, bins, times, offset = plan[np.searchsorted(order, (length << 50) + rank, side="right") - 1].T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(bins + (rank - first) // times), pa.array(offset + (rank - first) % times * length)],
                [*names, "sequence_id", "offset"])

    ranked = made.join(before, ["part", "length"]).select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, _PIECES.replace(", rank long", "").replace("ids binary", "sequence_id long, offset long")), made


def sequences(places: DataFrame, made: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of whole sequences, as arrays."""
    rows = places.select("part", "at", "sequence_id", "offset").join(made.select("part", "at", "ids"), ["part", "at"])
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32) for row in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return parts.mapInArrow(lambda batches: map(joined, batches), "sequence_id long, ids array<int>")


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, folder):
    return pack(table(spark, folder, "documents"), vocabulary(), added=True)[0].drop("part", "at")
