"""N-gram Jaccard join by chosen paths.

Each distinct set of word shingles is embedded as ``T`` min-wise sampled shingles. A run starts
with all sets in one node; a node samples some of the ``T`` coordinates, and the sets that share
the shingle at a sampled coordinate go on together to a child node. Nodes that are small, or at
the last depth, are compared by brute force; runs repeat until a pair at the threshold meets with
the target probability. A pair may meet in many nodes and is counted in the first of them alone.
Pairs are first filtered by their sketches and then verified on the whole sets; only members and
their numbers of links leave a task, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from .common import arrow_step, code_tokens, columns_of, discard, distinct, give_back, hash_tokens, let_go, mixed, store, table, words_of
from .registry import query

T, DEPTH, SMALL, BLOCK = 64, 3, 128, 1024
_M = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mixed(np.arange(1, T + 1, dtype=np.uint64) * _M) | np.uint64(1)
_LAST = 2**63 - 1


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The set of hashes of ``size`` consecutive words of each text; a shorter text is one shingle."""
    tokens, at, sizes = code_tokens([words_of(t) for t in texts])
    codes, stop, found = hash_tokens(tokens), np.cumsum(sizes), []
    for a, b in zip((stop - sizes).tolist(), stop.tolist(), strict=True):
        own = codes[at[a:b]]
        width = min(size, len(own))
        key = np.full(max(0, len(own) - width + 1) if width else 0, width, np.uint64)
        for k in range(width):
            key = key * _M + own[k:k + len(key)]
        found.append(distinct(mixed(key)))
    return found


def set_key(shingle_set: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    a, b = mixed(shingle_set), mixed(shingle_set ^ _M)
    return a.sum(dtype=np.uint64).tobytes() + (b.sum(dtype=np.uint64) + np.uint64(len(a))).tobytes()


def signature(shingle_set: np.ndarray) -> np.ndarray:
    least = np.full(T, 2**32 - 1, np.uint32)
    for a in range(0, len(shingle_set), 4096):
        part = shingle_set[a:a + 4096, None]
        np.minimum(least, ((part * _SEEDS + (_SEEDS >> np.uint64(3))) >> np.uint64(32)).astype(np.uint32).min(axis=0), out=least)
    return least


def _agreeing(threshold: float) -> list[float]:
    """The chance of each number of equal coordinates of a pair at the threshold."""
    return [math.comb(T, k) * threshold**k * (1 - threshold)**(T - k) for k in range(T + 1)]


def sure_for(recall: float, threshold: float) -> int:
    """Equal coordinates below which a sketch is refused: at most a quarter of what may be lost."""
    lost = 0.0
    for sure, p in enumerate(_agreeing(threshold)):
        lost += p
        if lost > (1 - recall) / 4:
            return sure
    return T


def recall_of(runs: int, threshold: float, sure: int, depth: int = DEPTH) -> float:
    """The chance that a pair at the threshold passes the sketch test and meets at depth ``depth`` in one of the runs, which share their coordinates."""
    rate = 1 / (threshold * T)
    sampled = [math.comb(T, k) * rate**k * (1 - rate)**(T - k) for k in range(T + 1)]
    sampled[1], sampled[0] = sampled[1] + sampled[0], 0  # a node samples one coordinate at least
    found = 0.0
    for same, chance in enumerate(_agreeing(threshold)):
        meets = 1.0
        for _ in range(depth):
            meets = 1 - sum(p * (1 - same / T * meets)**k for k, p in enumerate(sampled))
        found += chance * (1 - (1 - meets)**runs) * (same >= sure)
    return found


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """The least number of runs with which a pair at the threshold is found with probability ``recall``."""
    runs, sure = 1, sure_for(recall, threshold)
    if sum(_agreeing(threshold)[max(sure, 1):]) <= recall:
        raise ValueError(f"{T} coordinates cannot find pairs at {threshold} with probability {recall}")
    while recall_of(runs, threshold, sure, depth) < recall:
        runs += 1
    return runs


def _children(nodes: np.ndarray, signs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and child node for each coordinate that a row's node samples."""
    draw = mixed(nodes[:, None] ^ _SEEDS)
    taken = draw < np.uint64(int(2**64 / (threshold * T)))
    none = ~taken.any(axis=1)
    taken[none, draw[none].argmin(axis=1)] = True
    row, k = np.nonzero(taken)
    return row, mixed(mixed(nodes[row] + _SEEDS[k]) + signs[row, k])


def _paths(rows: DataFrame, threshold: float, runs: int | None = None) -> DataFrame:
    """``node, key``: the children of the rows' nodes, or of the roots of all runs."""
    def run(batches):
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, T)
            for r in range(runs or 1):
                nodes = np.full(len(signs), r + 1, np.uint64) * _M if runs else np.asarray(batch.column("node")).view(np.uint64)
                row, child = _children(nodes, signs, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("key").take(pa.array(row))], ["node", "key"])
    return rows.mapInArrow(run, "node long, key binary")


def _leaves(sets: DataFrame, threshold: float, runs: int) -> DataFrame:
    """``leaf, size, key`` of the nodes that are compared by brute force."""
    level, leaves = _paths(sets.select("key", "sig"), threshold, runs), None
    for depth in range(1, DEPTH + 1):
        level, path = store(level, f"paths-{depth}")
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        met = cut(level.join(sizes, "node"))
        discard(sets.sparkSession, path)
        done = met if depth == DEPTH else met.filter(F.col("size") <= SMALL)
        done = done.select(F.col("node").alias("leaf"), "size", "key")
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth < DEPTH:
            level = _paths(met.filter(F.col("size") > SMALL).select("node", "key").join(sets.select("key", "sig"), "key"), threshold)
    return leaves


_CELL = "cell long, leaf long, cross boolean, block int, key binary, n int, sketch binary, leaves array<long>"


def _cells(leaves: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of leaves with what a comparison needs; a large leaf is dealt to pairs of blocks."""
    of = leaves.groupBy("key").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    members = leaves.join(of, "key").join(sets.select("key", "n", "sketch"), "key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key", "leaf"), blocks).cast("int")
    placed = members.withColumns({"block": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return placed.select(F.xxhash64("leaf", low, high).alias("cell"), "leaf", (low != high).alias("cross"), "block", "key", "n", "sketch", "leaves")


def _pairs(held: dict[str, np.ndarray], threshold: float, sure: int):
    """Index pairs of the rows of whole cells that this leaf owns and whose sketches agree, in parts."""
    cell = held["cell"]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
    ends = [*starts[1:], len(cell)]
    todo, size = [], 0
    for a, b in zip(starts, ends, strict=True):
        if b - a <= 512:
            i, j = np.triu_indices(b - a, 1)
            todo.append((i + a, j + a))
            size += len(i)
            if size > 100_000:
                yield from _tested(held, todo, threshold, sure)
                todo, size = [], 0
        else:
            for i in range(a, b - 1):
                todo.append((np.full(b - i - 1, i), np.arange(i + 1, b)))
                size += b - i - 1
                if size > 100_000:
                    yield from _tested(held, todo, threshold, sure)
                    todo, size = [], 0
    yield from _tested(held, todo, threshold, sure)


def _tested(held: dict[str, np.ndarray], todo: list, threshold: float, sure: int):
    if not todo:
        return
    i, j = (np.concatenate(c) for c in zip(*todo, strict=True))
    n = held["n"]
    good = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & (~held["cross"][i] | (held["block"][i] != held["block"][j])) & (held["leaf"][i] == held["leaf"][j])
    i, j = i[good], j[good]
    good = (held["sketch"][i] == held["sketch"][j]).sum(axis=1) >= sure
    i, j = i[good], j[good]
    leaves = held["leaves"]
    for a in range(0, len(i), 2000):
        x, y = i[a:a + 2000], j[a:a + 2000]
        both = (leaves[x][:, :, None] == leaves[y][:, None, :]).any(axis=2)
        owned = np.where(both, leaves[x], _LAST).min(axis=1) == held["leaf"][x]
        yield x[owned], y[owned]


def _whole_cells(batches):
    """Rows of whole cells as arrays, several small cells at a time; rows come sorted by cell."""
    left = None
    let_go("near")
    for batch in batches:
        part = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        part = part if left is None else pa.concat_tables([left, part])
        cell = np.asarray(part.column("cell"))
        at = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if (cell != cell[-1]).any() else 0
        left = part.slice(at)
        if at:
            yield _arrays(part.slice(0, at))
    if left is not None and left.num_rows:
        yield _arrays(left)
    give_back()


def _arrays(part: pa.Table) -> dict:
    held = {k: np.asarray(part.column(k)) for k in ("cell", "leaf", "block", "n")}
    held["cross"] = np.asarray(part.column("cross").combine_chunks().cast(pa.uint8())).astype(bool)
    held["sketch"] = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, T)
    lists = part.column("leaves").to_pylist()
    held["leaves"] = np.full((len(lists), max(map(len, lists))), -_LAST, np.int64)
    for row, values in enumerate(lists):
        held["leaves"][row, :len(values)] = values
        held["leaves"][row, len(values):] = -1 - row  # differs from row to row
    held["table"] = part
    return held


def jaccard_join(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links between documents whose sets of ``size``-word shingles have at least the Jaccard similarity ``threshold``.

    Returns ``doc_id, class_id, copy_of, n_links, n_shingles``, one row per input row: ``copy_of`` is
    the smallest id with the same shingle set, ``n_links`` the number of other sets it is similar
    to, ``class_id`` the smallest id of all documents that links and copies connect. Each link is
    found with probability ``recall``; a link that is reported is exact. Rules for odd input: texts
    with fewer words than ``size`` are one shingle; texts without words (null too) are copies of
    each other and have no links; null ids are larger than all others; repeated rows are copies; an
    empty table gives no rows.
    """
    docs = columns_of(docs, id_col, text_col)
    sketches, _ = store(arrow_step(docs, lambda step: _sketch(step, size), "doc_id long, key binary, n int, sig binary"), "sketches")
    sets = sketches.groupBy("key").agg(F.coalesce(F.min("doc_id"), F.lit(_LAST)).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets, _ = store(sets, "sets")
    joined = sets.filter("n > 0").withColumn("sketch", _low_bytes(F.col("sig")))
    leaves = _leaves(joined, threshold, runs_for(recall, threshold))
    # Sketches of T bytes.
    sure = sure_for(recall, threshold)
    cells = _cells(leaves, joined)

    def likely(batches):
        for held in _whole_cells(batches):
            some = np.zeros(len(held["cell"]), bool)
            for i, j in _pairs(held, threshold, sure):
                some[i] = some[j] = True
            yield from held["table"].filter(pa.array(some)).to_batches()

    likely_rows, likely_path = store(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(likely, _CELL), "likely")
    wanted = likely_rows.select("key").distinct().join(sets.select("key", "rep"), "key")
    texts = docs.join(wanted, F.coalesce("doc_id", F.lit(_LAST)) == F.col("rep")).select("key", "text")
    whole = arrow_step(texts, lambda step: _whole(step, size), "key binary, hashes binary")

    def verify(batches):
        for held in _whole_cells(batches):
            keys = held["table"].column("key").to_pylist()
            hashes = held["table"].column("hashes").to_pylist()
            found = [np.frombuffer(h, np.uint64) for h in hashes]
            links, root = np.zeros(len(keys), np.int64), list(range(len(keys)))

            def top(i):
                while root[i] != i:  # noqa: B023
                    root[i] = root[root[i]]  # noqa: B023
                    i = root[i]  # noqa: B023
                return i

            for some, others in _pairs(held, threshold, sure):
                for i, j in zip(some.tolist(), others.tolist(), strict=True):
                    both = len(np.intersect1d(found[i], found[j], assume_unique=True))
                    if both >= threshold * (len(found[i]) + len(found[j]) - both) - 1e-9:
                        links[i] += 1
                        links[j] += 1
                        a, b = top(i), top(j)
                        root[max(a, b)] = min(a, b)
            linked = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in linked], pa.binary()), pa.array(links[linked]),
                                              pa.array([keys[top(i)] for i in linked], pa.binary())], ["key", "links", "root"])

    exact = likely_rows.join(whole, "key").dropDuplicates(["cell", "key"])
    stars, _ = store(exact.repartition("cell").sortWithinPartitions("cell").mapInArrow(verify, "key binary, links long, root binary"), "stars")
    discard(docs.sparkSession, likely_path)
    links = stars.groupBy("key").agg(F.sum("links").alias("n_links"))
    part = components(stars.select("key", "root"))
    grouped = links.join(part, "key", "left").join(sets.select("key", "rep"), "key")
    names = grouped.groupBy("root").agg(F.min("rep").alias("class_rep"))
    told = grouped.join(names, "root").select("key", "n_links", "class_rep")
    found = sketches.select("doc_id", "key", "n").join(sets.select("key", "rep"), "key").join(told, "key", "left")
    real = lambda c: F.nullif(c, F.lit(_LAST))
    return found.select("doc_id", real(F.coalesce("class_rep", "rep")).alias("class_id"), real(F.col("rep")).alias("copy_of"),
                        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_shingles"))


def _sketch(step: pa.RecordBatch, size: int) -> pa.RecordBatch:
    let_go("near")
    found = shingles(step.column("text").to_pylist(), size)
    return pa.RecordBatch.from_arrays(
        [step.column("doc_id"), pa.array([set_key(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int32()),
         pa.array([signature(s).tobytes() for s in found], pa.binary())], ["doc_id", "key", "n", "sig"])


def _whole(step: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """The whole sets of the texts that have the key they are wanted for."""
    found = shingles(step.column("text").to_pylist(), size)
    rows = [(k, s.tobytes()) for k, s in zip(step.column("key").to_pylist(), found, strict=True) if set_key(s) == k]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["key", "hashes"])


def _low_bytes(sig):
    """The lowest byte of each coordinate, which are four bytes each."""
    return F.unhex(F.regexp_replace(F.hex(sig), "(..)......", "$1"))


def components(edges: DataFrame, node: str = "key", other: str = "root") -> DataFrame:
    """``key, root``: the smallest node of each node's connected component, by alternating large and small stars.

    Every round keeps at most as many edges as before; minima combine before they shuffle, so a
    node with very many neighbours is one row per task.
    """
    edges = cut(edges.select(F.col(node).alias("a"), F.col(other).alias("b")).filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        small = cut(small)
        # Stars that both steps leave alone are the components.
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    roots = edges.select(F.col("a").alias("key"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())


@query("op7_jaccard_join")
def op7_jaccard_join(spark, folder):
    return jaccard_join(table(spark, folder, "documents"))
