"""Token files by static range asymmetric numeral systems.

All blocks share one table of symbol frequencies. A block holds the ids of some whole documents,
dealt to interleaved lanes that each keep a coder state; the lanes of a block are coded together
as vectors. A block is decoded without any other; inside it, checkpoints hold the lanes' states
and the place in the stream at every ``every`` steps, so that pieces of a long block can be
decoded side by side. Each block ends with a checksum.

Block, little-endian: magic ``RANS``; u8 version, u8 scale bits, u16 lanes; u32 documents,
u64 ids, u32 steps between checkpoints, u32 checkpoints, u64 words; i64 first id number; then the
documents' ids (i64; a bitmap byte each tells null), lengths (u64), checkpoints (u64 place, u64
state of each lane), words (u32); u32 crc32 of all before. Blocks are the ``data`` column of a
Parquet table, because Spark has no writer of raw binary files; rows are ordered by ``first``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, discard, new_path, steps, store, table
from .registry import query
from .tokens import coder, vocabulary

_HEAD = "<4sBBHIQIIQq"
_LOW = np.uint64(1 << 31)
LANES, EVERY = 1024, 128


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to sum ``2 ** bits``; every symbol that occurs keeps at least 1."""
    seen = int((counts > 0).sum())
    if not seen:
        return counts.astype(np.uint64)
    if seen > 1 << bits:
        raise ValueError(f"{seen} symbols need more than {bits} scale bits")
    share = np.where(counts > 0, np.maximum(1, counts * ((1 << bits) / counts.sum())), 0).astype(np.int64)
    while (over := int(share.sum()) - (1 << bits)):  # the largest give or take in proportion
        if over < 0:
            share[np.argmax(share)] -= over
        else:
            spare = np.maximum(share - 1, 0)
            share -= np.minimum(spare, -(-spare * over // spare.sum()))
    return share.astype(np.uint64)


def encode_ids(ids: np.ndarray, freq: np.ndarray, bits: int, lanes: int, every: int) -> tuple[bytes, bytes, int, int]:
    """Checkpoints and words of one block, and how many of each; id i goes to lane i modulo ``lanes``."""
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    n_steps = -(-len(ids) // lanes)
    state, words, marks, written = np.full(lanes, _LOW, np.uint64), [], [], 0
    limit, k = np.uint64(63 - bits), np.uint64(bits)
    for step in range(n_steps - 1, -1, -1):
        now = ids[step * lanes:(step + 1) * lanes]
        f, x = freq[now], state[:len(now)]
        big = x >= f << limit
        out = x[big].astype(np.uint32)
        x[big] >>= np.uint64(32)
        q = x // f
        x[:] = (q << k) + (x - q * f) + start[now]
        words.append(out)
        written += len(out)
        if step % every == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    head = b"".join(struct.pack("<Q", written - back) + s.tobytes() for back, s in marks[::-1])
    return head, stream.tobytes(), len(marks), written


def decode_ids(n: int, lanes: int, every: int, marks: list[tuple[int, np.ndarray]], stream: np.ndarray, freq: np.ndarray, bits: int,
               symbol_at: np.ndarray, piece: int | None = None) -> np.ndarray:
    """All ids of a block, or those between one checkpoint and the next."""
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    n_steps, k, mask = -(-n // lanes), np.uint64(bits), np.uint64((1 << bits) - 1)
    found = []
    first = 0 if piece is None else piece * every
    last = n_steps if piece is None else min(n_steps, first + every)
    at, state = (marks[piece or 0][0], marks[piece or 0][1].copy()) if marks else (0, None)
    for step in range(first, last):
        x = state[:min(lanes, n - step * lanes)]
        slot = x & mask
        now = symbol_at[slot]
        x[:] = freq[now] * (x >> k) + slot - start[now]
        low = np.flatnonzero(x < _LOW)
        x[low] = x[low] << np.uint64(32) | stream[at:at + len(low)].astype(np.uint64)
        at += len(low)
        found.append(now)
    return np.concatenate(found) if found else np.zeros(0, symbol_at.dtype)


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, first: int, freq: np.ndarray, bits: int, lanes: int = LANES,
                every: int = EVERY) -> bytes:
    lanes = min(lanes, max(1, len(ids)))
    head, words, n_marks, n_words = encode_ids(ids, freq, bits, lanes, every)
    body = (struct.pack(_HEAD, b"RANS", 1, bits, lanes, len(doc_ids), len(ids), every, n_marks, n_words, first)
            + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + bytes(i is None for i in doc_ids) + lengths.astype("<u8").tobytes() + head + words)
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes, freq: np.ndarray, symbol_at: np.ndarray, piece: int | None = None):
    """The documents' ids, lengths, the number of the first id, and the ids."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block does not fit its checksum")
    magic, version, bits, lanes, docs, n, every, n_marks, n_words, first = struct.unpack_from(_HEAD, data)
    if magic != b"RANS" or version != 1:
        raise ValueError("not a block of this format")
    at = struct.calcsize(_HEAD)
    numbers, at = np.frombuffer(data, "<i8", docs, at).tolist(), at + 8 * docs
    missing, at = data[at:at + docs], at + docs
    lengths, at = np.frombuffer(data, "<u8", docs, at).astype(np.int64), at + 8 * docs
    marks = []
    for _ in range(n_marks):
        marks.append((struct.unpack_from("<Q", data, at)[0], np.frombuffer(data, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    ids = decode_ids(n, lanes, every, marks, np.frombuffer(data, "<u4", n_words, at), freq, bits, symbol_at, piece)
    return [None if m else i for i, m in zip(numbers, missing, strict=True)], lengths, first, ids


def symbols(freq: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def _coded(docs: DataFrame, path: str, end_id: int, block: int, added: bool) -> DataFrame:
    """Documents in the order of their ids as blocks of raw ids; ``part, at`` give the blocks' order, ``before`` the part's earlier ids."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "part int, at int, before long, n long, doc_ids array<long>, lengths array<long>, ids binary"

    def run(batches):
        part, at, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, data, size = [], [], [], 0

        def made():
            nonlocal at, before, doc_ids, lengths, data, size
            row = {"part": [part], "at": [at], "before": [before], "n": [size // 4], "doc_ids": [doc_ids], "lengths": [lengths],
                   "ids": [np.frombuffer(b"".join(data), "<u4").astype("<u2").tobytes()]}
            at, before, doc_ids, lengths, data, size = at + 1, before + size // 4, [], [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for step in steps(batches):
            ids, texts = step.columns
            for doc_id, coded in zip(ids.to_pylist(), coder(path).code(texts.to_pylist(), added), strict=True):
                if size and size + len(coded) > 4 * block:
                    yield made()
                doc_ids.append(doc_id)
                data.append(coded + end)
                lengths.append(len(data[-1]) // 4)
                size += len(data[-1])
        if size:
            yield made()

    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.select("doc_id", "text").mapInArrow(run, schema)


def _binned(batches):
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for ids in batch.column(0):
            counts += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=1 << 16)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], ["id", "n"])


def write_tokens(docs: DataFrame, to: str, path: str, end_id: int = 2, bits: int = 20, block: int = 1 << 18, id_col: str = "doc_id",
                 text_col: str = "text", added: bool = False) -> None:
    """Write the ids of all documents, each followed by ``end_id``, under ``to``: ``blocks`` and ``frequencies``.

    Documents come in ascending order of their ids. Rules for odd input: null text is empty text; a
    null id comes first; rows that repeat an id follow each other in the order of a hash of their
    text; a document longer than a block is a block of its own; an empty table gives no blocks. With
    ``added``, names of special tokens in a text are these tokens.
    """
    raw, raw_path = store(_coded(columns_of(docs, id_col, text_col), path, end_id, block, added), "token-blocks", compression="zstd")
    tables, counts = to + "/frequencies", np.zeros(1 << 16, np.int64)
    for i, n in raw.select("ids").mapInArrow(_binned, "id int, n long").groupBy("id").agg(F.sum("n")).collect():  # at most one row per symbol
        counts[i] = n
    freq = frequencies(counts, bits)
    docs.sparkSession.createDataFrame([(bits, freq.astype(np.int64).tolist())], "bits int, freq array<long>").coalesce(1).write.parquet(tables)
    sums = raw.groupBy("part").agg(F.sum("n").alias("n"))  # one row per partition
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def encode(batches):
        for batch in batches:
            first, data = [], []
            for row in batch.to_pylist():
                first.append(row["first"])
                data.append(write_block(row["doc_ids"], np.array(row["lengths"], np.int64), np.frombuffer(row["ids"], "<u2"), row["first"], freq, bits))
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(data, pa.binary())], ["first", "data"])

    placed = raw.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("first"), "doc_ids", "lengths", "ids")
    placed.mapInArrow(encode, "first long, data binary").write.option("compression", "uncompressed").parquet(to + "/blocks")
    discard(docs.sparkSession, raw_path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, decoded from the files; ``ids`` are little-endian unsigned 32-bit integers."""
    row = spark.read.parquet(path + "/frequencies").first()
    freq = np.array(row["freq"], np.uint64)

    def decode(batches):
        symbol_at = symbols(freq)
        for batch in batches:
            for data in batch.column(0):
                doc_ids, lengths, first, ids = read_block(data.as_py(), freq, symbol_at)
                starts, raw = first + np.cumsum(lengths) - lengths, ids.astype("<u4").tobytes()
                ends = (4 * np.cumsum(lengths)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([raw[b - 4 * n:b] for b, n in zip(ends, lengths.tolist(), strict=True)], pa.binary())],
                    ["doc_id", "start", "ids"])

    return spark.read.schema("first long, data binary").parquet(path + "/blocks").select("data").mapInArrow(decode, "doc_id long, start long, ids binary")


@query("op3_token_file")
def op3_token_file(spark, folder):
    path = new_path(spark, "tokens")
    write_tokens(table(spark, folder, "documents"), path, vocabulary(), added=True)
    return read_tokens(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
