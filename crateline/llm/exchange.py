"""Packed exchanges between chunks of documents and buckets of keys.

A chunk is some whole documents, coded as arrays. It asks about its distinct keys, one packed
message for each bucket of the key space; a bucket merges the messages of all chunks and sends
each chunk its answers, in the order of the chunk's keys. Since a chunk names a key once, a key
that a third of all rows share costs a bucket one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

MESSAGE = "bucket int, chunk long, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte planes apart."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.size else b""
        parts += [a.dtype.str.encode().ljust(4), a.size.to_bytes(8, "little"), planes]
    return zstandard.compress(b"".join(parts), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, found = memoryview(zstandard.decompress(data)), 1, []
    for _ in range(raw[0]):
        kind, size = np.dtype(bytes(raw[at:at + 4]).strip().decode()), int.from_bytes(raw[at + 4:at + 12], "little")
        at += 12
        end = at + size * kind.itemsize
        found.append(np.ascontiguousarray(np.frombuffer(raw[at:end], np.uint8).reshape(kind.itemsize, size).T).view(kind).reshape(size))
        at = end
    return found


def rows(values: list[tuple], schema: str) -> pa.RecordBatch:
    """Tuples as an Arrow batch of a flat Spark schema."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*values, strict=True) if values else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """``bucket, from, to`` of ascending 64-bit keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            yield bucket, a, b


def ask(chunks: DataFrame, question: Callable[[dict], tuple], buckets: int) -> DataFrame:
    """Messages of all chunks; ``question`` maps a row to ascending keys and arrays beside them."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, *more = question(row)
                for bucket, a, b in slices(keys, buckets):
                    yield rows([(bucket, row["chunk"], packed(keys[a:b], *(m[a:b] for m in more)))], MESSAGE)
    return chunks.mapInArrow(run, MESSAGE)


def gather(df: DataFrame, by: str, fn: Callable[[int, list[dict]], list[tuple]], schema: str, parts: int | None = None) -> DataFrame:
    """Apply ``fn`` to the rows of each value of ``by``, which are bounded in size; it returns output rows."""
    dealt = df.repartition(parts, by) if parts else df.repartition(by)

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row[by] != key:
                    yield rows(fn(key, held), schema)
                    held = []
                key = row[by]
                held.append(row)
        if held:
            yield rows(fn(key, held), schema)

    return dealt.sortWithinPartitions(by).mapInArrow(run, schema)


def answer(messages: DataFrame, fn: Callable[[list[list[np.ndarray]]], list[tuple]], buckets: int) -> DataFrame:
    """Answers of all buckets; ``fn`` maps the chunks' arrays to one tuple of arrays for each chunk."""
    def run(bucket, held):
        held.sort(key=lambda r: r["chunk"])
        found = fn([unpacked(r["data"]) for r in held])
        return [(bucket, r["chunk"], packed(*out)) for r, out in zip(held, found, strict=True)]
    return gather(messages, "bucket", run, MESSAGE, buckets)


def joined(held: list[dict]) -> list[np.ndarray]:
    """A chunk's answers from all buckets, in the order of its keys."""
    parts = [unpacked(r["data"]) for r in sorted(held, key=lambda r: r["bucket"])]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]
