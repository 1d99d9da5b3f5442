"""Helpers of the training-data operators: tables in the shared folder, Arrow steps, token coding."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.session import checkpoint_dir

#: Text bytes of one Arrow step; rows are cut into steps of about this size before any Python work.
STEP_BYTES = 3 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write the rows to the shared folder and read them back: the lineage ends here."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing will read again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def give_back() -> None:
    """Give memory that is free in this Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # where the C library can


def let_go(stage: str) -> dict:
    """What this Python worker keeps for a stage of a pipeline; objects of any other stage are forgotten."""
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__.setdefault("kept", {})
    if held.get("") != stage:
        held.clear()
        held[""] = stage
        gc.collect()
        give_back()
    return held


def kept(name: str, make: Callable[[], object], stage: str) -> object:
    """An object that a Python worker keeps from task to task, as long as it works for one stage of a pipeline.

    Workers go on from one stage to the next; what the stage before held is let go then. Functions of this
    package travel to the workers by value, so their own globals start anew in every task.
    """
    held = let_go(stage)
    if name not in held:
        held[name] = make()
    return held[name]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def steps(batches: Iterator[pa.RecordBatch], sized: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the values of one column take about ``most`` bytes a step; one long value may take more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(sized))
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    give_back()  # the worker may stay idle for the rest of a pipeline


def arrow_step(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, sized: str = "text") -> DataFrame:
    """Map steps of rows to rows, each step alone."""
    def run(batches):
        for step in steps(batches, sized):
            made = fn(step)
            if made is not None and made.num_rows:
                yield made
    return df.mapInArrow(run, schema)


def code_tokens(lists: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct tokens, the index of each token of all lists in order, and the lists' lengths."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__  # a new token gets the next number as it is looked up
    at = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    known.default_factory = None  # no cycle stays
    return list(known), at, sizes


def hash_tokens(tokens: list, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in tokens), np.uint64, len(tokens))


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order, by sorting: on many large numbers much faster than by numpy's hash table."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()
