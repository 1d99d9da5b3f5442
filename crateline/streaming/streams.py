"""Event journals, progress, last-write-wins tables and resumable queues as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sync import latest
from ..plans.session import checkpoint_dir

# Longest job counted, minutes looked back over.
MAX_SECONDS, RECENT_MINUTES = 60.0, 30


def choice_counts(events: DataFrame, at: str = "at", kind: str = "kind", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Gestures per kind and tumbling window; later than the watermark is dropped in a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), kind, "n")


def minute_buckets(done: DataFrame, at: str = "at", seconds: str = "seconds", late: str = "10 minutes") -> DataFrame:
    """Items and seconds per active minute; items that took too long are pauses, not work."""
    return done.filter(F.col(seconds) <= MAX_SECONDS).withWatermark(at, late).groupBy(F.window(at, "1 minute").alias("w")).agg(
        F.count("*").alias("items"), F.sum(seconds).alias("seconds")).select(F.col("w.start").alias("minute"), "items", "seconds")


def pace(buckets: DataFrame, left: Column | int = 0, minutes: int = RECENT_MINUTES) -> DataFrame:
    """Seconds per item over the latest active minutes, and the time the rest will take."""
    recent = buckets.orderBy(F.desc("minute")).limit(minutes)
    each = F.sum("seconds") / F.sum("items")
    left = F.lit(left) if isinstance(left, int) else left
    return recent.agg(F.count("*").alias("minutes"), each.alias("seconds_each"), (each * F.max(left)).alias("eta_seconds"))


def activity_sessions(events: DataFrame, by: str, at: str = "at", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of activity separated by quiet."""
    return events.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select(
        by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


# --- sinks -----------------------------------------------------------------------------------

# A table of last rows is a set of runs: each holds one row per key, in files of key buckets. A
# batch takes in the runs of levels 0, 1, 2 .. as far as they are there without a gap, and becomes
# the run of the next level, as a binary counter carries: n batches leave at most log2(n) + 1 runs,
# and a row is written again log2(n) times. What is live after a batch stands in its manifest,
# written last; a batch that is replayed starts from the manifest before it and overwrites its own.

_RUNS = "run long, level int"
#: Files of a run; fixed for a table. Level of a compacted run, above what batches reach.
BUCKETS, COMPACTED = 64, 60


def _live(spark: SparkSession, target: str, number: int) -> list[tuple[int, int]]:
    """(run, level) after a batch: one row per level, so a list of logarithmic length."""
    return sorted(((r["run"], r["level"]) for r in spark.read.schema(_RUNS).json(f"{target}/manifest/batch={number}").collect()), key=lambda r: r[1])


def _commit(spark: SparkSession, target: str, number: int, live: list[tuple[int, int]], mode: str = "overwrite") -> None:
    spark.createDataFrame(live, _RUNS).coalesce(1).write.mode(mode).json(f"{target}/manifest/batch={number}")


def _committed(spark: SparkSession, target: str) -> int:
    """The last batch with a manifest, told from the names alone."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{target}/manifest").select("path")
    last = names.agg(F.max(F.regexp_extract("path", "/batch=(-?[0-9]+)/[^/]*$", 1).cast("long")).alias("last")).first()["last"]
    return -1 if last is None else last


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_run(rows: DataFrame, target: str, run: int, key: str, buckets: int) -> None:
    """The rows of a key bucket in one file, so that a key is in one file of a run."""
    placed = rows.withColumn("bucket", _bucket(key, buckets)).repartition(buckets, "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/runs/run={run}")


def _read_runs(spark: SparkSession, target: str, runs: list[int], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", f"{target}/runs")
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("run", T.LongType()), T.StructField("bucket", T.IntegerType())]))
    return reader.parquet(*[f"{target}/runs/run={run}" for run in runs]).drop("run")


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, key: str = "path", seq: str = "seq", buckets: int = BUCKETS):
    """Keep the last row per key of a stream in runs of growing size; a batch is visible once its manifest is written."""
    _commit(stream.sparkSession, target, -1, [], "ignore")

    def merge(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch
        live, level = _live(spark, target, number - 1), 0
        held = {at: run for run, at in live}
        while level in held:
            level += 1
        taken = [held[at] for at in range(level)]
        if taken:
            rows = rows.unionByName(_read_runs(spark, target, taken, batch.schema).drop("bucket"))
        _write_run(latest(rows, key, seq), target, number, key, buckets)
        _commit(spark, target, number, [(number, level), *[r for r in live if r[1] > level]])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_runs(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(run, level) of the runs a reader has to look at; other folders of ``runs`` may be removed once no reader uses them."""
    return _live(spark, target, _committed(spark, target))


def read_latest(spark: SparkSession, target: str, key: str = "path", seq: str = "seq") -> DataFrame:
    """The last row per key of the committed runs."""
    return latest(_read_runs(spark, target, [run for run, _ in live_runs(spark, target)]).drop("bucket"), key, seq)


def read_keys(spark: SparkSession, target: str, keys: list, key: str = "path", seq: str = "seq", buckets: int = BUCKETS) -> DataFrame:
    """The last rows of a few keys: one file of each run for each key is opened, the others are pruned by name."""
    rows = _read_runs(spark, target, [run for run, _ in live_runs(spark, target)])
    wanted = spark.createDataFrame([(k,) for k in keys], T.StructType([rows.schema[key]]))
    found = [r["bucket"] for r in wanted.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]
    return latest(rows.filter(F.col("bucket").isin(found) & F.col(key).isin(keys)).drop("bucket"), key, seq)


def compact(spark: SparkSession, target: str, fresh: str, key: str = "path", seq: str = "seq", buckets: int = BUCKETS) -> None:
    """All runs as one, in a new place, where a stream may go on with a new checkpoint."""
    _write_run(read_latest(spark, target, key, seq), fresh, -1, key, buckets)
    _commit(spark, fresh, -1, [(-1, COMPACTED)])


# --- resumable work --------------------------------------------------------------------------

#: How long a finished key is remembered, and how often a key that fails is tried.
REMEMBERED, ATTEMPTS = "30 days", 3


def queued(arrivals: DataFrame, key: str = "path", remember: str = REMEMBERED) -> DataFrame:
    """Arrivals (with ``attempt``) that are due: each attempt at a key once, from the keyed state of the stream.

    The state holds one entry per key and attempt and lets it go ``remember`` after it was first
    seen. Time is the batch's own, which a replayed batch keeps, so that no arrival counts as late.
    """
    seen = arrivals.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", remember)
    return seen.dropDuplicatesWithinWatermark([key, "attempt"]).drop("_seen")


def incremental_sync(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "path",
                     remember: str = REMEMBERED, attempts: int = ATTEMPTS):
    """Work on keys that were not done yet; a restart over the same checkpoint passes over what is done and tries again what failed.

    ``work`` gets the due rows and returns one row for each, at least ``key`` and whatever it found;
    where its column ``error`` (string, optional) is not null the key is queued again, by the next
    start, until it was tried ``attempts`` times. A batch reads its own arrivals and the failures
    of the starts before it, never the results so far. Results lie in ``target/done``, failures
    with their arrivals in ``target/failed``; a replayed batch overwrites its own folder.
    """
    spark = stream.sparkSession
    arrived = stream.withColumn("attempt", F.lit(0))
    failed = f"{target}/failed"
    lost = T.StructType([*arrived.schema.fields, T.StructField("error", T.StringType())])
    spark.createDataFrame([], lost).write.mode("append").parquet(f"{failed}/batch=-1")
    again = spark.readStream.schema(T.StructType([*lost.fields, T.StructField("batch", T.LongType())])).parquet(failed)
    again = again.filter(F.col("attempt") + 1 < attempts).withColumn("attempt", F.col("attempt") + 1)
    due = queued(arrived.unionByName(again.select(*arrived.columns)), key, remember)

    def run(batch: DataFrame, number: int) -> None:
        done, spark = f"{target}/done/batch={number}", batch.sparkSession
        # Written first: the batch, and with it the state, is worked out once.
        batch.write.mode("overwrite").parquet(f"{target}/due/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(f"{target}/due/batch={number}")
        worked = work(rows)
        if "error" not in worked.columns:
            worked = worked.withColumn("error", F.lit(None).cast("string"))
        if "attempt" not in worked.columns:
            worked = worked.join(rows.select(key, "attempt"), key)
        worked.write.mode("overwrite").parquet(done)
        wrong = spark.read.schema(worked.schema).parquet(done).filter(F.col("error").isNotNull())
        bad = rows.join(wrong.select(key, "attempt", "error"), [key, "attempt"])
        bad.select(*lost.names).write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return due.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def done_rows(spark: SparkSession, target: str, key: str = "path") -> DataFrame:
    """The last attempt at each key: what it found, ``attempt``, and ``error`` where it failed."""
    return latest(spark.read.parquet(f"{target}/done").drop("batch"), key, "attempt")


def backfill_stream(stream: DataFrame, missing: Column, compute: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "path",
                    remember: str = REMEMBERED, attempts: int = ATTEMPTS):
    """Rows lacking a field, computed and saved batch by batch; rows that have it are not queued."""
    return incremental_sync(stream.filter(missing), compute, target, checkpoint, key, remember, attempts)


def with_backfill(rows: DataFrame, target: str, fields: list[str], key: str = "path") -> DataFrame:
    """Rows with the backfilled fields in place of missing ones; what a row has already stays."""
    found = done_rows(rows.sparkSession, target, key).filter("error IS NULL").select(F.col(key).alias("_key"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = rows.join(found, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(c, f"_new_{c}").alias(c) if c in fields else F.col(c) for c in rows.columns])


def run_to_end(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now; its last state as a table in the shared folder."""
    spark = result.sparkSession
    home = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        folder = home + "/out" if mode == "complete" else f"{home}/out/batch={number}"
        batch.write.mode("overwrite").parquet(folder)

    query = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", home + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(home + "/out")
