"""Streams over the event journal, run to the end of what is there."""

import uuid

from pyspark.sql import functions as F

from ..plans.session import checkpoint_dir
from ..streaming import streams
from . import query
from .stand_ins import catalogue, table, with_catalogue


def event_stream(spark, sf):
    """The events file as a stream source."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def events(spark, sf):
    return table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("ST1_choice_counts", "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def choice_counts(spark, sf):
    counts = streams.choice_counts(event_stream(spark, sf).withColumnRenamed("event_type", "kind"))
    return streams.run_to_end(counts).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ST2_minute_buckets", "SELECT date_trunc('minute', ts) AS minute, count(*) AS items, round(sum(value), 6) AS seconds FROM events WHERE value <= 60 GROUP BY ALL")
def minute_buckets(spark, sf):
    buckets = streams.run_to_end(streams.minute_buckets(event_stream(spark, sf).withColumn("seconds", F.col("value"))))
    return buckets.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "items", F.round("seconds", 6).alias("seconds"))


@query("ST2_pace", "SELECT count(*) AS minutes, round(sum(s) / sum(n), 6) AS seconds_each, round(sum(s) / sum(n) * 500, 6) AS eta_seconds FROM (SELECT date_trunc('minute', ts) AS m, count(*) AS n, sum(value) AS s FROM events "
       "WHERE value <= 60 GROUP BY 1 ORDER BY 1 DESC LIMIT 30)")
def pace(spark, sf):
    told = streams.pace(streams.minute_buckets(events(spark, sf).withColumn("seconds", F.col("value"))), 500)
    return told.select("minutes", F.round("seconds_each", 6).alias("seconds_each"), F.round("eta_seconds", 6).alias("eta_seconds"))


@query("ST3_upserted", "SELECT user_id AS path, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upserted(spark, sf):
    home = f"{checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}"
    rows = event_stream(spark, sf).select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), "event_id", "value")
    streams.upsert_latest(rows, home + "/table", home + "/state").awaitTermination()
    return streams.read_latest(spark, home + "/table").select("path", "event_id", "value")


@query("ST3_upserted_in_batches", "SELECT user_id AS path, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def upserted_in_batches(spark, sf):
    """Seven arrivals, the newest rows not in the last of them: runs of four, two and one batches are left."""
    home = f"{checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}"
    rows = events(spark, sf).select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), "event_id", "value", (F.col("event_id") * 5 % 7).alias("part"))
    for _ in _arrivals(rows, home, 7):
        streams.upsert_latest(_queue(spark, rows, home), home + "/table", home + "/state", buckets=8).awaitTermination()
    return streams.read_latest(spark, home + "/table").select("path", "event_id", "value")


def _arrivals(rows, home, parts=3):
    """Write the rows as so many arrivals, one after another: yields after each."""
    for part in range(parts):
        rows.filter(F.col("part") == part).drop("part").write.parquet(f"{home}/queue/part={part}")
        yield part


def _queue(spark, rows, home):
    return spark.readStream.schema(rows.drop("part").schema).parquet(f"{home}/queue/*")


_FLAKY = "path % 7 = 0"  # these fail at their first attempt
_FIRST = "SELECT user_id AS path, min(event_id % 3) AS part FROM events GROUP BY user_id"


def _synced(spark, sf):
    """Three starts over one checkpoint; a seventh of the keys fails at first, and those that arrive last are not tried again."""
    home = f"{checkpoint_dir(spark)}/sync-{uuid.uuid4().hex}"
    rows = events(spark, sf).select(F.col("user_id").alias("path"), (F.col("event_id") % 3).alias("part"))
    failing = F.when(F.expr(_FLAKY) & (F.col("attempt") == 0), F.lit("busy"))
    work = lambda df: df.withColumn("error", failing).withColumn("doubled", F.when(F.col("error").isNull(), F.col("path") * 2))
    for _ in _arrivals(rows, home):
        streams.incremental_sync(_queue(spark, rows, home), work, home + "/out", home + "/state").awaitTermination()
    return streams.done_rows(spark, home + "/out")


_SYNCED = f"""SELECT path, CASE WHEN NOT ({_FLAKY} AND part = 2) THEN path * 2 END AS doubled, CASE WHEN {_FLAKY} AND part < 2 THEN 1 ELSE 0 END AS attempt,
 CASE WHEN {_FLAKY} AND part = 2 THEN 'busy' END AS error FROM ({_FIRST})"""


@query("ST4_incremental_sync", _SYNCED)
def incremental_sync(spark, sf):
    return _synced(spark, sf).select("path", "doubled", "attempt", "error")


@query("ST4_job_summary", f"SELECT count(*) FILTER (error IS NULL) AS done, count(*) FILTER (error IS NOT NULL) AS failed, min(path) FILTER (error IS NOT NULL) AS first_failed FROM ({_SYNCED})")
def job_summary(spark, sf):
    good, bad = F.col("error").isNull(), F.col("error").isNotNull()
    return _synced(spark, sf).agg(F.count_if(good).alias("done"), F.count_if(bad).alias("failed"), F.min(F.when(bad, F.col("path"))).alias("first_failed"))


@query("ST5_backfill_stream", with_catalogue("SELECT id, coalesce(valence, CASE WHEN bpm IS NOT NULL THEN bpm / 1e3 END) AS valence FROM catalogue"))
def backfill_stream(spark, sf):
    """The catalogue arrives in two parts; what lacks a value is computed once, what cannot be is tried again and stays as it is."""
    home = f"{checkpoint_dir(spark)}/backfill-{uuid.uuid4().hex}"
    rows = catalogue(spark, sf).select("id", "bpm", "valence")
    parts = rows.withColumn("part", F.col("id") % 2)
    compute = lambda df: df.select("id", "attempt", (F.col("bpm") / 1e3).alias("valence"), F.when(F.col("bpm").isNull(), F.lit("no tempo")).alias("error"))
    for _ in _arrivals(parts, home, 2):
        streams.backfill_stream(_queue(spark, parts, home), F.col("valence").isNull(), compute, home + "/out", home + "/state", "id", attempts=2).awaitTermination()
    return streams.with_backfill(rows, home + "/out", ["valence"], "id").select("id", "valence")


@query("ST6_activity_sessions", """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s""")
def activity_sessions(spark, sf):
    found = streams.activity_sessions(events(spark, sf), "user_id", gap="6 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
