"""Catalogue rows, manifests, reports and side-cars on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import blank_to_null
from ..functions.formats import AUDIO_FORMATS, format_of, is_audio
from ..functions.text import base_name, suffix
from ..operators.duplicates import QUARANTINE
from ..operators.sync import appendable, latest
from ..plans.ranking import finite
from .file_tree import contents, tree

ROW_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("path", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("folder", T.StringType()), T.StructField("mtime", T.DoubleType()), T.StructField("size", T.LongType()),
    T.StructField("duration", T.DoubleType()), T.StructField("bpm", T.DoubleType()), T.StructField("camelot", T.StringType()),
    T.StructField("danceability", T.DoubleType()), T.StructField("genres", T.StringType()), T.StructField("moods", T.StringType()),
    T.StructField("energy_density", T.DoubleType()), T.StructField("energy_bass", T.DoubleType()),
    T.StructField("energy_bright", T.DoubleType()), T.StructField("energy_pulse", T.DoubleType()),
    T.StructField("valence", T.DoubleType()), T.StructField("mood_evidence", T.DoubleType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()),
])
# Extensions worth analysing and worth tagging.
ANALYSED = (".mp3", ".flac")
TAGGABLE = tuple(AUDIO_FORMATS)


def read_rows(spark: SparkSession, path: str, schema: T.StructType = ROW_SCHEMA) -> DataFrame:
    """Stored rows, last write per path. Lines cut short are dropped; rows without a vector too.

    ``has_energy`` tells a field family that was written, even empty, from one never written.
    """
    lines = spark.read.text(path)
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    keys = F.json_object_keys("value")
    written = F.forall(F.array(*[F.lit(f"energy_{x}") for x in ("density", "bass", "bright", "pulse")]), lambda k: F.array_contains(keys, k))
    rows = parsed.filter(F.col("r").isNotNull() & F.col("r._bad").isNull() & F.col("r.path").isNotNull()).select(
        "r.*", F.coalesce(written, F.lit(False)).alias("has_energy")).drop("_bad")
    return latest(normalised(appendable(rows)))


def normalised(df: DataFrame) -> DataFrame:
    """NaN, infinities and blank texts are NULL from here on."""
    fixed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            fixed[field.name] = finite(field.name).cast(field.dataType)
        elif isinstance(field.dataType, T.StringType):
            fixed[field.name] = F.when(blank_to_null(field.name).isNotNull(), F.col(field.name))
    return df.withColumns(fixed) if fixed else df


def append_rows(profiles: DataFrame, path: str) -> None:
    appendable(profiles).write.mode("append").parquet(path)


def rewritten(rows: DataFrame, target: str) -> None:
    """A new version beside the old one; the caller switches over once it is complete."""
    rows.write.mode("errorifexists").parquet(target)


def _listed(spark: SparkSession, root: str, skip: tuple[str, ...], quarantined: bool) -> DataFrame:
    return tree(spark, root, skip if quarantined else (*skip, QUARANTINE))


def manifest(spark: SparkSession, root: str, audio_only: bool = False, skip: tuple[str, ...] = (), quarantined: bool = False) -> DataFrame:
    """Files of a tree from their metadata alone, hidden names included; what cannot be looked at is in ``unreadable``.

    Folders named in ``skip`` are left out at any depth, those of the quarantine unless ``quarantined``.
    """
    listed = _listed(spark, root, skip, quarantined).filter(F.col("reason").isNull()).drop("reason").withColumn("fmt", format_of("path"))
    return listed.filter(is_audio("fmt")) if audio_only else listed


def unreadable(spark: SparkSession, root: str, skip: tuple[str, ...] = (), quarantined: bool = False) -> DataFrame:
    """(path, reason) of the files and folders under ``root`` that could not be looked at."""
    return _listed(spark, root, skip, quarantined).filter(F.col("reason").isNotNull()).select("path", "reason")


def with_content(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, content) of the wanted files only."""
    return contents(wanted)


def with_extensions(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    return files.filter(F.lower(suffix("path")).isin(*extensions)).orderBy("path")


def taggable(files: DataFrame) -> DataFrame:
    """Formats whose tags can be written, side-cars excluded."""
    return with_extensions(files.filter(~base_name("path").startswith("._")), TAGGABLE)


def write_report(rows: DataFrame, target: str, fmt: str = "csv", columns: list[str] | None = None) -> None:
    """Fixed columns as CSV, or JSON with the nested detail."""
    if fmt == "csv":
        rows.select(columns or rows.columns).write.mode("overwrite").option("header", True).csv(target)
    else:
        rows.write.mode("overwrite").json(target)


def read_sample(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A measured sample read back: known levels from the highest, unknown last."""
    return spark.read.schema(schema).option("header", True).csv(path).orderBy(F.desc_nulls_last("level"), "path")


def write_sidecars(analyses: DataFrame, path: str) -> None:
    analyses.write.mode("append").json(path)


def read_sidecars(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Latest analysis per path of the side-car dataset."""
    return latest(spark.read.schema(schema).json(path))


# --- the choice journal ----------------------------------------------------------------------

FACTS = ("path", "bpm", "camelot", "energy", "valence", "danceability", "genres", "moods")


def with_facts(events: DataFrame, catalogue: DataFrame, on: str = "path") -> DataFrame:
    """Gestures with the row's numbers as they are now."""
    facts = catalogue.select(on, *[finite(c).alias(c) if dict(catalogue.dtypes)[c] in ("double", "float") else F.col(c)
                                   for c in FACTS if c in catalogue.columns and c != on])
    return events.join(facts, on, "left")


def append_journal(lines: DataFrame, path: str) -> None:
    stamped = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    lines.withColumn("at", stamped).write.mode("append").json(path)


def journal_lines(raw: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Journal entries out of text lines; broken lines are passed over."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = raw.select(F.from_json(value, whole, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("r.*").drop("_bad")


def read_journal(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return journal_lines(spark.read.text(path), schema)
