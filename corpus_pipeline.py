"""A corpus pipeline over ``documents``: language, exact copies, near copies, benchmark passages, packing.

Each stage takes the rows that its predecessor kept and returns whole rows, but for the last, which
returns the places of the tokens. Rows that repeat an id are told apart by their text in the exact
stage; the later stages decide by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.llm import decontamination, exact_dedup, jaccard_join, language_id, packing, tokens
from crateline.llm.common import new_path, table


def _by_id(docs: DataFrame, ids: DataFrame, how: str, *more: tuple[Column, str]) -> DataFrame:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) a row of ``ids`` for their id and further keys."""
    names = ["doc_id", *(name for _, name in more)]
    keys = ids.select(*(F.col(name).alias(f"_its_{name}") for name in names)).distinct()
    on = docs["doc_id"].eqNullSafe(keys["_its_doc_id"])
    for value, name in more:
        on = on & (value == keys[f"_its_{name}"])
    return docs.join(keys, on, how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose best language has at least half of the score."""
    path = language_id.vocabulary()
    return language_id.accept(docs, *language_id.learn(docs, path), path)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts: the smallest id, and one of the rows that repeat it."""
    kept = exact_dedup.exact_dedup(docs).filter("kept")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    single = _by_id(_by_id(docs, kept, "left_semi"), again, "left_anti")
    digest = F.sha2(exact_dedup.normalised(F.col("text")), 256)
    several = _by_id(_by_id(docs, again, "left_semi"), kept, "left_semi", (digest, "text_sha256"))
    return single.unionByName(several.withColumn("_digest", digest).dropDuplicates(["doc_id", "_digest"]).drop("_digest"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles connect: the smallest id."""
    told = jaccard_join.jaccard_join(docs)
    return _by_id(docs, told.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))), "left_semi")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return _by_id(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents that are left."""
    return packing.pack(docs, tokens.vocabulary(), added=True)[0].drop("part", "at")


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontamination", clean), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
