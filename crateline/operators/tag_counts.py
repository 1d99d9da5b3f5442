"""Counting labels held in joined texts."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, labels
from ..functions.formats import genre_level
from ..functions.tags import split_tag


def popularity(df: DataFrame, column: str = "moods") -> DataFrame:
    """How often each label occurs."""
    return df.select(F.explode(labels(column)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of leaves and of their parents in one pass; the grand total keeps both NULL."""
    leaves = df.select(F.explode(labels(column)).alias("leaf"))
    return (leaves.withColumn("parent", genre_level("leaf", "parent")).rollup("parent", "leaf")
            .agg(F.count("*").alias("n")))


def macro_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct leaves under each parent."""
    leaves = df.select(F.explode(labels(column)).alias("leaf")).distinct()
    return leaves.groupBy(genre_level("leaf", "parent").alias("parent")).agg(F.count("*").alias("n"))


def leaves_wanted(df: DataFrame, column: str, leaves: Seq[str] = (), parents: Seq[str] = ()) -> DataFrame:
    """Ticked leaves, else every leaf under the ticked parents, else all."""
    known = df.select(F.explode(labels(column)).alias("leaf")).distinct()
    if leaves:
        return known.filter(F.col("leaf").isin(list(leaves)))
    if parents:
        return known.filter(genre_level("leaf", "parent").isin(list(parents)))
    return known


def exploded(df: DataFrame, column: str, order: str, hierarchy: bool = True) -> DataFrame:
    """One row per row and distinct label, with the place the label was met at."""
    return df.select("*", F.posexplode(split_tag(column, hierarchy)).alias("_at", "spelling")).select(
        *df.columns, F.lower("spelling").alias("key"), "spelling", F.struct(F.col(order), F.col("_at")).alias("_met"))


def breakdown(df: DataFrame, column: str, order: str, hierarchy: bool = True) -> DataFrame:
    """Rows per label, counted without case, shown in the first spelling met."""
    return exploded(df, column, order, hierarchy).groupBy("key").agg(
        F.min_by("spelling", "_met").alias("type"), F.count("*").alias("tracks")).drop("key")


def with_and_without(df: DataFrame, column: str, hierarchy: bool = True) -> DataFrame:
    found = F.size(split_tag(column, hierarchy))
    return df.agg(F.count_if(found > 0).alias("tracks_with_any"), F.count_if(found == 0).alias("tracks_without"))


def rows_with(df: DataFrame, column: str, order: str, types: Seq[str], path: str = "path",
              hierarchy: bool = True) -> DataFrame:
    """Distinct paths carrying any of the types, sorted."""
    keys = [t.lower() for t in types]
    return exploded(df, column, order, hierarchy).filter(F.col("key").isin(keys)).select(path).distinct().orderBy(path)


def missing_tags(df: DataFrame, genre: str | None = "genre", comment: str | None = "comment",
                 require_both: bool = False, error: str = "error") -> DataFrame:
    """Readable rows lacking any (or all) of the asked tags."""
    lacks = [blank_to_null(c).isNull() for c in (genre, comment) if c]
    if not lacks:
        return df.filter(F.lit(False))
    test: Column = lacks[0]
    for other in lacks[1:]:
        test = (test & other) if require_both else (test | other)
    return df.filter(F.col(error).isNull() & test)


def top_colours(df: DataFrame, column: str, palette: Seq[str], order: str, other: str) -> DataFrame:
    """A colour for the most frequent values, the first met of equals; all others grey."""
    ranked = (df.filter(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count("*").alias("n"), F.min(order).alias("_first"))
              .orderBy(F.desc("n"), "_first").limit(len(palette)))
    placed = ranked.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "_first", F.col(column).alias("v"))))
                        .alias("top")).select(F.posexplode("top").alias("_at", "_t"))
    colours = placed.select(F.col("_t.v").alias(column), F.element_at(
        F.array(*[F.lit(c) for c in palette]), F.col("_at") + 1).alias("_colour"))
    return df.join(F.broadcast(colours), column, "left").select(
        *df.columns, F.coalesce("_colour", F.lit(other)).alias("colour"))
