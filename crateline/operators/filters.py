"""Row filters in which an unknown measure never excludes a row."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Col, col
from ..functions.moods import faint_only, weights
from ..functions.text import MIX_WORDS, has_all_words, looks_like_mashup, matching_words
from ..plans.ranking import finite, quantiles
from .arcs import BANDS


@dataclass
class Wanted:
    """A filter preset: empty lists and missing ranges mean everything."""

    genres: list[str] = field(default_factory=list)
    moods: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    bpm: tuple[float, float] | None = None
    groove: tuple[float, float] | None = None
    genre_depth: int | None = None
    energy: tuple[float, float] | None = None
    valence: tuple[float, float] | None = None


def in_range(value: Col, span: Seq[float]) -> Column:
    value = col(value)
    return value.isNull() | F.isnan(value.cast("double")) | value.between(span[0], span[1])


def filter_rows(df: DataFrame, wanted: Wanted) -> DataFrame:
    if wanted.genres:
        listed = F.col("genre_list")
        if wanted.genre_depth is not None:
            listed = F.slice(listed, 1, wanted.genre_depth)
        df = df.filter(F.arrays_overlap(listed, F.array(*[F.lit(g) for g in wanted.genres])))
    if wanted.moods:
        df = df.filter(F.arrays_overlap("mood_list", F.array(*[F.lit(m) for m in wanted.moods])))
    if wanted.keys:
        df = df.filter(F.col("camelot").isin(wanted.keys))
    for column, span in (("bpm", wanted.bpm), ("danceability", wanted.groove), ("energy", wanted.energy),
                         ("valence_rank", wanted.valence)):
        if span is not None and column in df.columns:
            df = df.filter(in_range(column, span))
    return df


def span(df: DataFrame, column: str, floor: float, ceiling: float) -> DataFrame:
    """Real span of a column, never of zero width; the fallback when it is empty."""
    value = finite(column)
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    low = F.coalesce("low", F.lit(float(floor)))
    high = (F.when(F.col("low").isNull(), F.lit(float(ceiling)))
            .when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1.0))
    return ends.select(low.alias("low"), high.alias("high"))


def chapter_ranges(df: DataFrame, chapter: str) -> DataFrame:
    """A chapter as filter ranges: rank bands as they are, tempo and groove as catalogue quantiles."""
    bands, out = BANDS[chapter], None
    for name, column, fallback in (("bpm", "bpm", (60.0, 200.0)), ("groove", "danceability", (0.0, 1.0))):
        q = quantiles(df, column, bands[name])
        row = q.select(F.lit(name).alias("measure"), F.coalesce(F.col("q")[0], F.lit(fallback[0])).alias("low"),
                       F.coalesce(F.col("q")[1], F.lit(fallback[1])).alias("high"))
        out = row if out is None else out.unionByName(row)
    for name, band in (("energy", bands["arousal"]), ("valence", bands["valence"])):
        fixed = q.select(F.lit(name).alias("measure"), F.lit(band[0]).alias("low"), F.lit(band[1]).alias("high"))
        out = out.unionByName(fixed)
    return out


def matching_rows(df: DataFrame, words: list[str], name: str = "name", folder: str = "folder") -> DataFrame:
    """All words, any order, over name and folder, whatever case and accents."""
    hay = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(folder, F.lit("")))
    return df.filter(has_all_words(hay, words))


def quick_search(df: DataFrame, text: str, order: str, limit: int, name: str = "name") -> DataFrame:
    """First rows in catalogue order whose name holds the text; nothing for a blank text."""
    if not text.strip():
        return df.limit(0)
    return df.filter(has_all_words(name, [text.strip()])).orderBy(order).limit(limit)


def playable(df: DataFrame, seconds: float = 60.0, duration: str = "duration") -> DataFrame:
    known = F.coalesce(F.col(duration), F.lit(0.0))
    return df.filter((known == 0) | (known >= seconds))


def longer_than(df: DataFrame, minutes: float, seconds: str = "seconds") -> DataFrame:
    return df.filter(F.col(seconds) > minutes * 60).orderBy(F.desc(seconds))


def lasting_between(df: DataFrame, low: float, high: float, seconds: str = "seconds") -> DataFrame:
    return df.filter((F.col(seconds) > low * 60) & (F.col(seconds) <= high * 60)).orderBy(F.desc(seconds))


def mix_reasons(df: DataFrame, low: int, high: int, rule: str = "both", words=MIX_WORDS, vs_rule: bool = True,
                name: str = "name", seconds: str = "seconds") -> DataFrame:
    """Why a row looks like a mix: by length, by words in its name, by two "vs"."""
    hits = matching_words(name, words)
    frame = df.withColumn("by_length", F.col(seconds).between(low * 60.0, high * 60.0)).withColumn("_hits", hits)
    told = F.when(F.size("_hits") > 0, F.concat(F.lit("name: "), F.array_join("_hits", ", ")))
    twice = F.when(looks_like_mashup(name), F.lit("two “vs”")) if vs_rule else F.lit(None).cast("string")
    frame = frame.withColumn("_told", told).withColumn("_twice", twice)
    frame = frame.withColumn("by_name", F.col("_told").isNotNull() | F.col("_twice").isNotNull())
    kept = {"both": F.col("by_length") & F.col("by_name"), "either": F.col("by_length") | F.col("by_name"),
            "duration": F.col("by_length")}[rule]
    reasons = F.array_compact(F.array(F.when(F.col("by_length"), F.lit(f"{low}–{high} min")), "_told", "_twice"))
    return frame.withColumn("kept", F.coalesce(kept, F.lit(False))).withColumn("reasons", reasons).drop(
        "_hits", "_told", "_twice")


def mix_summary(reasons: DataFrame, size: str = "size", seconds: str = "seconds") -> DataFrame:
    """The pool of each signal before the rule, and what the rule kept."""
    return reasons.agg(
        F.count_if("by_length").alias("by_length"), F.count_if("by_name").alias("by_name"),
        F.count_if("kept").alias("kept"), F.coalesce(F.sum(F.when(F.col("kept"), F.col(size))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("kept") & (F.col(seconds) <= 60)).alias("short"))


def absent_family(df: DataFrame, flag: str) -> DataFrame:
    """Rows on which a family of fields was never written."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def absent_marker(df: DataFrame, marker: str = "mood_evidence") -> DataFrame:
    return df.filter(F.col(marker).isNull())


def faint_rows(df: DataFrame, scores: str, threshold: float = 0.05) -> DataFrame:
    """Rows coloured only by scores under the threshold; ``scores`` is packed text."""
    return df.filter(faint_only(weights(scores), threshold))
