"""How a row is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions import moods
from ..functions.columns import Col, clamp, col, labels, two_places
from ..functions.keys import TEMPO_TOLERANCE, wheel_number
from ..functions.text import base_name
from ..plans.ranking import middle_values, with_rank
from . import ranks
from .tag_counts import popularity


def organise_plan(df: DataFrame, dest: str, path: str = "path", genre: str = "top_genre", vibe: str = "vibe") -> DataFrame:
    place = F.concat_ws("/", F.lit(dest.rstrip("/")), F.col(genre), F.coalesce(F.col(vibe), F.lit("Unknown")), base_name(path))
    return df.select(path, place.alias("target"))


def profile_row(df: DataFrame) -> DataFrame:
    """Rounded measures, joined labels, the first genre and packed confidences."""
    packed = lambda g: F.concat(g["label"], F.lit(":"), two_places(g["value"]))
    shaped = {
        "bpm": F.bround("bpm", 1), "danceability": F.bround("danceability", 3), "duration": F.bround("duration", 1),
        "lufs": F.bround("lufs", 1), **{c: F.bround(c, 4) for c in ranks.INGREDIENTS},
    }
    return df.withColumns({name: value for name, value in shaped.items() if name in df.columns}).withColumns({
        "top_genre": F.coalesce(F.try_element_at("genres", F.lit(1))["label"], F.lit("—")),
        "confidence": F.array_join(F.transform("genres", packed), "; "),
        "genres": F.array_join(F.transform("genres", lambda g: g["label"]), "; "),
    })


def valence(stored: str = "valence", words: str = "moods") -> Column:
    """The stored number, else the one read from the words."""
    return F.coalesce(F.col(stored), moods.word_valence(words))


def library_frame(df: DataFrame) -> DataFrame:
    """Derived measures over all rows, then only the rows placed on the map."""
    whole = ranks.energy(df.withColumn("valence", valence()), key="id")
    ranked = with_rank(whole, "valence", "valence_rank", key="id")
    return ranked.filter(F.col("x").isNotNull()).withColumns({
        "genre_list": labels("genres"), "mood_list": labels("moods")})


def with_summary(df: DataFrame, column: str = "moods", id_column: str = "id") -> DataFrame:
    """Add ``distinctive`` and ``mood``: the rarest label first, then the others."""
    counts = popularity(df, column)
    placed = df.select(id_column, F.posexplode(labels(column)).alias("at", "label")).join(counts, "label")
    rare = placed.groupBy(id_column).agg(F.min_by("label", F.struct("n", "at")).alias("distinctive"))
    return df.join(rare, id_column, "left").withColumn("mood", _told(column, F.col("distinctive")))


def _told(column: str, rare: Column) -> Column:
    rest = F.array_join(F.array_remove(labels(column), rare), "; ")
    return F.when(rare.isNull(), F.lit("")).when(rest == "", rare).otherwise(F.concat(rare, F.lit(" · "), rest))


def shown(mood: Col = "mood") -> dict[str, Column]:
    """The common reading of one row."""
    return {
        "file": F.col("name"), "BPM": F.bround("bpm", 0).cast("long"), "key": F.nullif(F.col("camelot"), F.lit("")),
        "energy": fmt.decile("energy"), "groove": fmt.groove_pill("danceability"),
        "emotion": fmt.emotion_arrow("valence_rank"), "mood": col(mood), "genres": labels("genres"),
        "folder": F.col("folder"),
    }


def reading(df: DataFrame) -> DataFrame:
    told = with_summary(df)
    columns = shown()
    if "energy" not in told.columns:
        columns.pop("energy")
    return told.select("id", "path", *[value.alias(name) for name, value in columns.items()])


def scaled(value: Column, low: Column, high: Column) -> Column:
    return F.when(value.isNull(), None).when(high > low, clamp((value - low) / (high - low), 0.0, 1.0)).otherwise(0.5)


def heights(df: DataFrame, catalogue: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Scaled heights of the rows of a set on every axis: rank axes as they are, the wheel 1..12,
    groove on the catalogue's deciles, tempo within the tolerance of the set's middle value."""
    span = ranks.groove_span(df if catalogue is None else catalogue)
    low, high = span.select("low").scalar(), span.select("high").scalar()
    middles = middle_values(df, "bpm", by, "_middle")
    if by:
        rows = df.join(middles, list(by), "left")
        middle = F.coalesce(F.col("_middle"), F.lit(120.0))
    else:
        rows, middle = df, F.coalesce(middles.scalar(), F.lit(120.0))
    number = wheel_number(F.upper(F.trim("camelot"))).cast("double")
    out = {
        "groove": scaled(F.col("danceability"), low, high),
        "tempo": scaled(F.col("bpm"), middle * (1 - TEMPO_TOLERANCE), middle * (1 + TEMPO_TOLERANCE)),
        "key": scaled(number, F.lit(1.0), F.lit(12.0)),
    }
    for column in ("energy", "valence_rank"):
        if column in df.columns:
            out[f"{column}_height"] = clamp(column, 0.0, 1.0)
    keep = [c for c in df.columns if c not in out]
    return rows.select(*keep, *[value.alias(name) for name, value in out.items()])


def analysis_row(df: DataFrame) -> DataFrame:
    """Report row: boundaries and sections packed as texts."""
    boundary = lambda b: F.concat(fmt.remaining(b["time"], F.col("duration")), F.lit("("), b["label"], F.lit(" "),
                                  two_places(b["confidence"]), F.lit(")"))
    bars = lambda s: F.when(F.coalesce(s["bars"], F.lit(0.0)) != 0,
                            F.format_string(" [%.0fb]", F.bround(s["bars"], 0))).otherwise("")
    section = lambda s: F.concat(s["label"], F.when(s["vocal"], F.lit(" 🎤")).otherwise(""), F.lit(" "),
                                 fmt.remaining(s["start"], F.col("duration")), bars(s))
    return df.select(
        "path", "genre", F.bround("bpm", 1).alias("bpm"), F.coalesce("vibe", F.lit("")).alias("vibe"),
        F.array_join(F.transform("boundaries", boundary), "; ").alias("boundaries"),
        F.array_join(F.transform("sections", section), "; ").alias("sections"),
        F.coalesce("error", F.lit("")).alias("error"))


def table_sorted(df: DataFrame, column: str, tie: str, descending: bool = False) -> DataFrame:
    """Numbers when any cell is one, otherwise lower-cased text; equal cells stay in place."""
    number = F.col(column).cast("string").try_cast("double")
    numeric = df.agg(F.coalesce(F.bool_or(number.isNotNull()), F.lit(False)).alias("n")).first()["n"]
    key = number if numeric else F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    first = key.desc_nulls_first() if descending else key.asc_nulls_last()
    return df.orderBy(first, F.desc(tie) if descending else F.asc(tie))
