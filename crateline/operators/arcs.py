"""Chapters of an evening: quotas and bands, scores and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import positions
from ..plans.ranking import with_ranks
from ..plans.session import cut

# Name, share of the set, bands of tempo, arousal, valence and groove.
CHAPTERS = (
    ("Intro", 0.15, (0.0, 0.15), (0.0, 0.25), (0.3, 0.5), (0.2, 0.4)),
    ("Buildup", 0.25, (0.15, 0.4), (0.25, 0.6), (0.4, 0.6), (0.75, 0.95)),
    ("Tension", 0.2, (0.4, 0.7), (0.6, 0.8), (0.0, 0.2), (0.8, 1.0)),
    ("Climax", 0.25, (0.7, 1.0), (0.85, 1.0), (0.75, 1.0), (0.0, 0.9)),
    ("Release", 0.15, (0.3, 0.5), (0.3, 0.5), (0.2, 0.45), (0.3, 0.6)),
)
NAMES = tuple(c[0] for c in CHAPTERS)
BANDS = {c[0]: dict(zip(("bpm", "arousal", "valence", "groove"), c[2:])) for c in CHAPTERS}
MEASURES = ("arc_bpm", "arc_arousal", "arc_valence", "arc_groove")


def measures(df: DataFrame, bpm="bpm", energy="energy", valence="valence_rank", groove="danceability") -> DataFrame:
    """The four 0..1 measures of the arc; an unknown one sits in the middle."""
    ranked = with_ranks(df, {"_bpm": bpm, "_groove": groove})
    half = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.5))
    return ranked.select(*df.columns, half("_bpm").alias("arc_bpm"), half(energy).alias("arc_arousal"),
                         half(valence).alias("arc_valence"), half("_groove").alias("arc_groove"))


def outside(value: Column, band: tuple[float, float]) -> Column:
    return F.greatest(F.lit(band[0]) - value, value - F.lit(band[1]), F.lit(0.0))


def chapter_score(chapter: int, columns=MEASURES) -> Column:
    """Sum of the distances outside the chapter's four bands."""
    return sum((outside(F.col(c), band) for c, band in zip(columns, CHAPTERS[chapter][2:])), F.lit(0.0))


def chapter_costs(df: DataFrame, columns=MEASURES) -> DataFrame:
    """One row per row and chapter with its cost 0..1."""
    scored = F.array(*[F.struct(F.lit(NAMES[i]).alias("chapter"),
                                (chapter_score(i, columns) / len(columns)).alias("cost")) for i in range(len(CHAPTERS))])
    return df.select("*", F.inline(scored))


def chapter_at(position: Column) -> Column:
    """Index of the chapter a share 0..1 of the set falls in."""
    edge, out = 0.0, None
    for i, chapter in enumerate(CHAPTERS[:-1]):
        edge += chapter[1]
        out = F.when(position < edge, i) if out is None else out.when(position < edge, i)
    return out.otherwise(len(CHAPTERS) - 1)


def chapter_of_place(pos: Column, n: Column) -> Column:
    share = pos / F.greatest(F.lit(1), n - 1) * (1 - 1e-9)
    return F.when(n == 1, 0).otherwise(chapter_at(share))


def _quota(n: Column) -> Column:
    """Places per chapter: rounded shares, at least one, repaired to sum to ``n`` by taking from
    the largest or giving to the smallest. Rounding is off by fewer places than there are chapters."""
    base = F.array(*[F.greatest(F.lit(1), F.bround(F.lit(c[1]) * n, 0).cast("int")) for c in CHAPTERS])
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    shift = lambda a, at, by: F.transform(a, lambda x, i: F.when(i == at - 1, x + by).otherwise(x))

    def repaired(a: Column, _: Column) -> Column:
        over = total(a) - n.cast("int")
        return (F.when(over > 0, shift(a, F.array_position(a, F.array_max(a)), -1))
                .when(over < 0, shift(a, F.array_position(a, F.array_min(a)), 1)).otherwise(a))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(CHAPTERS))), base, repaired)


def assign_whole(df: DataFrame, playlist: str, track: str, columns=MEASURES) -> DataFrame:
    """``assign`` for playlists that one task may hold: its five passes sort the rows where they are."""
    chapter, lists = F.col("chapter_no"), Window.partitionBy(playlist)
    rows = df.withColumn("_quota", _quota(F.count("*").over(lists))).withColumn("chapter_no", F.lit(None).cast("int"))
    for i in range(len(NAMES)):
        # Rows that are still free come first.
        place = F.row_number().over(lists.orderBy(chapter.isNotNull(), chapter_score(i, columns), track))
        inside = chapter.isNull() & (F.col("_place") <= F.element_at("_quota", i + 1))
        rows = rows.withColumn("_place", place).withColumn("chapter_no", F.when(inside, i).otherwise(chapter))
    names = F.element_at(F.array(*map(F.lit, NAMES)), chapter + 1)
    return rows.filter(chapter.isNotNull()).select(*df.columns, "chapter_no", names.alias("chapter"))


def assign(df: DataFrame, playlist: str, track: str, columns=MEASURES) -> DataFrame:
    """Chapters filled in order, each with the best-scoring tracks still free.

    Five numbering passes per playlist, whatever its length; the rows left after each pass
    are written once so that the next one does not compute them again.
    """
    sizes = df.groupBy(playlist).agg(F.count("*").alias("_n"))
    quota = sizes.select(playlist, _quota(F.col("_n")).alias("_quota"))
    left, done = cut(df.join(quota, playlist)), None
    for i, name in enumerate(NAMES):
        seq = positions(left.withColumn("_score", chapter_score(i, columns)), [playlist], ["_score", track], "_place")
        rows = cut(seq.rows.drop("_score"))
        inside = F.col("_place") < F.element_at("_quota", i + 1)
        taken = rows.filter(inside).select(*df.columns, F.lit(i).alias("chapter_no"), F.lit(name).alias("chapter"))
        done = taken if done is None else done.unionByName(taken)
        left = rows.filter(~inside).select(*df.columns, "_quota")
    return done
