"""Percentile ranks, composites of ranks and what is read from them."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp
from ..functions.formats import ENERGY_LABELS, UNKNOWN_ENERGY, decile, tempo_band
from ..plans.ordered import HOT_ROWS, positions
from ..plans.ranking import finite, quantiles, with_rank, with_ranks
from ..plans.session import cut

INGREDIENTS = ("energy_density", "energy_bass", "energy_bright", "energy_pulse")


def percentile_rank(df: DataFrame, column: str, out: str, by: Seq[str] = ()) -> DataFrame:
    """0..1 over the non-missing rows, ties at the mean, a lone value at 0.5."""
    return with_rank(df, column, out, by)


def weighted_mean(ranks: Seq[str], weights: Seq[float] | None = None) -> Column:
    """Mean of the ranks that are there; none gives NULL."""
    weights = weights or [1.0] * len(ranks)
    top = sum((F.coalesce(F.col(r) * w, F.lit(0.0)) for r, w in zip(ranks, weights)), F.lit(0.0))
    under = sum((F.when(F.col(r).isNotNull(), w).otherwise(0.0) for r, w in zip(ranks, weights)), F.lit(0.0))
    return F.when(under > 0, top / under)


def mix(df: DataFrame, columns: Seq[str], out: str, weights: Seq[float] | None = None, key: str | None = None) -> DataFrame:
    names = [f"_rank{i}" for i in range(len(columns))]
    ranked = with_ranks(df, dict(zip(names, columns)), key=key)
    return ranked.withColumn(out, weighted_mean(names, weights)).drop(*names)


def spread(df: DataFrame, columns: Seq[str], out: str, weights: Seq[float] | None = None, key: str | None = None) -> DataFrame:
    """Rank of the mix: uniform over the catalogue. The mix is read twice, so it is written once."""
    mixed = cut(mix(df, columns, "_mix", weights, key))
    return with_rank(mixed, "_mix", out, key=key).drop("_mix")


def energy(df: DataFrame, out: str = "energy", columns: Seq[str] = INGREDIENTS, key: str | None = None) -> DataFrame:
    return spread(df, columns, out, key=key)


def levels(df: DataFrame, columns: Seq[str], out: str) -> DataFrame:
    return spread(df, columns, "_spread").withColumn(out, decile("_spread")).drop("_spread")


def place_in_group(df: DataFrame, by: Seq[str], order: Seq[Column | str], out: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Position over n-1 inside a group, ties broken by the given order."""
    seq = positions(df, by, order, "_place", hot_rows)
    if seq.hot:
        sized = seq.rows.join(seq.rows.groupBy(*by).agg(F.count("*").alias("_n")), list(by))
    else:
        sized = seq.rows.dropna(subset=list(by)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return sized.withColumn(
        out, F.col("_place") / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_place", "_n")


def with_vibe(df: DataFrame, bpm: str = "bpm", level: str = "rms", out: str = "vibe") -> DataFrame:
    """Tempo band and loudness third of the catalogue."""
    cuts = quantiles(df, level, (0.33, 0.66))
    low, high = cuts.select(F.col("q")[0]).scalar(), cuts.select(F.col("q")[1]).scalar()
    label = (F.when(F.col(level).isNull(), UNKNOWN_ENERGY).when(F.col(level) <= low, ENERGY_LABELS[0])
             .when(F.col(level) <= high, ENERGY_LABELS[1]).otherwise(ENERGY_LABELS[2]))
    return df.withColumn(out, F.concat_ws("-", tempo_band(bpm), label))


# Diameters of a marker.
MIN_SIZE, MAX_SIZE, FLAT_SIZE = 4.0, 15.0, 7.0


def with_marker_size(df: DataFrame, column: str, out: str = "marker_size") -> DataFrame:
    value = finite(column)
    cuts = quantiles(df, value, (0.05, 0.95))
    low, high, known = (cuts.select(c).scalar() for c in (F.col("q")[0], F.col("q")[1], F.col("n")))
    share = F.coalesce(clamp((value - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0), F.lit(0.0))
    size = F.when((known < 2) | (high <= low), F.lit(FLAT_SIZE)).otherwise(MIN_SIZE + share * (MAX_SIZE - MIN_SIZE))
    return df.withColumn(out, size)


RANK_AXES = {"energy": 0.5, "valence_rank": 0.5}


def axis_guide(df: DataFrame, column: str) -> DataFrame:
    """Where the quadrant line of an axis runs: the middle of a rank, else the median."""
    if column in RANK_AXES:
        return df.limit(1).select(F.lit(RANK_AXES[column]).alias("guide"))
    return quantiles(df, column, (0.5,)).select(F.col("q")[0].alias("guide"))


def groove_span(df: DataFrame, column: str = "danceability") -> DataFrame:
    """First and ninth decile of the catalogue; 0..1 under twenty values or when flat."""
    cuts = quantiles(df, column, (0.1, 0.9))
    usable = (F.col("n") >= 20) & (F.col("q")[1] > F.col("q")[0])
    return cuts.select(F.when(usable, F.col("q")[0]).otherwise(0.0).alias("low"),
                       F.when(usable, F.col("q")[1]).otherwise(1.0).alias("high"))
