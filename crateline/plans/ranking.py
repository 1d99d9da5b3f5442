"""Tie-aware ranks through a table of distinct values.

Values are counted first (map-side partial aggregation makes a value shared by a third
of all rows one row per task), then the distinct values are cut into ranges at explicit
split points and counted up inside each range. No task sees all values.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 250_000
MAX_RANGES = 512


def finite(value: Column | str) -> Column:
    """NaN and infinities are no measure: NULL."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def split_points(df: DataFrame, columns: Seq[str]) -> dict[str, list[float]]:
    """Boundaries of ranges of about RANGE_ROWS rows per column, in one pass: at most MAX_RANGES numbers each."""
    shares = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    found = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
                   *[F.percentile_approx(c, shares, 4 * MAX_RANGES).alias(f"p{i}") for i, c in enumerate(columns)]
                   ).first()
    out = {}
    for i, column in enumerate(columns):
        parts = min(MAX_RANGES, (found[f"n{i}"] or 0) // RANGE_ROWS + 1)
        cuts = found[f"p{i}"] if parts > 1 else None
        out[column] = sorted({cuts[round(k * MAX_RANGES / parts) - 1] for k in range(1, parts)}) if cuts else []
    return out


def range_of(value: Column, points: list[float], base: int = 0) -> Column:
    """Index of the range a value falls in, as a balanced tree of comparisons."""
    if not points:
        return F.lit(base)
    middle = len(points) // 2
    return F.when(value < points[middle], range_of(value, points[:middle], base)).otherwise(
        range_of(value, points[middle + 1:], base + middle + 1)
    )


def cumulative(df: DataFrame, column: str, by: Seq[str] = (), points: list[float] | None = None) -> DataFrame:
    """One row per distinct value: how many rows share it, lie below it, and exist at all."""
    by = list(by)
    values = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_same"))
    points = split_points(df, [column])[column] if points is None else points
    values = values.withColumn("_range", range_of(F.col(column), points))
    totals = values.groupBy(*by, "_range").agg(F.sum("_same").alias("_in_range"))
    per_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = per_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_range",
        F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_base"),
        F.sum("_in_range").over(per_group).alias("_n"),
    )
    if not by:
        offsets = F.broadcast(offsets)  # at most MAX_RANGES rows
    inside = Window.partitionBy(*by, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_base") + F.coalesce(F.sum("_same").over(inside), F.lit(0))
    return values.join(offsets, [*by, "_range"]).select(*by, column, "_same", below.alias("_below"), "_n")


def value_ranks(df: DataFrame, column: str, by: Seq[str] = (), out: str = "rank",
                points: list[float] | None = None) -> DataFrame:
    """One row per distinct value with its percentile rank 0..1, ties sharing the mean."""
    rank = F.when(F.col("_n") == 1, F.lit(0.5)).otherwise(
        (F.col("_below") + (F.col("_same") - 1) / 2.0) / (F.col("_n") - 1))
    return cumulative(df, column, by, points).select(*by, column, rank.alias(out))


def quantiles(df: DataFrame, column: Column | str, shares: Seq[float], by: Seq[str] = (),
              out: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation, read off the counted values.

    One row (per group) with an array of the shares' values and the count ``n``; the
    built-in exact percentile would hold every distinct value in one task.
    """
    table = cumulative(df.select(*by, finite(column).alias("_v")), "_v", by)
    found = []
    for share in shares:
        at = F.lit(float(share)) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda i: (F.col("_below") <= i) & (i < F.col("_below") + F.col("_same"))
        a, b = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(high), F.col("_v")))
        found.append(a + (b - a) * F.max(at - low))
    named = [f.alias(f"_q{i}") for i, f in enumerate(found)]
    shaped = table.groupBy(*by).agg(*named, F.max("_n").alias("_n"))
    array = F.array(*[F.col(f"_q{i}") for i in range(len(shares))])
    return shaped.select(*by, F.when(F.col("_n").isNotNull(), array).alias(out),
                         F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n"))


def with_ranks(df: DataFrame, columns: dict[str, str], by: Seq[str] = (), key: str | None = None) -> DataFrame:
    """Add the percentile rank of each numeric column under its new name; missing stays missing.

    With ``key``, a column that is unique in ``df``, all columns are ranked as one table of
    (key, column, value) without missing values, and whole rows are joined once. Without it every
    value table reads ``df`` itself and whole rows are joined once per column.
    """
    if key is not None:
        return _ranked_by_key(df, columns, by, key)
    keys = {out: f"_v{i}" for i, out in enumerate(columns)}
    source = df.select(*df.columns, *[finite(c).alias(keys[out]) for out, c in columns.items()])
    points = split_points(source, list(keys.values()))
    joined = source
    for out in columns:
        values = df.select(*by, finite(columns[out]).alias(keys[out]))
        joined = joined.join(value_ranks(values, keys[out], by, out, points[keys[out]]), [*by, keys[out]], "left")
    return joined.select(*df.columns, *columns)


def _ranked_by_key(df: DataFrame, columns: dict[str, str], by: Seq[str], key: str) -> DataFrame:
    told = F.array(*[F.struct(F.lit(i).alias("_m"), finite(c).alias("_v")) for i, c in enumerate(columns.values())])
    long = df.select(F.col(key).alias("_key"), *by, F.inline(told)).filter(F.col("_v").isNotNull())
    ranked = long.join(value_ranks(long, "_v", [*by, "_m"], "_rank"), [*by, "_m", "_v"])
    wide = ranked.groupBy("_key").agg(*[F.max(F.when(F.col("_m") == i, F.col("_rank"))).alias(out) for i, out in enumerate(columns)])
    return df.join(wide, df[key] == wide["_key"], "left").select(*[df[c] for c in df.columns], *columns)


def with_rank(df: DataFrame, column: str, out: str, by: Seq[str] = (), key: str | None = None) -> DataFrame:
    return with_ranks(df, {out: column}, by, key)


def middle_values(df: DataFrame, column: Column | str, by: Seq[str] = (), out: str = "middle") -> DataFrame:
    """The element at index n // 2 of the sorted non-missing values, per group."""
    table = cumulative(df.select(*by, finite(column).alias("_v")), "_v", by)
    at = F.floor(F.col("_n") / 2)
    holds = (F.col("_below") <= at) & (at < F.col("_below") + F.col("_same"))
    return table.groupBy(*by).agg(F.max(F.when(holds, F.col("_v"))).alias(out))
