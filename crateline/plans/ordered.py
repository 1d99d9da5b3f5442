"""Positions, neighbours and running sums inside groups of any size.

A plain window sends one group to one task. That is fine while groups are small, and
it is the plan used then. When a group is larger than ``hot_rows`` it is numbered by a
range-partitioned sort instead, and later look-backs work on fixed blocks of positions:
each block carries copies of the few rows next to its edge, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, small

HOT_ROWS = 2_000_000
BLOCK = 65_536
# Rows that a task sorts in the mean, at most.
TASK_ROWS = 500_000


def _match(left: DataFrame, right: DataFrame, by: Seq[str], how: str = "inner") -> DataFrame:
    """Null-safe join on ``by``; keeps the left columns and the right's own ones."""
    renamed = right.select(*[F.col(c).alias(f"_key_{c}" if c in by else c) for c in right.columns])
    on = F.lit(True)
    for name in by:
        on = on & F.col(name).eqNullSafe(F.col(f"_key_{name}"))
    return left.join(renamed, on, how).drop(*[f"_key_{c}" for c in by])


def indexed(df: DataFrame, order: Seq[Column | str], out: str = "row_index") -> DataFrame:
    """0-based dense index of all rows along ``order``.

    Range sort, reliable checkpoint (so that partitions stay as they are), then the row
    number inside the partition plus the partition's offset. The offsets table has one
    row per partition.
    """
    placed = cut(df.orderBy(*order)).withColumn("_ix_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_ix_part", F.shiftright("_ix_id", 33)).withColumn(
        "_ix_at", F.col("_ix_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("_ix_part").agg(F.count("*").alias("_ix_rows"))
    before = Window.orderBy("_ix_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_ix_part", F.coalesce(F.sum("_ix_rows").over(before), F.lit(0)).alias("_ix_base"))
    return placed.join(F.broadcast(offsets), "_ix_part").select(
        *df.columns, (F.col("_ix_base") + F.col("_ix_at")).alias(out)
    )


def hot_keys(df: DataFrame, by: Seq[str], hot_rows: int) -> tuple[DataFrame | None, int, int]:
    """Groups above ``hot_rows`` and their number, at most rows / hot_rows of them, and the number of all rows."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    most, rows = sizes.agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) <= hot_rows:
        return None, 0, rows or 0
    found = cut(sizes.filter(F.col("_n") > hot_rows).select(*by))
    return found, found.count(), rows


def dealt(df: DataFrame, by: Seq[str], rows: int) -> DataFrame:
    """Whole groups in as many tasks as keep a task at about TASK_ROWS rows; few rows stay as the session deals them."""
    if rows <= TASK_ROWS:
        return df
    # A stated number: partitions are not put together again.
    return df.repartition(max(-(-rows // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def by_size(df: DataFrame, by: Seq[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups of at most ``hot_rows``, those of larger ones if there are any, and the number of all rows."""
    keys, found, rows = hot_keys(df, by, hot_rows)
    if not found:
        return df, None, rows
    keys = small(keys, found)
    return _match(df, keys, by, "left_anti"), _match(df, keys, by, "left_semi"), rows


@dataclass(frozen=True)
class Ordered:
    """Rows with a dense 0-based position ``pos`` inside the groups ``by``."""

    rows: DataFrame
    by: tuple[str, ...]
    pos: str
    hot: bool = False
    block: int = BLOCK

    def with_rows(self, rows: DataFrame) -> Ordered:
        return replace(self, rows=rows)

    def shifted(self, columns: dict[str, tuple[Column | str, int]]) -> Ordered:
        """Values of rows before (offset > 0) or after (offset < 0) each row."""
        offsets = [offset for _, offset in columns.values()]
        back, ahead = max([0, *offsets]), max([0, *(-o for o in offsets)])
        rows, keys = self.rows, list(self.by)
        if self.hot:
            here = F.floor(F.col(self.pos) / self.block)
            edge = F.pmod(F.col(self.pos), F.lit(self.block))
            rows = rows.withColumn(
                "_block",
                F.explode(
                    F.array_compact(
                        F.array(
                            here,
                            F.when(edge >= self.block - back, here + 1),
                            F.when(edge < ahead, here - 1),
                        )
                    )
                ),
            )
            keys.append("_block")
        window = Window.partitionBy(*keys).orderBy(self.pos)
        for name, (value, offset) in columns.items():
            value = F.col(value) if isinstance(value, str) else value
            rows = rows.withColumn(name, F.lag(value, offset).over(window) if offset > 0
                                   else F.lead(value, -offset).over(window))
        if self.hot:
            rows = rows.filter(F.col("_block") == F.floor(F.col(self.pos) / self.block)).drop("_block")
        return self.with_rows(rows)

    def running_sum(self, value: Column | str, out: str) -> Ordered:
        """Sum from the first row of the group up to and including this one."""
        value = F.col(value) if isinstance(value, str) else value
        upto = (Window.unboundedPreceding, Window.currentRow)
        if not self.hot:
            window = Window.partitionBy(*self.by).orderBy(self.pos).rowsBetween(*upto)
            return self.with_rows(self.rows.withColumn(out, F.sum(value).over(window)))
        keys = [*self.by, "_block"]
        rows = self.rows.withColumn("_block", F.floor(F.col(self.pos) / self.block)).withColumn("_value", value)
        totals = rows.groupBy(*keys).agg(F.sum("_value").alias("_total"))
        earlier = Window.partitionBy(*self.by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
        inside = Window.partitionBy(*keys).orderBy(self.pos).rowsBetween(*upto)
        rows = rows.withColumn("_inside", F.sum("_value").over(inside))
        joined = _match(rows, offsets, keys)
        return self.with_rows(
            joined.withColumn(out, F.col("_base") + F.col("_inside")).drop("_block", "_value", "_inside", "_base")
        )


def positions(
    df: DataFrame,
    by: Seq[str],
    order: Seq[Column | str],
    pos: str = "pos",
    hot_rows: int | None = HOT_ROWS,
    block: int = BLOCK,
) -> Ordered:
    """Number the rows of every group along ``order`` (end it with a unique column).

    ``hot_rows=None`` says that all groups are known to be small: they are not counted, and stay where they are.
    """
    by = list(by)
    if not by:
        return Ordered(indexed(df, order, pos), (), pos, True, block)
    window = Window.partitionBy(*by).orderBy(*order)
    if hot_rows is None:
        return Ordered(df.withColumn(pos, F.row_number().over(window).cast("long") - 1), tuple(by), pos, False, block)
    keys, found, rows = hot_keys(df, by, hot_rows)
    if not found:
        return Ordered(dealt(df, by, rows).withColumn(pos, F.row_number().over(window).cast("long") - 1), tuple(by), pos, False, block)
    cold = dealt(_match(df, small(keys, found), by, "left_anti"), by, rows).withColumn(pos, F.row_number().over(window).cast("long") - 1)
    warm = indexed(_match(df, small(keys, found), by, "left_semi"), [*by, *order], "_index")
    starts = warm.groupBy(*by).agg(F.min("_index").alias("_start"))
    warm = _match(warm, small(starts, found), by).select(*df.columns, (F.col("_index") - F.col("_start")).alias(pos))
    return Ordered(cold.unionByName(warm), tuple(by), pos, True, block)


def already_ordered(df: DataFrame, by: Seq[str], pos: str, hot_rows: int = HOT_ROWS, block: int = BLOCK) -> Ordered:
    """Wrap rows that already carry a dense 0-based position."""
    by = list(by)
    hot = not by or hot_keys(df, by, hot_rows)[1] > 0
    return Ordered(df, tuple(by), pos, hot, block)


def runs(seq: Ordered, value: Column | str, out: str = "run") -> Ordered:
    """Number consecutive rows of equal (null-safe) value."""
    value = F.col(value) if isinstance(value, str) else value
    named = seq.with_rows(seq.rows.withColumn("_v", value))
    named = named.shifted({"_before": ("_v", 1)})
    change = F.when((F.col(seq.pos) > 0) & F.col("_v").eqNullSafe(F.col("_before")), 0).otherwise(1)
    numbered = named.with_rows(named.rows.withColumn("_change", change)).running_sum("_change", out)
    return numbered.with_rows(numbered.rows.drop("_v", "_before", "_change"))
