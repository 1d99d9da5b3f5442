"""Boundaries from beat features: novelty, peaks, local beat grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import Ordered, positions
from .segments import points_in

# Half size of the kernel, spacing, distance to the edges, height over the mean, bins of the grid.
KERNEL_HALF, MIN_GAP, EDGE_GAP, PEAK_DELTA = 16, 16, 4, 0.1
GRID_BINS, GRID_SPAN = 192, 16
RISE, FALL, LABEL_BEATS = 1.15, 0.87, 8
BLOCK_BEATS = 4_096


def _profile(half: int) -> np.ndarray:
    """The checkerboard kernel is the outer product of this profile with itself."""
    axis = np.arange(-half, half + 1)
    return np.sign(axis) * np.exp(-0.5 * (axis / (half / 2.0)) ** 2)


def novelty(beats: Ordered, features: str = "features") -> DataFrame:
    """Checkerboard novelty along the diagonal of the self-similarity, 0..1 per track.

    The kernel is separable, so the correlation at a beat is the squared length of the
    profile-weighted sum of the features around it; no similarity matrix is formed. Beats are
    worked in blocks that carry their neighbours, so a long track is many tasks.
    """
    by = list(beats.by)
    sizes = beats.rows.groupBy(*by).agg(F.count("*").alias("_n"))
    half = F.least(F.lit(KERNEL_HALF), F.floor((F.col("_n") - 1) / 2)).cast("int")
    rows = beats.rows.join(sizes, by).withColumn("_half", half).filter(F.col("_half") >= 2)
    here = F.floor(F.col(beats.pos) / BLOCK_BEATS)
    edge = F.pmod(F.col(beats.pos), F.lit(BLOCK_BEATS))
    copies = F.array_compact(F.array(here, F.when(edge >= BLOCK_BEATS - KERNEL_HALF, here + 1), F.when(edge < KERNEL_HALF, here - 1)))
    rows = rows.select(*by, F.col(beats.pos).alias("beat"), F.col(features).alias("features"), "_n", "_half", F.explode(copies).alias("_block"))
    kept = [f for f in rows.select(*by).schema]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["beat long", "raw double"])

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("beat")
        beat, n, h = frame["beat"].to_numpy(), int(frame["_n"].iloc[0]), int(frame["_half"].iloc[0])
        values = np.vstack(frame["features"].to_numpy()).astype(float)
        own = np.flatnonzero(beat // BLOCK_BEATS == frame["_block"].iloc[0])
        profile, total = _profile(h), 0.0
        for offset, weight in zip(range(-h, h + 1), profile):
            at = np.clip(beat[own] + offset, 0, n - 1) - beat[0]
            total = total + weight * values[at]
        out = frame.iloc[own][by + ["beat"]]
        return out.assign(raw=(total ** 2).sum(axis=1))

    raw = rows.groupBy(*by, "_block").applyInPandas(work, schema)
    peaks = raw.groupBy(*by).agg(F.max("raw").alias("_peak"))
    return raw.join(peaks, by).select(*by, "beat", F.when(F.col("_peak") > 0, F.col("raw") / F.col("_peak")).otherwise(0.0).alias("novelty"))


def _around(seq: Ordered, value: str, back: int, ahead: int) -> tuple[Ordered, list[str]]:
    names = {f"_w{o}": (value, -o) for o in range(-back, ahead + 1) if o}
    return seq.shifted(names), [*names, value]


def peaks(curve: Ordered, value: str = "novelty") -> DataFrame:
    """Local maxima above the mean around them, at least the gap apart, away from the edges.

    Candidates further apart than the gap do not depend on each other, so the left-to-right
    choice runs inside short islands of candidates.
    """
    by = list(curve.by)
    seq, names = _around(curve, value, MIN_GAP, MIN_GAP - 1)
    near = [n for n in names if n == value or -(MIN_GAP // 2) <= int(n[2:]) < MIN_GAP // 2]
    top = F.greatest(*[F.col(n) for n in near])
    known = F.array_compact(F.array(*[F.col(n) for n in names]))
    mean = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    sizes = curve.rows.groupBy(*by).agg(F.count("*").alias("_n"))
    found = seq.rows.filter((F.col(value) >= top) & (F.col(value) >= mean + PEAK_DELTA)).select(*by, F.col(curve.pos).alias("beat"), value)
    order = positions(found, by, ["beat"], "_at").shifted({"_prev": ("beat", 1)})
    island = order.running_sum(F.when(F.col("beat") - F.col("_prev") <= MIN_GAP, 0).otherwise(1), "_island").rows
    lists = island.groupBy(*by, "_island").agg(F.sort_array(F.collect_list("beat")).alias("_beats"))
    chosen = F.aggregate("_beats", F.expr("cast(array() as array<bigint>)"), lambda out, b: F.when(
        (F.size(out) == 0) | (b - F.element_at(out, -1) > MIN_GAP), F.concat(out, F.array(b))).otherwise(out))
    kept = lists.select(*by, F.explode(chosen).alias("beat"))
    last = F.col("_n") - 1
    return (kept.join(found, [*by, "beat"]).join(sizes, by)
            .filter((F.col("beat") >= EDGE_GAP) & (F.col("beat") <= last - EDGE_GAP)).select(*by, "beat", F.col(value).alias("confidence")))


def boundary_labels(marks: DataFrame, levels: Ordered, value: str = "rms") -> DataFrame:
    """Rise, Fall or Shift from the mean level of the eight beats before and from the mark on."""
    by = list(levels.by)
    offsets = F.explode(F.sequence(F.lit(-LABEL_BEATS), F.lit(LABEL_BEATS - 1)))
    asked = marks.select(*by, "beat", offsets.alias("_o")).withColumn(levels.pos, F.col("beat") + F.col("_o"))
    met = asked.join(levels.rows.select(*by, levels.pos, value), [*by, levels.pos])
    means = met.groupBy(*by, "beat").agg(F.avg(F.when(F.col("_o") < 0, F.col(value))).alias("b"), F.avg(F.when(F.col("_o") >= 0, F.col(value))).alias("a"))
    ratio = F.col("a") / F.col("b")
    label = (F.when(F.col("a").isNull() | F.col("b").isNull(), "Shift").when(F.col("b") <= 0, F.when(F.col("a") > 0, "Rise").otherwise("Shift"))
             .when(ratio >= RISE, "Rise").when(ratio <= FALL, "Fall").otherwise("Shift"))
    return marks.join(means.select(*by, "beat", label.alias("label")), [*by, "beat"], "left").withColumn("label", F.coalesce("label", F.lit("Shift")))


def snap(marks: DataFrame, envelope: DataFrame, by: str = "track", width: float = 30.0) -> DataFrame:
    """Every (track, mark, time, period) on the strongest phase of the beat around it."""
    half = F.col("period") * GRID_SPAN
    spans = marks.filter(F.col("period") > 0).withColumn("start", F.col("time") - half).withColumn("end", F.col("time") + half)
    met = points_in(spans, envelope, by, width, closed=True)
    turn = F.pmod(F.col("t") - F.col("start"), F.col("period")) / F.col("period")
    bins = F.pmod(F.floor(turn * GRID_BINS), F.lit(GRID_BINS))
    folded = met.groupBy(by, "mark", "time", "period", bins.alias("_bin")).agg(F.sum("env").alias("_sum"))
    best = folded.groupBy(by, "mark", "time", "period").agg(F.max(F.struct("_sum", (-F.col("_bin")).alias("_minus"))).alias("_top"))
    phase = (0.5 - F.col("_top._minus")) / GRID_BINS * F.col("period") + F.col("time") - F.col("period") * GRID_SPAN
    snapped = F.col("_phase") + F.bround((F.col("time") - F.col("_phase")) / F.col("period"), 0) * F.col("period")
    placed = best.withColumn("_phase", phase).select(by, "mark", snapped.alias("snapped"))
    return marks.join(placed, [by, "mark"], "left").withColumn("snapped", F.coalesce("snapped", "time"))
