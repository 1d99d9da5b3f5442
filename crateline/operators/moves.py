"""Many moves inside long lists: shifts of stretches, put together pairwise.

A move takes one entry elsewhere and shifts the ones between by one, so it is a shift that
is constant on a few stretches of positions. Two such maps put together are one
again; the moves of a list meet in a balanced tree, the left half of which tells where the
entries named by the right half are when their turn comes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import binned

#: Moves put together one by one at a leaf of the tree; positions of a block that meets its stretches.
LEAF, BLOCK = 16, 64

Shifts = tuple[np.ndarray, np.ndarray]  # first positions of the stretches, ascending from 0, and the shift of each


def shifted(at: np.ndarray, shifts: Shifts) -> np.ndarray:
    starts, by = shifts
    return at + by[np.searchsorted(starts, at, "right") - 1]


def joined(first: Shifts, then: Shifts) -> Shifts:
    """``first``, then ``then``: cut where either changes, equal neighbours made one."""
    images = first[0] + first[1]
    order = np.argsort(images)
    back = shifted(then[0], (images[order], -first[1][order]))
    starts = np.union1d(first[0], back)
    here = shifted(starts, first)
    by = shifted(here, then) - starts
    kept = np.concatenate([[True], by[1:] != by[:-1]])
    return starts[kept], by[kept]


def leaf(rows: list[int], goals: list[int], size: int) -> Shifts:
    """A few moves one by one, the list held as stretches of first positions in their present order."""
    line = [(0, size)]
    for row, goal in zip(rows, goals):
        rest = [s for a, b in line for s in ([(a, row), (row + 1, b)] if a <= row < b else [(a, b)]) if s[0] < s[1]]
        line, at, placed = [], 0, False
        for a, b in rest:
            if not placed and at + b - a >= goal:
                line += [s for s in ((a, a + goal - at), (row, row + 1), (a + goal - at, b)) if s[0] < s[1]]
                placed = True
            else:
                line.append((a, b))
            at += b - a
        if not placed:
            line.append((row, row + 1))
    at, shifts = 0, []
    for a, b in line:
        shifts.append((a, at - a))
        at += b - a
    starts, by = zip(*sorted(shifts))
    return np.array(starts), np.array(by)


def together(rows: np.ndarray, goals: np.ndarray, size: int) -> Shifts:
    """All moves in order; ``rows`` are places before the first of them."""
    if len(rows) <= LEAF:
        return leaf(rows.tolist(), goals.tolist(), size)
    half = len(rows) // 2
    left = together(rows[:half], goals[:half], size)
    return joined(left, together(shifted(rows[half:], left), goals[half:], size))


def stretches(moves: DataFrame, by: str) -> DataFrame:
    """(``by``, start, stop, shift) from moves (``by``, row, place, size); the moves of one list are one task's work."""
    schema = T.StructType([moves.schema[by], *[T.StructField(c, T.LongType()) for c in ("start", "stop", "shift")]])

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([by, "row", "place"], ignore_index=True)
        rows, places, sizes = (frame[c].to_numpy(np.int64) for c in ("row", "place", "size"))
        firsts = np.flatnonzero(~frame[by].duplicated().to_numpy())
        found = []
        for a, b in zip(firsts, np.append(firsts[1:], len(frame))):
            starts, shift = together(rows[a:b], np.clip(places[a:b], 1, sizes[a]) - 1, int(sizes[a]))
            found.append((starts, np.append(starts[1:], sizes[a]), shift))
        names = frame[by].iloc[np.repeat(firsts, [len(f[0]) for f in found])].reset_index(drop=True)
        return pd.DataFrame({by: names} | {c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("start", "stop", "shift"))})

    # Lists share a call: one call each would cost more than the work.
    return binned(moves, by).groupBy("_bin").applyInPandas(work, schema)


def followed(entries: DataFrame, moves: DataFrame, by: str, pos: str, block: int = BLOCK) -> DataFrame:
    """``new_pos`` of every entry: stretches are cut at blocks of positions, an entry meets those of its block only.

    The work is linear in entries and moves times a logarithm, and a long list is many keys.
    """
    cuts = stretches(moves, by).withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    cuts = cuts.select(F.col(by).alias("_list"), "_block", "start", "stop", "shift")
    rows = entries.withColumn("_at", F.floor(F.col(pos) / block))
    on = (F.col(by) == F.col("_list")) & (F.col("_at") == F.col("_block")) & (F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("stop"))
    place = F.col(pos).cast("long") + F.coalesce("shift", F.lit(0))
    return rows.join(cuts, on, "left").select(*entries.columns, place.alias("new_pos"))
