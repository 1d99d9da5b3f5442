"""Smooth orders of groups that no task could hold the pairs of.

Rows are pieces of a path. In each round every piece names the cheapest step from one of its ends to
the end of another piece, among the nearest ends of each end; where two pieces name the same
step they become one. When few pieces are left they are put in a line, and then stretches
inside blocks of the line are turned around as long as that shortens the way. Nearest ends are found in
blocks of products, pieces grow by joins, and no task sees more than one block or the last pieces' ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.products import Scorer, best_rows
from ..plans.session import stored
from .cost import Weights, pair_cost, pair_costs
from .neighbours import _facts, points_of

#: Ends that each end may step to; pieces of a group that are put in a line at once; rows of a block that is smoothed.
NEAREST, LAST_PIECES, BLOCK = 8, 500, 512


def points_in(frame: pd.DataFrame):
    return points_of(pa.Table.from_pandas(frame[["vec", "tempo", "number", "mode"]], preserve_index=False))


def _step_scorer(weights: Weights) -> Scorer:
    """The mean of a step there and back, between ends of one group and two pieces, never from its start to its end."""
    def facts(table):
        column = lambda c: np.asarray(table[c].combine_chunks() if isinstance(table, pa.Table) else table[c])
        return points_of(table), column("grp"), column("piece"), np.asarray(column("tip"), dtype=np.int64)

    def price(asks, rows, part):
        points = rows[0].part(part)
        cost = (pair_costs(asks[0], points, weights) + pair_costs(points, asks[0], weights).T) / 2
        closing = asks[3][:, None] + rows[3][part][None, :] == 3  # a start's piece and an end's
        cost[(asks[1][:, None] != rows[1][part][None, :]) | (asks[2][:, None] == rows[2][part][None, :]) | closing] = np.inf
        return cost

    return Scorer(facts, facts, price)


def _ends(line: DataFrame) -> DataFrame:
    """Rows at a free end of their piece: a start or an end is joined on one side only."""
    outer = (F.col("pos") == 0) | (F.col("pos") == F.col("len") - 1)
    return line.filter(outer & ((F.col("len") == 1) | ~(F.col("is_start") | F.col("is_end"))))


def _steps(line: DataFrame, facts: DataFrame, nearest: int, weights: Weights) -> DataFrame:
    """``u, v, cost`` with u < v: steps from every free end to the nearest free ends of other pieces."""
    ends = stored(_ends(line).select("node", "grp", "piece", "tip").join(facts, "node").withColumn("id", F.col("node")))
    found = best_rows(ends, ends.withColumnRenamed("node", "ask"), _step_scorer(weights), nearest)
    return stored(found.select(F.least("ask", "id").alias("u"), F.greatest("ask", "id").alias("v"), "cost").distinct())


def _joined(line: DataFrame, steps: DataFrame) -> DataFrame:
    """The pieces after one round."""
    ends = _ends(line).select("node", "piece", "pos", "len", "tip")
    side = lambda c: ends.select(*[F.col(x).alias(f"{c}_{x}" if x != "node" else c) for x in ends.columns])
    open_ = steps.join(side("u"), "u").join(side("v"), "v").filter((F.col("u_piece") != F.col("v_piece")) & (F.col("u_tip") + F.col("v_tip") != 3))
    open_ = stored(open_.withColumn("step", F.struct("cost", "u", "v")))
    named = open_.select(F.explode(F.array("u_piece", "v_piece")).alias("piece"), "step").groupBy("piece").agg(F.min("step").alias("step"))
    mutual = named.groupBy("step").agg(F.count("*").alias("n")).filter("n = 2").select("step")
    chosen = open_.join(mutual, "step")
    # The piece of u comes first and ends with u; the piece of v follows and begins with v.
    first = F.struct(F.col("u_piece").alias("piece"), (F.col("u_pos") == 0).alias("flip"), F.lit(0).cast("long").alias("after"))
    then = F.struct(F.col("v_piece").alias("piece"), (F.col("v_pos") != 0).alias("flip"), F.col("u_len").alias("after"))
    moves = chosen.select(F.inline(F.array(F.struct(first.alias("m"), F.col("u_piece").alias("to"), (F.col("u_len") + F.col("v_len")).alias("whole"), (F.col("u_tip") + F.col("v_tip")).alias("tips")),
                                           F.struct(then.alias("m"), F.col("u_piece").alias("to"), (F.col("u_len") + F.col("v_len")).alias("whole"), (F.col("u_tip") + F.col("v_tip")).alias("tips")))))
    moves = moves.select("m.piece", "m.flip", "m.after", "to", "whole", "tips")
    turned = F.when(F.col("flip"), F.col("len") - 1 - F.col("pos")).otherwise(F.col("pos"))
    after = line.join(moves, "piece", "left").select(
        "node", "grp", "is_start", "is_end", F.coalesce("to", "piece").alias("piece"), F.coalesce(F.col("after") + turned, F.col("pos")).alias("pos"),
        F.coalesce("whole", "len").alias("len"), F.coalesce("tips", "tip").alias("tip"))
    return stored(after)


def _in_line(frame: pd.DataFrame, weights: Weights) -> pd.DataFrame:
    """Pieces of one group one after the other, from the start's, the end's last: ``piece, flip, offset``; a row per piece and end."""
    heads, tails = (frame[frame["at"] == x].sort_values("piece").reset_index(drop=True) for x in ("head", "tail"))
    n = len(heads)
    ends = points_in(pd.concat([heads, tails], ignore_index=True))
    cost = pair_costs(ends, ends, weights)
    tip, flips = heads["tip"].to_numpy(), np.zeros(n, bool)
    start = int(np.flatnonzero(tip == 1)[0])
    flips[start] = not heads["is_start"].iloc[start]
    line, free = [start], np.ones(n, bool)
    free[start] = False
    while free.any():
        at = line[-1] + (0 if flips[line[-1]] else n)  # the row of the open end
        onward = np.where(np.tile(free & ((tip != 2) | (free.sum() == 1)), 2), cost[at], np.inf)
        # The end's piece is entered where the end does not stand.
        last = np.flatnonzero(tip == 2)
        for p in last:
            onward[p if heads["is_end"].iloc[p] and heads["len"].iloc[p] > 1 else p + n] = np.inf
        best = int(onward.argmin())
        line.append(best % n)
        flips[best % n], free[best % n] = best >= n, False
    lengths = heads["len"].to_numpy()[line]
    return pd.DataFrame({"piece": heads["piece"].to_numpy()[line], "flip": flips[line], "offset": np.cumsum(lengths) - lengths})


def long_orders(groups: DataFrame, by: str, weights: Weights, turn, nearest: int = NEAREST, last: int = LAST_PIECES, block: int = BLOCK) -> DataFrame:
    """``by, id, place, cost`` for groups (by, ord, id, vec, bpm, camelot, is_start, is_end) of any size.

    The order begins with ``is_start`` (or the first row by ``ord``) and ends with ``is_end`` if there is one.
    ``turn(costs, route)`` gives a shorter route with the same two ends.
    """
    told = stored(groups.withColumn("node", F.monotonically_increasing_id()))
    mark = lambda c: F.min(F.when(F.col(c), F.struct("ord", "id", "node")))["node"]
    tips = told.groupBy(by).agg(F.coalesce(mark("is_start"), F.min(F.struct("ord", "id", "node"))["node"]).alias("_s"), mark("is_end").alias("_e"), F.min("node").alias("grp"))
    placed = told.join(tips, by).withColumns({
        "is_start": F.col("node") == F.col("_s"), "is_end": F.coalesce((F.col("node") == F.col("_e")) & (F.col("_e") != F.col("_s")), F.lit(False))})
    facts = stored(placed.select("node", *_facts()))
    tip = F.when(F.col("is_start"), 1).when(F.col("is_end"), 2).otherwise(0)
    line = stored(placed.select("node", "grp", "is_start", "is_end", F.col("node").alias("piece"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("len"), tip.alias("tip")))
    def pieces(line: DataFrame) -> tuple[int, int]:
        """All pieces, and the most of one group."""
        told = line.groupBy("grp").agg(F.count_if(F.col("pos") == 0).alias("n")).agg(F.sum("n"), F.max("n")).first()
        return told[0] or 0, told[1] or 0

    total, most = pieces(line)
    fresh, steps = False, None
    while most > last:
        if steps is None:  # the nearest ends of the ends that are left
            fresh, steps = True, _steps(line, facts, nearest, weights)
        line = _joined(line, steps)
        before, (total, most) = total, pieces(line)
        if total == before:
            if fresh:
                break
            steps = None
        fresh = False
    ends = line.select("*", F.explode(F.array_compact(F.array(F.when(F.col("pos") == 0, F.lit("head")), F.when(F.col("pos") == F.col("len") - 1, F.lit("tail"))))).alias("at")).join(facts, "node")
    rank = ends.groupBy("grp").applyInPandas(lambda frame: _in_line(frame, weights), "piece long, flip boolean, offset long")
    own = F.when(F.col("flip"), F.col("len") - 1 - F.col("pos")).otherwise(F.col("pos"))
    route = stored(line.join(rank, "piece").select("node", "grp", (F.col("offset") + own).alias("place")).join(facts, "node"))
    for shift in (0, block // 2):
        def smooth(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("place")
            points = points_in(frame)
            way = turn(pair_costs(points, points, weights), np.arange(len(frame)))
            return pd.DataFrame({"node": frame["node"].to_numpy()[way], "place": frame["place"].to_numpy()})

        blocks = route.withColumn("block", F.floor((F.col("place") + shift) / block))
        better = stored(blocks.groupBy("grp", "block").applyInPandas(smooth, "node long, place long"))
        route = route.drop("place").join(better, "node")
    final = stored(route.select("node", "grp", "place").join(told, "node"))
    before = final.select(F.col("grp").alias("_g"), (F.col("place") + 1).alias("_p"), *[F.col(c).alias(f"_b_{c}") for c in ("vec", "bpm", "camelot")])
    cost = pair_cost("_b_vec", "vec", "_b_bpm", "bpm", "_b_camelot", "camelot", weights)
    met = final.join(before, (F.col("grp") == F.col("_g")) & (F.col("place") == F.col("_p")), "left")
    return met.select(by, "id", "place", F.when(F.col("_p").isNotNull(), cost).alias("cost"))
