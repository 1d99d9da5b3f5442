"""Exact nearest neighbours and near pairs of unit vectors, by a tree of pivots.

Every vector belongs to the cell of its nearest pivot, and inside the cell to the tile of the
nearest of the cell's own pivots; there are as many tiles as keep them at about TILE_ROWS rows, and
about as many cells as tiles of one cell. For a search radius r a query only has to visit what these bounds allow,
in cells and then in tiles: with d the distance to a pivot and d0 the distance to the nearest one of the same
level, no vector of the pivot is closer than (d - d0) / 2, nor closer than d less the distance of
the pivot's farthest vector. The first pass looks only into the home tile and so finds a radius that holds k
neighbours; the second pass visits the other tiles that radius reaches, and each of them gets the query's vector once. Tiles
are cut into blocks of bounded size on both sides, so a tile of many copies becomes many equal
tasks. Pivots are a sample by hash; they change the speed, never the result.

Vectors without structure reach most tiles. Where a query would visit more than ``VISITS`` tiles in the
mean, all blocks of rows meet all blocks instead (``all_pairs``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit
from . import all_pairs
from .session import cut

BLOCK_ROWS = 4_096
TILE_ROWS = 1_000
# Up to so many tiles one level of pivots is enough, and there are never more cells.
FLAT_TILES, MAX_PIVOTS = 64, 1_024
# Queries whose visits are listed at once.
LISTED = 512
# Tiles that a query may visit in the mean.
VISITS = 24
# Slack on the bound, against rounding.
SLACK = 1e-6


def pick_pivots(points: DataFrame, wanted: int) -> np.ndarray:
    """``wanted`` vectors, never more than MAX_PIVOTS, chosen by hash."""
    keep = points.orderBy(F.xxhash64("id")).limit(min(MAX_PIVOTS, max(1, wanted))).select("unit").collect()
    return np.array([r["unit"] for r in keep], dtype=np.float64)


def _stack(values: pd.Series) -> np.ndarray:
    return np.vstack(values.to_numpy()).astype(np.float64)


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def in_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the home cell and the distance to its pivot."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                away = _distances(_stack(batch["unit"]), pivots)
                yield batch.assign(cell=away.argmin(axis=1), away=away.min(axis=1))

    return points.mapInPandas(place, _schema(points) + ",cell:long,away:double")


def _schema(df: DataFrame) -> str:
    return df.schema.simpleString()[7:-1]


def _reached(away: np.ndarray, farthest: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether each query's radius may reach a vector of each pivot of one level."""
    bound = np.maximum((away - away.min(axis=1, keepdims=True)) / 2.0, away - farthest)
    return bound <= radius[:, None] + SLACK


def _holding(away: np.ndarray, farthest: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each query surely has k vectors: those of whole pivots. 4 if there are not so many."""
    whole = away + farthest
    order = np.argsort(whole, axis=1)
    enough = np.cumsum(rows[order], axis=1) >= k
    first = np.take_along_axis(whole, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
    return np.where(enough.any(axis=1), first, 4.0)


@dataclass(frozen=True)
class Tree:
    """Points with their cell and tile; the cells' pivots, farthest distances and rows; the tiles (cell, id, unit, farthest, rows), None where tiles are cells."""

    placed: DataFrame
    pivots: np.ndarray
    farthest: np.ndarray
    rows: np.ndarray
    tiles: DataFrame | None

    def bounded(self, queries: DataFrame, k: int) -> DataFrame:
        """Queries with a ``radius`` that surely holds k vectors beside the query itself."""
        pivots, farthest, rows = self.pivots, self.farthest, self.rows

        def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(radius=_holding(_distances(_stack(batch["unit"]), pivots), farthest, rows, k + 1))

        schema = _schema(queries) + ",radius double"
        known = queries.mapInPandas(top, schema)
        if self.tiles is None:
            return known

        def inside(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return q.head(0)
            told = _holding(_distances(_stack(q["unit"]), _stack(p["unit"])), p["farthest"].to_numpy(), p["rows"].to_numpy(), k + 1)
            return q.assign(radius=np.minimum(q["radius"], told))

        listed = known.columns
        return _meet(known, self.tiles, "cell", lambda q, p: inside(q, p)[listed], schema, whole=True)

    def _in_cells(self, queries: DataFrame) -> DataFrame:
        """One row per query and cell its ``radius`` may reach."""
        pivots, farthest = self.pivots, self.farthest

        def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for start in range(0, len(whole), LISTED):
                    batch = whole.iloc[start:start + LISTED]
                    hit = _reached(_distances(_stack(batch["unit"]), pivots), farthest, batch["radius"].to_numpy())
                    row, cell = np.nonzero(hit)
                    yield batch.iloc[row].assign(cell=cell.astype(np.int64))

        return queries.mapInPandas(reach, _schema(queries))

    def visits(self, queries: DataFrame) -> DataFrame:
        """One row per query and tile its ``radius`` may reach, but for the home tile."""
        home = queries.withColumn("home", F.col("tile"))
        in_cell = self._in_cells(home)
        if self.tiles is None:
            return in_cell.withColumn("tile", F.col("cell")).filter(F.col("tile") != F.col("home")).drop("home")

        def inside(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return q.head(0)
            p = p.sort_values("id")
            hit = _reached(_distances(_stack(q["unit"]), _stack(p["unit"])), p["farthest"].to_numpy(), q["radius"].to_numpy())
            row, tile = np.nonzero(hit)
            return q.iloc[row].assign(tile=p["id"].to_numpy()[tile])

        listed = home.columns  # as the function gives them back
        told = _meet(in_cell.select(*listed), self.tiles, "cell", lambda q, p: inside(q, p)[listed], _schema(home))
        return told.filter(F.col("tile") != F.col("home")).drop("home")

    def wide(self, queries: DataFrame) -> bool:
        """Whether the ``radius`` of queries reaches more than VISITS tiles in the mean, counted without a row for each visit."""
        pivots, farthest, flat = self.pivots, self.farthest, self.tiles is None

        def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"hits": [int(_reached(_distances(_stack(batch["unit"]), pivots), farthest, batch["radius"].to_numpy()).sum())], "asked": len(batch)})

        hits, asked = queries.select("unit", "radius").mapInPandas(reach, "hits long, asked long").agg(F.sum("hits"), F.sum("asked")).first()
        if not asked or flat or hits > VISITS * asked:
            return bool(asked) and hits > VISITS * asked

        def inside(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(p):
                return pd.DataFrame({"hits": []})
            return pd.DataFrame({"hits": [int(_reached(_distances(_stack(q["unit"]), _stack(p["unit"])), p["farthest"].to_numpy(), q["radius"].to_numpy()).sum())]})

        told = _meet(self._in_cells(queries.select("id", "unit", "cell", "radius")), self.tiles, "cell", inside, "hits long")
        return (told.agg(F.sum("hits")).first()[0] or 0) > VISITS * asked


def grow(points: DataFrame, rows: int) -> Tree:
    """A tree over points (``id``, ``unit`` and whatever else they carry)."""
    wanted = -(-rows // TILE_ROWS)
    flat = wanted <= FLAT_TILES
    pivots = pick_pivots(points, wanted if flat else int(np.ceil(np.sqrt(wanted))))
    celled = cut(in_cells(points, pivots))
    farthest, held = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for row in celled.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).collect():  # MAX_PIVOTS rows
        farthest[row["cell"]], held[row["cell"]] = row["far"], row["n"]
    if flat:
        return Tree(celled.drop("away").withColumn("tile", F.col("cell")), pivots, farthest, held, None)
    # A vector is a pivot of its cell by its hash, one in TILE_ROWS of the vectors that differ; a cell's own pivot is one too.
    chosen = celled.filter(F.pmod(F.xxhash64("unit"), F.lit(TILE_ROWS)) == 0).select("cell", "unit").distinct()
    own = points.sparkSession.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "cell long, unit array<double>")
    named = cut(chosen.union(own).withColumn("id", F.monotonically_increasing_id()))
    listed = celled.drop("away").columns
    kinds = dict(celled.dtypes)

    def nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return q[listed].head(0).assign(tile=0, away=0.0)
        p = p.sort_values("id")
        away = _distances(_stack(q["unit"]), _stack(p["unit"]))
        return q[listed].assign(tile=p["id"].to_numpy()[away.argmin(axis=1)], away=away.min(axis=1))

    schema = ",".join(f"{c} {kinds[c]}" for c in listed) + ",tile long,away double"
    tiled = cut(_meet(celled, named, "cell", nearest, schema, whole=True))
    far = tiled.groupBy("tile").agg(F.max("away").alias("farthest"), F.count("*").alias("rows"))
    tiles = cut(named.join(far, named["id"] == far["tile"]).select("cell", "id", "unit", "farthest", "rows"))
    return Tree(tiled.drop("away"), pivots, farthest, held, tiles)


def _meet(queries: DataFrame, points: DataFrame, key: str, match: Callable, schema: str, whole: bool = False) -> DataFrame:
    """Bring every query block together with every point block of its key; with ``whole``, with all points of it at once."""
    rows = F.lit(1) if whole else F.ceil(F.count("*") / BLOCK_ROWS)
    blocks = points.groupBy(key).agg(rows.cast("int").alias("blocks"))
    asked = queries.groupBy(key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("q_blocks"))
    plan = cut(blocks.join(asked, key))  # one row for each cell or tile that is asked
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    theirs = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    left = theirs.join(plan, key).withColumn("q_block", mine("q_blocks")).withColumn("p_block", spread("blocks"))
    own = points.select(*[F.col(c).alias(c) for c in points.columns])  # fresh columns for the self join
    right = own.join(plan, key).withColumn("p_block", mine("blocks")).withColumn("q_block", spread("q_blocks"))
    keys = [key, "q_block", "p_block"]
    # Products are heavy for their bytes: keep the configured number of tasks.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return (left.drop("blocks", "q_blocks").groupBy(*keys)
            .cogroup(right.drop("blocks", "q_blocks").groupBy(*keys)).applyInPandas(match, schema))


def _best_k(k: int, counted=None) -> Callable:
    def match(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        if counted is not None:
            counted.add(len(q) * len(p))
        scores = _stack(q["unit"]) @ _stack(p["unit"]).T
        ids, others = q["id"].to_numpy(), p["id"].to_numpy()
        scores[ids[:, None] == others[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(others, scores.shape), -scores), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(q)), order.shape[1])
        out = pd.DataFrame({"id": ids[rows], "other": others[order.ravel()], "cosine": scores[rows, order.ravel()]})
        return out[np.isfinite(out["cosine"])]

    return match


def units(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.filter(F.col(vec).isNotNull()).select(F.col("id").cast("long").alias("id"), unit(vec).alias("unit"))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """Best k others per id; each task keeps k per id before the shuffle."""
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def knn_join(df: DataFrame, k: int, vec: str = "vec", counted=None) -> DataFrame:
    """The k nearest others of every row by cosine: id, other, cosine, place. Rows without a vector are left out.

    ``counted`` may be an accumulator, to which the number of products is added.
    """
    points = cut(units(df, vec))
    count = points.count()
    tree = grow(points, count)
    schema = "id long, other long, cosine double"
    home = cut(top_k(_meet(tree.placed, tree.placed, "tile", _best_k(k, counted), schema), k))
    bound = home.groupBy("id").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).filter(F.col("n") >= k)
    radius = F.when(F.col("least").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("least"))))
    asking = cut(tree.placed.join(bound, "id", "left").select("id", "unit", "cell", "tile", radius.alias("radius"), "least"))
    # Rows with fewer than k neighbours at home take their bound from the tiles around.
    lone = cut(tree.bounded(asking.filter(F.col("radius").isNull()).drop("radius", "least"), k)).withColumn("least", F.lit(None).cast("double"))
    asking = asking.filter(F.col("radius").isNotNull()).unionByName(lone)
    if tree.wide(asking):
        met = all_pairs.meet_all(asking.select("id", "unit", "least"), points, count, all_pairs.best_others(k, counted), schema)
        return cut(top_k(met, k))
    away = _meet(cut(tree.visits(asking.drop("least")).drop("radius", "cell")), tree.placed, "tile", _best_k(k, counted), schema)
    return cut(top_k(home.drop("place").unionByName(away), k))


def first_twins(df: DataFrame, least: float, by: str | None = None, vec: str = "vec", order: str = "pos",
                ignore: str | None = None) -> DataFrame:
    """For every row the first earlier row (inside its group) with cosine at or above ``least``.

    Exact copies are folded first, so a group of copies costs one vector, and the output is
    one row per later twin, never all pairs. Rows of the same ``ignore`` value do not count.
    """
    group = F.col(by) if by else F.lit(0).cast("long")
    kind = F.col(ignore) if ignore else F.lit(None).cast("string")
    rows = df.filter(F.col(vec).isNotNull()).select(group.cast("long").alias("grp"), F.col(order).cast("long").alias("at"), kind.cast("string").alias("kind"),
                     unit(vec).alias("unit"))
    rows = rows.withColumn("fold", F.xxhash64("grp", "unit", "kind"))
    folded = rows.groupBy("grp", "unit", "kind", "fold").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    points = cut(folded.withColumn("id", F.monotonically_increasing_id()))
    count = points.count()
    if not count:
        return rows.select("grp", "at", F.lit(None).cast("long").alias("twin_of"), F.lit(None).cast("double").alias("cosine")).limit(0)
    tree = grow(points, count)
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))
    listed = tree.placed.columns
    asking = tree.placed.withColumn("radius", F.lit(radius))

    def match(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": [], "earlier": [], "cosine": []})
        if not len(q) or not len(p):
            return empty
        scores = _stack(q["unit"]) @ _stack(p["unit"]).T
        twin = scores >= least
        twin &= q["grp"].to_numpy()[:, None] == p["grp"].to_numpy()[None, :]
        twin &= p["first"].to_numpy()[None, :] < q["last"].to_numpy()[:, None]
        same_kind = q["kind"].to_numpy()[:, None] == p["kind"].to_numpy()[None, :]
        twin &= ~(same_kind & q["kind"].notna().to_numpy()[:, None])
        twin &= q["id"].to_numpy()[:, None] != p["id"].to_numpy()[None, :]
        firsts = np.where(twin, p["first"].to_numpy()[None, :], np.iinfo(np.int64).max)
        best = firsts.argmin(axis=1)
        row = np.flatnonzero(twin.any(axis=1))
        return pd.DataFrame({"id": q["id"].to_numpy()[row], "earlier": firsts[row, best[row]], "cosine": scores[row, best[row]]})

    schema = "id long, earlier long, cosine double"
    if tree.wide(asking):
        met = all_pairs.meet_all(points.select("id", "unit", "grp", "kind", "last"), points.select("id", "unit", "grp", "kind", "first"), count, all_pairs.first_twin(least), schema)
    else:
        everywhere = cut(tree.placed.unionByName(tree.visits(asking).select(*listed))).drop("cell")
        met = _meet(everywhere, tree.placed, "tile", match, schema)
    near = met.groupBy("id").agg(F.min(F.struct("earlier", "cosine")).alias("near"))
    told = points.join(near, "id", "left").select(
        "fold", *[F.col(c).alias(f"_its_{c}") for c in ("grp", "unit", "kind")], "near", F.when(F.col("kind").isNull(), F.col("first")).alias("own"))
    same = (F.col("grp").eqNullSafe(F.col("_its_grp")) & (F.col("unit") == F.col("_its_unit")) & F.col("kind").eqNullSafe(F.col("_its_kind")))
    keyed = told.withColumnRenamed("fold", "_its_fold")
    joined = rows.join(keyed, (F.col("fold") == F.col("_its_fold")) & same)
    candidate = F.least(
        F.when(F.col("near.earlier") < F.col("at"), F.struct(F.col("near.earlier").alias("twin_of"), F.col("near.cosine").alias("cosine"))),
        F.when(F.col("own") < F.col("at"), F.struct(F.col("own").alias("twin_of"), F.lit(1.0).alias("cosine"))))
    return joined.withColumn("t", candidate).filter(F.col("t").isNotNull()).select("grp", "at", "t.twin_of", "t.cosine")
