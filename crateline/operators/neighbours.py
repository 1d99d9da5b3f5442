"""Nearest rows by sound and by transition cost, for one seed, many seeds or all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import tempo, wheel_mode, wheel_number
from ..functions.vectors import seed_distance
from ..plans.cells import first_twins, knn_join
from ..plans.products import Scorer, best_rows, matrix, unit_rows
from ..plans.session import cut, small
from .cost import EVEN, Points, Weights, pair_costs

__all__ = ["similar", "nearest", "suggestions", "corridor", "by_distance", "knn_join", "first_twins"]


def _cosine_scorer() -> Scorer:
    def price(asks, rows, part):
        cost = -(asks[0] @ rows[0][part].T)
        cost[asks[1][:, None] == rows[1][part][None, :]] = np.inf
        return cost

    told = lambda table, own: (unit_rows(matrix(table["vec"])), np.asarray(table[own].combine_chunks() if isinstance(table, pa.Table) else table[own]))
    return Scorer(lambda batch: told(batch, "id"), lambda table: told(table, "ask"), price)


def similar(df: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """The k nearest by cosine of stated seeds (seed, vec), any number of them, the seed itself left out. Rows without a vector are left out."""
    rows = df.filter(F.col("vec").isNotNull()).select(F.col("id").cast("long").alias("id"), "vec")
    asks = seeds.filter(F.col("vec").isNotNull()).select(F.col("seed").cast("long").alias("ask"), "vec")
    found = best_rows(rows, asks, _cosine_scorer(), k)
    return found.select(F.col("ask").alias("seed"), "id", (-F.col("cost")).alias("cosine"), "place")


_POINT = ("vec", "bpm", "camelot")


def _facts(prefix: str = "") -> list[Column]:
    """What a step is priced by: vector, usable tempo, place on the wheel."""
    of = lambda c: F.col(prefix + c)
    return [of("vec").alias("vec"), tempo(of("bpm")).alias("tempo"), wheel_number(of("camelot")).alias("number"), wheel_mode(of("camelot")).alias("mode")]


def points_of(table: pa.Table | pa.RecordBatch, prefix: str = "") -> Points:
    def number(name: str) -> np.ndarray:
        column = table[prefix + name]
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(column.cast(pa.float64()).fill_null(float("nan")))

    return Points(unit_rows(matrix(table[prefix + "vec"])), number("tempo"), number("number"), number("mode"))


def _shut(rows_ids: np.ndarray, rows_songs: np.ndarray | None, ids: list, songs: list | None) -> np.ndarray:
    """Rows that a request may not have: stated ids, and rows of stated songs."""
    shut = np.isin(rows_ids, np.array(ids, np.int64)) if ids else np.zeros(len(rows_ids), bool)
    if songs and rows_songs is not None:
        shut |= pd.Series(rows_songs).isin(songs).to_numpy()
    return shut


def _cost_scorer(weights: Weights) -> Scorer:
    """Cost from a request's points (one or two, summed) to rows; ``ids`` and ``songs`` of a request are shut."""
    def rows(batch):
        return points_of(batch), np.asarray(batch["id"]), batch["song"].to_pandas().to_numpy(dtype=object) if "song" in batch.schema.names else None

    def asks(table):
        two = np.asarray(table["two"].combine_chunks().fill_null(False)) if "two" in table.column_names else None
        return (points_of(table), None if two is None else points_of(table, "other_"), two, table["ids"].to_pylist(),
                table["songs"].to_pylist() if "songs" in table.column_names else [None] * len(table))

    def price(asked, seen, part):
        first, second, two, ids, songs = asked
        points = seen[0].part(part)
        cost = pair_costs(first, points, weights)
        if second is not None and two.any():
            cost[two] += pair_costs(second.part(two), points, weights)
        for i in range(len(cost)):
            cost[i, _shut(seen[1][part], None if seen[2] is None else seen[2][part], ids[i], songs[i])] = np.inf
        return cost

    return Scorer(rows, asks, price)


def _open(df: DataFrame, pool: DataFrame | None) -> DataFrame:
    rows = df.filter(F.col("vec").isNotNull())
    return rows if pool is None else rows.join(pool.select("id").distinct(), "id", "left_semi")


def nearest(df: DataFrame, requests: DataFrame, k: int, weights: Weights = EVEN, pool: DataFrame | None = None) -> DataFrame:
    """``request, id, cost, place``: the k cheapest transitions from every request's point (request, seed, vec, bpm, camelot).

    ``pool`` limits the rows; the point may lie ahead of its seed. Rows and points without a vector are left out.
    """
    rows = _open(df, pool).select(F.col("id").cast("long").alias("id"), *_facts())
    asks = requests.filter(F.col("vec").isNotNull()).select(F.col("request").alias("ask"), F.array(F.col("seed").cast("long")).alias("ids"), *_facts())
    return best_rows(rows, asks, _cost_scorer(weights), k).select(F.col("ask").alias("request"), "id", "cost", "place")


def suggestions(df: DataFrame, requests: DataFrame, taken: DataFrame, k: int, name_key: Column, song: Column,
                weights: Weights = EVEN, pool: DataFrame | None = None) -> DataFrame:
    """k voices per request: rows already taken and their songs dropped, copies of a name under one voice.

    All rows are looked at: a task keeps the cheapest row of each of its k best names. ``copies``
    counts all rows of the name that are left, for the names that were found. ``taken`` is (request, id).
    """
    nameless = "\0"
    named = df.withColumn("_name", F.coalesce(name_key.cast("string"), F.lit(nameless))).withColumn("_song", song.cast("string"))
    gone = taken.join(named.select("id", "_song"), "id").groupBy("request").agg(
        F.collect_set(F.col("id").cast("long")).alias("_ids"), F.collect_set("_song").alias("songs"))
    rows = _open(named, pool)
    points = requests.filter(F.col("vec").isNotNull()).join(gone, "request", "left")
    own = F.array(F.col("seed").cast("long"))
    asks = points.select(F.col("request").alias("ask"), F.concat(own, F.coalesce("_ids", F.array().cast("array<bigint>"))).alias("ids"),
                         F.coalesce("songs", F.array().cast("array<string>")).alias("songs"), *_facts())
    asks = cut(asks)
    found = best_rows(rows.select(F.col("id").cast("long").alias("id"), *_facts(), F.col("_song").alias("song"), F.col("_name").alias("group")),
                      asks, _cost_scorer(weights), k, "group")
    found = cut(found)
    left = rows.select("id", F.col("_name").alias("group"), "_song").join(small(found.select("ask", "group")), "group")
    shut = asks.select("ask", "ids", "songs")
    counted = left.join(small(shut), "ask").filter(~F.array_contains("ids", F.col("id").cast("long")) & ~F.coalesce(F.array_contains("songs", F.col("_song")), F.lit(False)))
    copies = counted.groupBy("ask", "group").agg(F.count("*").alias("copies"))
    return found.join(copies, ["ask", "group"]).select(F.col("ask").alias("request"), "place", "id", "cost", "copies", F.nullif("group", F.lit(nameless)).alias("voice"))


def corridor(df: DataFrame, requests: DataFrame, song: Column, weights: Weights = EVEN) -> DataFrame:
    """The rows cheapest from the start plus from the end, one per song, up to the request's ``reach``.

    ``requests`` is (request, start, end, reach); ends and their songs are left out.
    """
    rows = df.withColumn("_song", song.cast("string")).filter(F.col("vec").isNotNull())
    ends = requests.select("request", "reach", F.posexplode(F.array_compact(F.array("start", "end"))).alias("at", "seed"))
    points = ends.join(rows.select(F.col("id").alias("seed"), *_POINT, F.col("_song").alias("_end_song")), "seed")
    tips = points.groupBy("request", "reach").agg(F.array_sort(F.collect_list(F.struct("at", "seed", *_POINT, "_end_song"))).alias("_ends"))  # two per request
    first, last = F.element_at("_ends", 1), F.element_at("_ends", -1)
    told = lambda tip, prefix: [tip[c].alias(prefix + c) for c in _POINT]
    both = tips.select("request", "reach", "_ends", *told(first, "_a_"), *told(last, "_b_"))
    asks = cut(both.select(
        F.col("request").alias("ask"), F.col("reach").cast("long").alias("k"), F.transform("_ends", lambda e: e["seed"].cast("long")).alias("ids"),
        F.array_compact(F.transform("_ends", lambda e: e["_end_song"])).alias("songs"), (F.size("_ends") > 1).alias("two"),
        *_facts("_a_"), *[c.alias(f"other_{n}") for c, n in zip(_facts("_b_"), ("vec", "tempo", "number", "mode"), strict=True)]))
    seen = rows.select(F.col("id").cast("long").alias("id"), *_facts(), F.col("_song").alias("song"))
    found = best_rows(seen, asks, _cost_scorer(weights), None, "song")
    return found.select(F.col("ask").alias("request"), "id", "cost", "place")


def by_distance(df: DataFrame, seed: DataFrame) -> DataFrame:
    """All rows by distance to one seed vector, with their place; equal distances keep id order."""
    from ..plans.ordered import indexed
    vec = seed.select("vec").limit(1).scalar()
    away = df.withColumn("_seed", vec).select("id", seed_distance("vec", "_seed").alias("distance"))
    return indexed(away, ["distance", "id"], "_at").select("id", "distance", (F.col("_at") + 1).alias("place"))


def batched_scores(df: DataFrame, predict, outputs: str, columns: tuple[str, ...] = ("id",), vec: str = "vec",
                   batch: int = 4096) -> DataFrame:
    """Score vectors through a caller's head: ``predict(matrix) -> matrix``, whole Arrow batches at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                scores = np.asarray(predict(np.vstack(part[vec].to_numpy())), dtype=float)
                yield part[list(columns)].assign(**{outputs: list(scores)})

    keep = df.select(*columns, vec)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep.select(*columns).schema)
    return keep.mapInPandas(run, f"{fields}, {outputs} array<double>")
