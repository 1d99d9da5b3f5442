import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crateline.operators import cost, neighbours, sequences
from crateline.plans import products

CODES = ["8A", "8B", "1A", "12B", "x", None, "3a"]


def tracks(spark, n, seed=0, dims=4, copies=True):
    pick = random.Random(seed)
    vecs = [[pick.random() - 0.5 for _ in range(dims)] for _ in range(n)]
    if copies:
        vecs[n // 2] = vecs[0]
    rows = [(i, None if copies and i == 5 else vecs[i], pick.choice([None, 90.0, 120.0, 128.0, 61.5, 0.0]), pick.choice(CODES), f"song {i % (n // 2)}" if i % 9 else None, f"name {i % (n // 3)}" if i % 7 else None)
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<double>, bpm double, camelot string, song string, name string")


def gaps():
    """A cost of small numbers with many ties: the distance of two numbers, never for equal ids."""
    plain = lambda batch, column: np.asarray(batch[column])

    def price(asks, rows, part):
        told = np.abs(asks[0][:, None] - rows[0][part][None, :]).astype(float)
        told[asks[1][:, None] == rows[1][part][None, :]] = np.inf
        return told

    return products.Scorer(lambda b: (plain(b, "at"), plain(b, "id")), lambda t: (plain(t, "at"), plain(t, "ask")), price)


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("few, block, cells", [(512, 64, 1 << 21), (3, 4, 1 << 21), (3, 64, 50)])
def test_best_rows_equal_brute_force(spark, monkeypatch, grouped, few, block, cells):
    pick = random.Random(4)
    rows = [(i, pick.randrange(20), None if i % 11 == 0 else f"g{i % 13}") for i in range(300)]
    asks = [(i, pick.randrange(20), pick.choice([0, 1, 3, 400])) for i in range(30)]
    monkeypatch.setattr(products, "CELLS", cells)
    monkeypatch.setattr(products, "BATCH_ROWS", 40)
    df = spark.createDataFrame(rows, "id long, at long, name string").repartition(3)
    found = products.best_rows(df, spark.createDataFrame(asks, "ask long, at long, k long"), gaps(), group="name" if grouped else None, few=few, block=block)
    expected = set()
    for ask, at, k in asks:
        line, names = [], set()
        for c, i, g in sorted((abs(at - y), i, g) for i, y, g in [(i, y, "" if g is None else g) for i, y, g in rows] if i != ask):
            if grouped and g in names:
                continue
            names.add(g)
            line.append((ask, float(c), i))
        expected |= {(*r, place) for place, r in enumerate(line[:k], 1)}
    assert {(r["ask"], r["cost"], r["id"], r["place"]) for r in found.collect()} == expected


def test_costs_in_blocks_equal_the_columns(spark):
    df = tracks(spark, 40, copies=False)
    rows = [r for r in df.select("id", *neighbours._facts()).toArrow().to_batches() if r.num_rows]
    points = neighbours.points_of(pa.Table.from_batches(rows))
    found = cost.pair_costs(points, points, (1.0, 2.0, 0.5))
    pairs = df.alias("a").join(df.alias("b"), F.lit(True)).select(
        F.col("a.id").alias("x"), F.col("b.id").alias("y"), cost.pair_cost("a.vec", "b.vec", "a.bpm", "b.bpm", "a.camelot", "b.camelot", (1.0, 2.0, 0.5)).alias("c"))
    at = {i: n for n, i in enumerate(pa.Table.from_batches(rows)["id"].to_pylist())}
    assert all(found[at[r["x"]], at[r["y"]]] == pytest.approx(r["c"], abs=1e-9) for r in pairs.collect())


def test_many_requests_are_as_few_ones(spark, monkeypatch):
    df = tracks(spark, 90, 1)
    points = df.filter("vec IS NOT NULL").select(F.col("id").alias("request"), F.col("id").alias("seed"), "vec", "bpm", "camelot")
    seeds = df.select(F.col("id").alias("seed"), "vec")
    taken = df.filter("id % 4 = 0").select((F.col("id") + 1).alias("request"), "id")
    ends = df.filter("id < 20 AND id <> 5").select(F.col("id").alias("request"), F.col("id").alias("start"), F.when(F.col("id") % 3 > 0, F.col("id") + 40).alias("end"), (F.col("id") % 4 + 1).alias("reach"))
    calls = [lambda: neighbours.similar(df, seeds, 3), lambda: neighbours.nearest(df, points, 4, pool=df.filter("id % 2 = 0")),
             lambda: neighbours.suggestions(df, points, taken, 3, F.col("name"), F.col("song")), lambda: neighbours.corridor(df, ends, F.col("song"))]
    told = lambda found: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found.collect()}
    few = [told(c()) for c in calls]
    whole = products.best_rows
    monkeypatch.setattr(neighbours, "best_rows", lambda rows, asks, scorer, k=None, group=None: whole(rows, asks, scorer, k, group, few=0, block=7))
    assert [told(c()) for c in calls] == few and all(few)
    # Copies of a name are counted over all rows that are left.
    facts = {r["id"]: r for r in df.collect()}
    for request, _, i, _, copies, voice in few[2]:
        gone = {r["id"] for r in taken.collect() if r["request"] == request}
        songs = {facts[g]["song"] for g in gone} - {None}
        left = [x for x in facts.values() if x["vec"] is not None and x["id"] != request and x["id"] not in gone and x["song"] not in songs and x["name"] == voice]
        assert copies == len(left) and i in {x["id"] for x in left}


def _radio(facts, asked, k, variety, drift, twin=0.97):
    units = {i: np.array(v) / np.linalg.norm(v) for i, (v, _) in facts.items()}
    seeds, bad = [i for i, n in asked if not n], [i for i, n in asked if n]
    part = sequences.directions(np.array([units[i] for i in seeds]))
    norm = lambda v: v / np.linalg.norm(v)
    profiles = [norm(sum(units[i] for i, p in zip(seeds, part) if p == q)) for q in range(max(part) + 1)]
    if bad:
        profiles = [norm(p - 0.5 * norm(sum(units[i] for i in bad))) for p in profiles]
    sizes, used = np.bincount(part), np.zeros(len(profiles))
    near, gone, songs, picked = [units[i] for i in seeds], {i for i, _ in asked}, {facts[i][1] for i in seeds}, []
    while len(picked) < k:
        turn = int(np.argmin(used / sizes))
        closest = {i: max(float(units[i] @ n) for n in near) for i in facts}
        left = [(round(variety * closest[i] - float(units[i] @ profiles[turn]), 12), i) for i in facts if i not in gone and facts[i][1] not in songs and closest[i] < twin]
        if not left:
            break
        i = min(left)[1]
        picked.append(i)
        gone.add(i)
        songs.add(facts[i][1])
        near.append(units[i])
        used[turn] += 1
        if drift:
            profiles[turn] = norm((1 - drift) * profiles[turn] + drift * units[i])
    return picked


@pytest.mark.parametrize("drift, shortlist", [(0.0, 40), (0.0, 3), (0.2, 40), (0.3, 5)])
def test_radio_equals_brute_force(spark, monkeypatch, drift, shortlist):
    df = tracks(spark, 150, 3, dims=6, copies=False).withColumn("song", F.concat(F.lit("s"), F.col("id") % 70))
    asked = [(r, 7 * r + j, j == 3) for r in range(8) for j in range(2 + r % 3)]
    facts = {r["id"]: (r["vec"], r["song"]) for r in df.collect()}
    passes, whole = [], sequences._shortlists
    monkeypatch.setattr(sequences, "_shortlists", lambda *a: (passes.append(1), whole(*a))[1])
    found = sequences.radio(df, spark.createDataFrame(asked, "request long, id long, negative boolean").withColumn("ord", F.col("id")), 6, F.col("song"), drift=drift, shortlist=shortlist).collect()
    for r in range(8):
        mine = [x["id"] for x in sorted((x for x in found if x["request"] == r), key=lambda x: x["place"])]
        assert mine == _radio(facts, [(i, n) for q, i, n in asked if q == r], 6, 0.5, drift)
    assert len(passes) == 1 if shortlist == 40 and not drift else len(passes) <= 6


def test_radio_ends_where_no_row_is_left(spark):
    df = tracks(spark, 12, 5, copies=False).withColumn("song", F.col("id").cast("string"))
    asked = spark.createDataFrame([(1, 0, False)], "request long, id long, negative boolean")
    found = sequences.radio(df, asked, 30, F.col("song"), twin=1.1, shortlist=2)
    assert sorted(r["id"] for r in found.collect()) == list(range(1, 12))
