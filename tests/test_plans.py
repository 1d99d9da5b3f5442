import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateline.plans import cells, ordered, ranking

from conftest import rows


@pytest.fixture(scope="module")
def playlists(spark):
    rng = random.Random(3)
    data = [("hot", rng.random(), i) for i in range(300)] + [(f"p{i % 7}", rng.random(), 300 + i) for i in range(60)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "grp string, v double, id long")


def test_hot_groups_give_the_same_positions_neighbours_and_sums(playlists):
    plain = ordered.positions(playlists, ["grp"], ["v", "id"])
    hot = ordered.positions(playlists, ["grp"], ["v", "id"], hot_rows=50, block=16)
    assert not plain.hot and hot.hot

    def told(seq):
        out = seq.shifted({"before": ("id", 1), "after": ("id", -1), "third": ("v", 3)}).running_sum("id", "sum")
        return rows(ordered.runs(out, F.col("id") % 2, "run").rows, "grp", "pos", "id", "before", "after", "third", "sum", "run")

    assert told(plain) == told(hot)


def test_a_group_key_may_be_null(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)] + [("a", i) for i in range(5)], "grp string, id long")
    seq = ordered.positions(df, ["grp"], ["id"], hot_rows=10, block=4)
    assert rows(seq.rows, "grp", "id", "pos") == rows(df.withColumn("pos", F.col("id")), "grp", "id", "pos")


def test_index_is_dense_over_all_rows(playlists):
    found = ordered.indexed(playlists, ["v", "id"], "at").orderBy("at").collect()
    assert [r["at"] for r in found] == list(range(360))
    assert [r["id"] for r in found] == [r["id"] for r in playlists.orderBy("v", "id").collect()]


def brute_rank(values):
    known = [v for v in values if v is not None]
    if len(known) == 1:
        return [None if v is None else 0.5 for v in values]
    return [None if v is None else (sum(k < v for k in known) + (sum(k == v for k in known) - 1) / 2) / (len(known) - 1) for v in values]


@pytest.mark.parametrize("size", [10, 250_000])
def test_ranks_and_quantiles_agree_with_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ranking, "RANGE_ROWS", size)
    rng = random.Random(5)
    values = [None if i % 11 == 0 else 0.25 if i % 3 == 0 else round(rng.gauss(0, 1), 2) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    found = {r["id"]: r["rank"] for r in ranking.with_rank(df, "v", "rank").collect()}
    expected = brute_rank(values)
    assert all(found[i] == expected[i] or abs(found[i] - expected[i]) < 1e-12 for i in range(200))
    known = [v for v in values if v is not None]
    q = ranking.quantiles(df, "v", (0.0, 0.1, 0.5, 0.99, 1.0)).first()
    assert np.allclose(q["q"], np.quantile(known, (0.0, 0.1, 0.5, 0.99, 1.0))) and q["n"] == len(known)


def test_rank_edges(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 7.0)], "id int, v double")
    assert rows(ranking.with_rank(df, "v", "rank"), "id", "rank") == [(1, None), (2, None), (3, 0.5)]
    empty = df.filter("id > 9")
    assert ranking.with_rank(empty, "v", "rank").count() == 0


def test_more_rows_are_sorted_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    df = spark.range(3000).selectExpr("id % 500 AS grp", "id")
    numbered = ordered.positions(df, ["grp"], ["id"]).rows
    assert numbered.rdd.getNumPartitions() == 30
    assert rows(numbered, "grp", "id", "pos") == sorted((i % 500, i, i // 500) for i in range(3000))


def vectors(seed=1, n=90):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 6))
    base[n // 3: 2 * n // 3] = base[0] + rng.normal(size=(n // 3, 6)) * 1e-3  # a third of all rows nearly alike
    base[-5:] = base[0]  # and some exactly
    return base


LEVELS = pytest.mark.parametrize("flat", [1, 64])


@LEVELS
def test_neighbours_by_cells_are_exact(spark, monkeypatch, flat):
    monkeypatch.setattr(cells, "TILE_ROWS", 6)
    monkeypatch.setattr(cells, "FLAT_TILES", flat)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 7)
    data = vectors()
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(1000, None)], "id long, vec array<double>")
    found = {}
    for r in cells.knn_join(df, 4).collect():
        found.setdefault(r["id"], []).append((r["place"], r["cosine"]))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -np.inf)
    for i in range(len(data)):
        best = np.sort(scores[i])[::-1][:4]
        assert np.allclose([c for _, c in sorted(found[i])], best, atol=1e-9)


def test_products_of_a_row_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(cells, "TILE_ROWS", 20)
    monkeypatch.setattr(cells, "FLAT_TILES", 2)
    rng, each = np.random.default_rng(3), []
    for n in (300, 3000):
        centres = rng.normal(size=(n // 10, 8))
        data = np.repeat(centres, 10, axis=0) + rng.normal(size=(n, 8)) * 1e-3
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vec array<double>")
        counted = spark.sparkContext.accumulator(0)
        found = cells.knn_join(df, 4, counted=counted).collect()
        assert len(found) == 4 * n and all(r["id"] // 10 == r["other"] // 10 for r in found)
        each.append(counted.value / n)
    assert each[1] < 2.5 * each[0] and each[1] < 100


def test_vectors_without_structure_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cells, "TILE_ROWS", 6)
    monkeypatch.setattr(cells.all_pairs, "BLOCKS", 3)
    monkeypatch.setattr(cells.all_pairs, "SQUARE", (7, 11))
    data = np.random.default_rng(5).normal(size=(400, 24))
    data[::9] = data[0]
    kinds = [f"s{i % 40}" if i % 3 else None for i in range(len(data))]
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = unit @ unit.T
    df = spark.createDataFrame([(1, i, i, kinds[i], v.tolist()) for i, v in enumerate(data)], "playlist long, id long, pos long, song string, vec array<double>")
    sent, meet = [], cells.all_pairs.meet_all
    monkeypatch.setattr(cells.all_pairs, "meet_all", lambda *a: sent.append(1) or meet(*a))
    found = {(r["id"], r["place"]): r for r in cells.knn_join(df, 4).collect()}
    for i in range(len(data)):
        others = sorted((j for j in range(len(data)) if j != i), key=lambda j: (-round(scores[i, j], 9), j))[:4]
        assert [found[i, n + 1]["other"] for n in range(4)] == others
        assert np.allclose([found[i, n + 1]["cosine"] for n in range(4)], scores[i, others], atol=1e-12)
    assert len(found) == 4 * len(data)
    for ignore in (None, "song"):
        expected = {}
        for b in range(len(data)):
            for a in range(b):
                if scores[a, b] >= 0.3 and not (ignore and kinds[a] is not None and kinds[a] == kinds[b]):
                    expected.setdefault(b, a)
        assert {r["at"]: r["twin_of"] for r in cells.first_twins(df, 0.3, by="playlist", ignore=ignore).collect()} == expected
    assert len(sent) == 3


@LEVELS
def test_first_twins_agree_with_brute_force(spark, monkeypatch, flat):
    monkeypatch.setattr(cells, "TILE_ROWS", 6)
    monkeypatch.setattr(cells, "FLAT_TILES", flat)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 7)
    data = vectors(2)
    kinds = [f"s{i % 40}" for i in range(len(data))]
    group = [i % 2 for i in range(len(data))]
    df = spark.createDataFrame([(group[i], i, kinds[i], [float(x) for x in v]) for i, v in enumerate(data)],
                               "playlist long, pos long, song string, vec array<double>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = unit @ unit.T
    for ignore in (None, "song"):
        expected = {}
        for b in range(len(data)):
            for a in range(b):
                if group[a] == group[b] and scores[a, b] >= 0.9 and not (ignore and kinds[a] == kinds[b]):
                    expected.setdefault(b, a)
        found = {r["at"]: r["twin_of"] for r in cells.first_twins(df, 0.9, by="playlist", ignore=ignore).collect()}
        assert found == expected
