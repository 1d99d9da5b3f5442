import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateline.operators import long_orders, sequences

SCHEMA = "request int, ord int, id long, vec array<double>, bpm double, camelot string, is_start boolean, is_end boolean"


def group(request, n, seed, start=None, end=None):
    pick = random.Random(seed)
    made = []
    for o in range(n):
        a, b = pick.random() * 2 * math.pi, pick.random()
        made.append((request, o, 1000 * request + ((7 * o) % n if n % 7 else o), [math.cos(a), math.sin(a), b], pick.choice([None, 100.0, 128.0, 64.0]), pick.choice(["8A", "3B", None]), o == start, o == end))
    return made


def brute_costs(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    from crateline.operators.cost import pair_cost
    a, b = (df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for s in "ab")
    cost = pair_cost("a_vec", "b_vec", "a_bpm", "b_bpm", "a_camelot", "b_camelot")
    met = a.join(b, (F.col("a_request") == F.col("b_request")) & (F.col("a_ord") != F.col("b_ord")))
    return {(r["a_request"], r["a_id"], r["b_id"]): (r["c"], r["b_ord"]) for r in met.select("a_request", "a_id", "b_id", "b_ord", cost.alias("c")).collect()}


@pytest.mark.parametrize("whole", [1000, 15])
def test_group_costs_need_no_pairs(spark, monkeypatch, whole):
    monkeypatch.setattr(sequences, "WHOLE_ROWS", whole)
    monkeypatch.setattr(sequences, "COST_ROWS", 7)
    data = group(1, 12, 1) + group(2, 40, 2) + group(3, 1, 3)
    costs = brute_costs(spark, data)
    found = {(r["request"], r["id"]): r for r in sequences.group_costs(spark.createDataFrame(data, SCHEMA)).collect()}
    assert set(found) == {(g, i) for g, i, _ in costs}
    for (g, i), r in found.items():
        mine = [(c, o, j) for (h, x, j), (c, o) in costs.items() if (h, x) == (g, i)]
        assert r["mean_cost"] == pytest.approx(sum(c for c, _, _ in mine) / len(mine)) and r["next_cost"] == pytest.approx(min(mine)[0])


@pytest.mark.parametrize("start, end", [(None, None), (4, 9)])
def test_long_orders_keep_members_and_ends_and_are_smooth(spark, start, end):
    data = group(1, 70, 5, start, end) + group(2, 20, 6, start, end)
    costs = brute_costs(spark, data)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    found = long_orders.long_orders(df, "request", (1.0, 1.0, 1.0), lambda c, r: sequences.turned(c, r, True, 2), nearest=4, last=12, block=24).collect()
    plain = sequences.smooth_order(df).collect()
    for g, n in ((1, 70), (2, 20)):
        told = {}
        for name, line in (("long", found), ("whole", plain)):
            line = sorted((r for r in line if r["request"] == g), key=lambda r: r["place"])
            ids = [r["id"] for r in line]
            assert [r["place"] for r in line] == list(range(n)) and sorted(ids) == [1000 * g + o for o in range(n)]
            at = {r[1]: r[2] for r in data if r[0] == g}
            assert ids[0] == at[start or 0] and (end in (None, start or 0) or ids[-1] == at[end])
            steps = [costs[g, a, b][0] for a, b in zip(ids, ids[1:])]
            assert line[0]["cost"] is None and np.allclose([r["cost"] for r in line[1:]], steps)
            told[name] = sum(steps)
        chance = np.mean([c for (h, _, _), (c, _) in costs.items() if h == g]) * (n - 1)
        assert told["long"] < 1.35 * told["whole"] and told["long"] < 0.5 * chance


def test_large_groups_are_joined_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(sequences, "WHOLE_ROWS", 30)
    calls, whole = [], long_orders.long_orders
    monkeypatch.setattr(long_orders, "long_orders", lambda df, *a: (calls.append(df.count()), whole(df, *a, nearest=4, last=20))[1])
    data = group(1, 40, 8) + group(2, 10, 9)
    found = sequences.smooth_order(spark.createDataFrame(data, SCHEMA)).collect()
    assert calls == [40] and sorted(r["id"] for r in found) == sorted(r[2] for r in data)
