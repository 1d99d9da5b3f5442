import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from crateline.operators import arcs, sequences

from conftest import SMALL, rows


def lists(spark, n=30):
    """Playlists of 1 to 60 entries with many ties."""
    rng = random.Random(3)
    data = [(p, i, rng.choice([99.6, 100.0, 120.0, None]), rng.choice(["8A", "9A", "3B", "?", None]), *(rng.choice([0.0, 0.3, 0.5, 0.9]) for _ in range(4)))
            for p in range(n) for i in range(rng.choice([1, 2, 5, 14, 60]))]
    rng.shuffle(data)
    schema = "playlist int, entry int, bpm double, camelot string, " + ", ".join(f"{m} double" for m in arcs.MEASURES)
    return spark.createDataFrame(data, schema).repartition(6, "playlist")


def ranked(assigned):
    return assigned.withColumn("_rank", F.round("arc_bpm", 1))


def test_chapters_of_whole_lists_are_those_of_the_passes(spark):
    df = lists(spark)
    keys = ("playlist", "entry", "chapter_no", "chapter")
    assert rows(arcs.assign_whole(df, "playlist", "entry"), *keys) == rows(arcs.assign(df, "playlist", "entry"), *keys)


def test_order_of_whole_lists_is_that_of_the_classes(spark):
    assigned = ranked(arcs.assign_whole(lists(spark), "playlist", "entry"))
    keys = ("playlist", "entry", "place")
    expected = rows(sequences.chapter_order(assigned, track="entry"), *keys)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for batch in (7, 10_000):  # lists that go on in the next batch, and many lists in one
            spark.conf.set(size, batch)
            assert rows(sequences.chapter_order_whole(assigned, track="entry"), *keys) == expected
    finally:
        spark.conf.set(size, before)


def test_whole_lists_move_once(spark):
    found = sequences.chapter_order_whole(ranked(arcs.assign_whole(lists(spark), "playlist", "entry")), track="entry")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["G6_chapters", "G7_order_in_chapters"])
def test_larger_lists_agree(spark, monkeypatch, name):
    query = __spark_entry__.queries()[name]
    whole = query(spark, SMALL)
    expected = rows(whole, *whole.columns)
    monkeypatch.setattr(sequences, "WHOLE_LIST", 4, raising=False)
    assert rows(query(spark, SMALL), *whole.columns) == expected
