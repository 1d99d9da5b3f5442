import json

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from crateline.queries.stand_ins import TABLES
from crateline.sources import catalogue_files, playlist_files
from crateline.streaming import streams

from conftest import SMALL, rows


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200


@pytest.mark.parametrize("name", ["A1_percentile_rank", "F1_library_filter", "W1_signed_deltas", "DD4_same_folder", "W8_active_regions", "T5_suggestions", "J3_pending"])
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found = entry.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    tidy = lambda row: tuple(round(x, 5) if isinstance(x, float) else x for x in row)
    assert sorted(map(repr, map(tidy, expected))) == sorted(repr(tidy(tuple(r))) for r in found.select(*columns).collect())


def test_stored_rows_survive_torn_lines(spark, tmp_path):
    full = {"energy_density": None, "energy_bass": 1.0, "energy_bright": None, "energy_pulse": None}
    lines = [{"seq": 0, "path": "/a", "bpm": 1.0, "embedding": [1.0]}, {"seq": 1, "path": "/a", "bpm": 2.0, "embedding": [1.0], **full},
             {"seq": 2, "path": "/b", "embedding": [1.0], "error": "bad"}, {"seq": 3, "path": "/c", "bpm": 3.0, "embedding": [2.0]}]
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + '\n{"seq": 4, "pa')
    found = catalogue_files.read_rows(spark, str(tmp_path / "rows.jsonl"))
    assert rows(found, "path", "bpm", "has_energy") == [("/a", 2.0, True), ("/c", 3.0, False)]


def test_manifest_skips_named_folders(spark, tmp_path):
    for name in ("x/a.MP3", "x/y/old/b.mp3", "x/_DUPLICATES_TO_DELETE/b.mp3", "c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    names = lambda df: [p.rsplit("/", 1)[1] for (p,) in rows(df, "path")]
    files = catalogue_files.manifest(spark, str(tmp_path), skip=("old",))
    assert names(files) == ["c.txt", "a.MP3"]
    assert names(catalogue_files.manifest(spark, str(tmp_path), audio_only=True)) == ["a.MP3", "b.mp3"]
    assert names(catalogue_files.taggable(files)) == ["a.MP3"]


def test_playlists_read_back_in_order(spark, tmp_path):
    (tmp_path / "night.m3u8").write_text("#EXTM3U\n\n/b c.mp3\nfile://localhost/a%20%2Bx.mp3\n/b c.mp3\n")
    found = playlist_files.read_m3u8(spark, str(tmp_path))
    assert rows(found, "playlist", "pos", "path") == [("night", 0, "/b c.mp3"), ("night", 1, "/a +x.mp3"), ("night", 2, "/b c.mp3")]


def test_a_shelf_reads_back_as_it_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(playlist_files, "FILE_LINES", 4)  # several files for one playlist
    entries = [(p, i, f"/{p}/{(i * 7) % 10}", "n", "a", 1.0) for p in ("night", "day") for i in range(10)]
    playlist_files.write_m3u8(spark.createDataFrame(entries, "playlist string, pos long, path string, name string, artist string, duration double"), str(tmp_path / "s"))
    assert rows(playlist_files.read_shelf(spark, str(tmp_path / "s")), "playlist", "pos", "path") == sorted(e[:3] for e in entries)


def test_journal_passes_broken_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"at":"2024-01-01T10:00:00","kind":"pick","path":"/a"}\n{"at": "20\n')
    schema = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("path", T.StringType())])
    assert rows(catalogue_files.read_journal(spark, str(tmp_path), schema), "kind", "path") == [("pick", "/a")]


def test_last_write_wins_whatever_the_order_of_arrival(spark, tmp_path):
    schema = "path string, seq long, v string"
    source = tmp_path / "in"
    spark.createDataFrame([("a", 5, "new"), ("b", 1, "b1")], schema).coalesce(1).write.mode("append").json(str(source))
    run = lambda: streams.upsert_latest(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    spark.createDataFrame([("a", 2, "late"), ("b", 3, "b3")], schema).coalesce(1).write.mode("append").json(str(source))
    run()
    assert rows(streams.read_latest(spark, str(tmp_path / "t")), "path", "v") == [("a", "new"), ("b", "b3")]
    streams.compact(spark, str(tmp_path / "t"), str(tmp_path / "fresh"))
    assert rows(streams.read_latest(spark, str(tmp_path / "fresh")), "path", "v") == [("a", "new"), ("b", "b3")]


def test_late_events_are_dropped_in_append_mode(spark, tmp_path):
    schema = "at timestamp, kind string"
    source = tmp_path / "in"
    put = lambda *items: spark.createDataFrame([(t, "k") for t in items], "t string, kind string").select(
        F.to_timestamp("t").alias("at"), "kind").coalesce(1).write.mode("append").json(str(source))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        counts = streams.choice_counts(spark.readStream.schema(schema).json(str(source)))
        counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    put("2024-01-01 10:05:00", "2024-01-01 10:10:00")
    run()
    put("2024-01-01 12:30:00")
    run()
    put("2024-01-01 10:20:00", "2024-01-01 14:00:00")
    run()
    put("2024-01-01 18:00:00")
    run()
    found = spark.read.parquet(out).filter(F.hour("start") == 10)
    assert rows(found, "n") == [(2,)]
