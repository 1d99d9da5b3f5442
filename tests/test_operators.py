import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateline.operators import arcs, audit, duplicates, paths, playlists, segments, structure, sync
from crateline.operators.moves import together
from crateline.plans.ordered import Ordered, already_ordered

from conftest import rows


def test_region_of_active_frames(spark):
    on = lambda t: 2.0 <= t <= 3.95 or 4.45 <= t <= 4.95 or 7.95 <= t <= 8.25
    frames = spark.createDataFrame([(1, i, i / 10, 0.5 if on(i / 10) else 0.1) for i in range(100)], "track int, pos long, t double, ratio double")
    for hot in (False, True):
        found = segments.active_regions(Ordered(frames, ("track",), "pos", hot, 16), floor=0.3)
        assert rows(found, "start", "end") == [(2.0, 5.0)]


def test_section_labels(spark):
    energy, bass = (.20, .50, 1, .30, .95, .15), (.30, .40, .60, .20, .60, .30)
    df = spark.createDataFrame([(1, i, float(e), float(b), 0.0) for i, (e, b) in enumerate(zip(energy, bass))],
                               "track int, pos long, energy double, bass double, slope double")
    found = segments.label_sections(already_ordered(df, ["track"], "pos")).rows
    assert [r["label"] for r in found.orderBy("pos").collect()] == ["Intro", "Build-up", "Drop/Chorus", "Breakdown", "Drop/Chorus", "Outro"]


def test_deltas_between_neighbours(spark):
    df = spark.createDataFrame([
        (1, 0, 120.0, "8A", .52, .25, True), (1, 1, 124.0, "9A", .61, .85, True), (1, 2, None, None, None, None, False),
        (1, 3, 118.0, None, None, None, True), (2, 0, 120.0, "8A", .52, .25, True), (2, 1, 120.0, "8B", .52, .25, True)],
        "playlist int, pos long, bpm double, camelot string, danceability double, energy double, known boolean")
    chain = playlists.chain_table(already_ordered(df, ["playlist"], "pos")).withColumns(playlists.delta_texts())
    found = rows(chain, "playlist", "number", "t_bpm", "t_key", "t_groove", "t_energy")
    assert found == [(1, 1, None, None, None, None), (1, 2, "+4", "+1", "+.09", "+6"), (1, 4, None, None, None, None),
                     (2, 1, None, None, None, None), (2, 2, "+0", "rel", "+.00", "+0")]


def brute_moves(n, moves):
    walk = list(range(n))
    order = list(walk)
    for row, place in sorted(moves.items()):
        if 0 <= row < n:
            target = max(1, min(n, place)) - 1
            order.remove(walk[row])
            order.insert(target, walk[row])
    return {track: at for at, track in enumerate(order)}


def test_moves_follow_the_rows(spark):
    rng = random.Random(4)
    entries, moves, expected = [], [], {}
    for p in range(25):
        n = rng.randint(1, 9)
        asked = {rng.randint(0, n): rng.randint(-1, n + 2) for _ in range(rng.randint(0, 4))}
        entries += [(p, i) for i in range(n)]
        moves += [(p, r, t) for r, t in asked.items()]
        expected |= {(p, i): at for i, at in brute_moves(n, asked).items()}
    found = playlists.moved_all(spark.createDataFrame(entries, "playlist int, pos int"), spark.createDataFrame(moves, "playlist int, row int, place int"))
    assert {(r["playlist"], r["pos"]): r["new_pos"] for r in found.collect()} == expected


def test_many_moves_in_a_long_list(spark):
    rng = random.Random(5)
    n, asked = 3_000, {}
    for row in rng.sample(range(3_000), 1_200):
        asked[row] = rng.choice([1, 3_000, rng.randint(1, 3_000)])
    entries = spark.range(n).selectExpr("'long' AS playlist", "id AS pos").unionByName(spark.range(4).selectExpr("'still' AS playlist", "id AS pos"))
    moves = spark.createDataFrame([("long", r, t) for r, t in asked.items()] + [("nobody", 0, 1), ("still", 9, 1)], "playlist string, row int, place int")
    found = {(r["playlist"], r["pos"]): r["new_pos"] for r in playlists.moved_all(entries, moves).collect()}
    assert found == {("long", i): at for i, at in brute_moves(n, asked).items()} | {("still", i): i for i in range(4)}


def test_stretches_grow_with_the_moves_only():
    rng = np.random.default_rng(3)
    for many in (10, 1_000, 20_000):
        starts, by = together(np.sort(rng.choice(10**9, many, replace=False)), rng.integers(0, 10**9, many), 10**9)
        assert len(starts) <= 3 * many + 1
        ends = np.append(starts[1:], 10**9)
        order = np.argsort(starts + by)
        assert ((starts + by)[order][1:] == (ends + by)[order][:-1]).all()  # every place is taken once


def test_appending_skips_repeats_once(spark):
    current = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "playlist int, track string, pos int")
    incoming = spark.createDataFrame([(1, "c", 0), (1, "a", 1), (1, "c", 2), (1, "a", 3)], "playlist int, track string, pos int")
    merged, skipped = playlists.appended(current, incoming)
    assert rows(merged, "new_pos", "track") == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(skipped, "track") == [("a",), ("c",)]


FILES = [("/m/Track.mp3", "x"), ("/m/Track (1).mp3", "x"), ("/n/Track.mp3", "x"), ("/n/Other.mp3", "yy"), ("/o/other.flac", "zz"), ("/o/e1.mp3", ""), ("/o/e2.mp3", "")]


def files(spark):
    return spark.createDataFrame([(p, len(c), c) for p, c in FILES], "path string, size int, text string")


def test_three_levels_of_duplicates(spark):
    same = duplicates.identical(duplicates.with_hash(files(spark), F.md5("text")))
    probes = same.select("probe").distinct().select(F.col("probe").alias("path"), F.when(F.col("probe").contains("/e"), "empty").alias("reason"))
    good = duplicates.sound(same, probes)
    assert rows(duplicates.broken(same, probes), "path") == [("/o/e1.mp3",), ("/o/e2.mp3",)]
    a, b = duplicates.same_folder(good), duplicates.other_folder(good)
    assert rows(a.filter("not is_keep"), "keep", "path") == [("/m/Track.mp3", "/m/Track (1).mp3")]
    assert rows(b.filter("not is_keep"), "keep", "path") == [("/m/Track.mp3", "/n/Track.mp3")]
    c = duplicates.similar_name(files(spark), duplicates.with_hash(files(spark), F.md5("text")))
    assert rows(c.filter("not is_keep"), "keep", "path") == [("/n/Other.mp3", "/o/other.flac")]
    report = duplicates.report_rows(duplicates.all_groups(a, b, c))
    assert rows(report, "action", "delete") == [("DELETE", "/m/Track (1).mp3"), ("REVIEW", "/n/Track.mp3"), ("REVIEW", "/o/other.flac")]


def test_quarantine_targets_are_told_apart(spark):
    home = "/m/_DUPLICATES_TO_DELETE"
    chosen = spark.createDataFrame([("/m/a/x.mp3", 0), ("/m/a/x.mp3", 5), ("/q/a/x.mp3", 1), ("/z/a/x.mp3", 2), (home + "/y.mp3", 3), ("/m/k.mp3", 4)], "path string, ord int")
    there = spark.createDataFrame([(home + "/a/x__1.mp3",), (home + "/k.mp3",)], "path string")
    found = rows(duplicates.quarantine_plan(chosen, "/m", there), "path", "target")
    assert found == [("/m/a/x.mp3", home + "/a/x.mp3"), ("/m/k.mp3", home + "/k__1.mp3"), ("/q/a/x.mp3", home + "/a/x__2.mp3"), ("/z/a/x.mp3", home + "/a/x__3.mp3")]


def test_sync_sets(spark):
    manifest = spark.createDataFrame([("/a/1", 1.0, 10), ("/a/2", 2.0, 20), ("/a/3", 3.0, 30)], "path string, mtime double, size long")
    known = spark.createDataFrame([("/a/1", 1.0, 10), ("/a/2", 2.5, 20), ("/a/9", 1.0, 1), ("/ab/9", 1.0, 1)], "path string, mtime double, size long")
    assert rows(sync.pending(manifest, known), "path") == [("/a/2",), ("/a/3",)]
    assert rows(sync.vanished(known, manifest, "/a"), "path") == [("/a/9",)]
    with pytest.raises(ValueError):
        sync.pruned(known, manifest, "/unmounted")
    moved = sync.relocated(known, manifest.select(F.replace("path", F.lit("/a/"), F.lit("/b/")).alias("path"), (F.col("mtime") + 1).alias("mtime"), "size"), "/a", "/b")
    assert rows(moved, "path", "mtime", "moved", "not_found") == [("/ab/9", 1.0, False, False), ("/b/1", 2.0, True, False), ("/b/2", 3.0, True, False), ("/b/9", 1.0, True, True)]


def brute_quotas(n):
    out = [max(1, round(c[1] * n)) for c in arcs.CHAPTERS]
    while sum(out) > n:
        out[out.index(max(out))] -= 1
    while sum(out) < n:
        out[out.index(min(out))] += 1
    return out


def test_chapter_quotas(spark):
    found = spark.range(1, 120).select("id", arcs._quota(F.col("id")).alias("q")).collect()
    assert all(r["q"] == brute_quotas(r["id"]) for r in found)


def test_chapters_take_the_best_that_are_left(spark):
    rng = random.Random(9)
    data = [(p, i, *[rng.random() for _ in range(4)]) for p in range(3) for i in range(rng.randint(3, 20))]
    df = spark.createDataFrame(data, "playlist int, track int, " + ", ".join(f"{m} double" for m in arcs.MEASURES))
    score = lambda row, c: sum(max(lo - v, v - hi, 0.0) for v, (lo, hi) in zip(row[2:], arcs.CHAPTERS[c][2:]))
    expected = set()
    for p in range(3):
        left = [r for r in data if r[0] == p]
        for c, quota in enumerate(brute_quotas(len(left))):
            best = sorted(left, key=lambda r: (score(r, c), r[1]))[:quota]
            expected |= {(p, r[1], arcs.NAMES[c]) for r in best}
            left = [r for r in left if r not in best]
    assert {tuple(r) for r in arcs.assign(df, "playlist", "track").select("playlist", "track", "chapter").collect()} == expected


def test_peaks_agree_with_a_plain_walk(spark):
    rng = random.Random(12)
    curves = {t: [rng.random() ** 3 for _ in range(150)] for t in range(4)}
    df = spark.createDataFrame([(t, i, v) for t, c in curves.items() for i, v in enumerate(c)], "track int, beat long, novelty double")
    expected = set()
    for t, c in curves.items():
        last = -100
        for i, v in enumerate(c):
            near, wide = c[max(0, i - 8):i + 8], c[max(0, i - 16):i + 16]
            if v >= max(near) and v >= sum(wide) / len(wide) + 0.1 and i - last > 16:
                last = i
                if 4 <= i <= len(c) - 5:
                    expected.add((t, i))
    found = structure.peaks(Ordered(df, ("track",), "beat"))
    assert {(r["track"], r["beat"]) for r in found.collect()} == expected


def test_resampled_stroke(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 1.5), (2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0)], "stroke int, pos long, x double, y double")
    found = paths.resampled(already_ordered(df, ["stroke"], "pos"), 1.0)
    assert rows(found, "stroke", "k", "x", "y") == [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 2.0, 0.0), (1, 3, 3.0, 0.0), (1, 4, 3.0, 1.0), (1, 5, 3.0, 1.5), (2, 0, 5.0, 5.0)]


def test_stratified_sample_reaches_every_genre(spark):
    data = [(f"g{i % 7}", None if i % 5 == 0 else i / 100, f"/p{i:03d}") for i in range(100)]
    df = spark.createDataFrame(data, "top_genre string, valence double, path string")
    found = audit.stratified(df, 21).collect()
    assert len(found) == len({r["path"] for r in found}) == 21
    assert {r["top_genre"] for r in found} == {f"g{i}" for i in range(7)}
    assert audit.stratified(df, 500).count() == 100


def test_snap_to_the_beat(spark):
    marks = spark.createDataFrame([(1, 0, 10.13, 0.5)], "track int, mark int, time double, period double")
    env = spark.createDataFrame([(1, i * 0.5 + 0.1, 1.0) for i in range(60)] + [(1, i * 0.37, 0.05) for i in range(60)], "track int, t double, env double")
    assert structure.snap(marks, env).first()["snapped"] == pytest.approx(10.1, abs=0.5 / 192)


def test_projection_axes_are_ordered_and_turned(spark):
    import numpy as np
    from crateline.operators.projection import project
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 5)) * np.array([5.0, 2.0, 1.0, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vec array<double>")
    found = np.array([[r["x"], r["y"]] for r in project(df, 3).orderBy("id").collect()])
    assert found.var(axis=0)[0] > found.var(axis=0)[1]
    assert abs(np.corrcoef(found[:, 0], data[:, 0])[0, 1]) > 0.9 and np.corrcoef(found[:, 0], data[:, 0])[0, 1] > 0


def test_novelty_agrees_with_the_kernel_over_the_similarity_matrix(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(8)
    features = rng.random((70, 3))
    features[35:] += 1.0
    half = 16
    axis = np.arange(-half, half + 1)
    xx, yy = np.meshgrid(axis, axis)
    kernel = np.exp(-0.5 * (xx ** 2 + yy ** 2) / (half / 2) ** 2) * np.sign(xx) * np.sign(yy)
    padded = np.pad(features @ features.T, half, mode="edge")
    expected = np.array([(padded[i:i + 2 * half + 1, i:i + 2 * half + 1] * kernel).sum() for i in range(70)])
    expected = np.maximum(expected, 0) / expected.max()
    df = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(features)], "track int, pos long, features array<double>")
    monkeypatch.setattr(structure, "BLOCK_BEATS", 20)
    found = structure.novelty(already_ordered(df, ["track"], "pos")).orderBy("beat").collect()
    assert np.allclose([r["novelty"] for r in found], expected, atol=1e-9)


def test_reading_audit_figures(spark):
    data = [(1, "Dark", [("Dark", .6), ("Happy", .04)]), (2, "Happy; Dark", [("Dark", .5), ("Happy", .3)]), (3, "", [("Dark", .01), ("Happy", .02)]),
            (4, "Happy", [("Dark", .02), ("Happy", .7)])]
    df = spark.createDataFrame(data, "id int, moods string, scores array<struct<label: string, value: double>>")
    told = {r["figure"]: r["value"] for r in audit.reading_audit(df).collect()}
    assert told["rows"] == 4 and told["top label kept"] == 0.5
    assert told["labels overlap"] == pytest.approx((1 + 1 + 0 + 1) / 4)
    assert told["newly measured"] == 0.25
    assert told["balanced: no reading"] == 0 and told["floor 0.05: no reading"] == 0.25
    assert told["sums: below zero"] == 0.5


def test_wave_bins_go_like_an_even_split(spark):
    import numpy as np
    df = spark.createDataFrame([(1, i) for i in range(23)], "track int, pos long").withColumns(
        {c: F.col("pos") * 1.0 for c in ("t", "total", "low", "mid", "high")})
    found = {r["bin"]: r["t"] for r in segments.wave_bands(already_ordered(df, ["track"], "pos"), 5).collect()}
    assert found == {i: c.mean() for i, c in enumerate(np.array_split(np.arange(23), 5))}


def test_onset_regularity(spark):
    rng = random.Random(1)
    data = [(1, i * 0.5) for i in range(20)] + [(2, rng.random() * 10) for _ in range(20)] + [(3, float(i)) for i in range(5)]
    df = spark.createDataFrame(data, "track int, t double")
    from crateline.plans.ordered import positions
    found = {r["track"]: r["groove"] for r in segments.groove(positions(df, ["track"], ["t"])).collect()}
    assert found[1] == pytest.approx(1.0) and found[2] < found[1] and found[3] is None
