import pytest
from pyspark.sql import functions as F

from crateline.functions import formats, keys, moods, tags, text


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


@pytest.mark.parametrize("key, scale, code", [
    ("A minor", None, "8A"), ("C", None, "8B"), ("F# minor", None, "11A"), ("Gbm", None, "11A"), ("Bb major", None, "6B"),
    ("8A", None, "8A"), ("E", "minor", "9A"), ("", None, None), ("whatever", None, None), ("13A", None, None)])
def test_key_spellings(spark, key, scale, code):
    assert one(spark, keys.to_camelot(F.lit(key), None if scale is None else F.lit(scale))) == code


@pytest.mark.parametrize("a, b, cost", [("8A", "8A", 0), ("8A", "9A", 0), ("8A", "8B", 0), ("1A", "12A", 0), (None, "8A", 0.5),
                                        ("8A", "10A", 0.4), ("8A", "10B", 0.6), ("8A", "2A", 1.0), ("8A", "2B", 1.0)])
def test_key_distance(spark, a, b, cost):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(keys.key_distance("a", "b").alias("v")).first()["v"] == pytest.approx(cost)


def test_tempo(spark):
    df = spark.createDataFrame([(128.0, 64.0), (128.0, 128.0 * 1.06), (None, 120.0), (100.0, 300.0)], "a double, b double")
    found = [r["d"] for r in df.select(keys.tempo_distance("a", "b").alias("d")).collect()]
    assert found == pytest.approx([0.0, 0.5, 0.5, 1.0])
    assert [r["s"] for r in df.select(keys.tempo_shift("a", "b").alias("s")).collect()][0] == 0.0
    for bpm in (1, 17, 34.9, 35, 69.9, 70, 140, 399):
        expected = float(bpm)
        while expected < 70:
            expected *= 2
        assert one(spark, keys.fold_tempo(F.lit(float(bpm)))) == expected


def test_song_keys(spark):
    names = ["/a/07 New Order - Ruined In A Day.mp3", "/b/04 - New Order - Ruined in a Day (BPM 105).flac", "/c/Decisão 105.mp3", "/d/(only).mp3"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    found = [r["k"] for r in df.select(text.song_key("path").alias("k")).collect()]
    assert found == ["new order ruined in a day", "new order ruined in a day", "decisao", "only"]


def test_search_folds_accents_both_ways(spark):
    df = spark.createDataFrame([("Decisão",), ("Decisão",), ("Decision",)], "n string")
    for test in (text.has_all_words, text.has_all_words_collated):
        assert df.filter(test("n", ["DECISAO"])).count() == 2


def test_paths_and_times(spark):
    assert one(spark, text.absolute_path(F.lit("a//b/./../c"), "/r")) == "/r/a/c"
    assert one(spark, text.file_uri_path(F.lit("file://localhost/a%20b+c.mp3"))) == "/a b+c.mp3"
    assert one(spark, formats.parse_clock(F.lit("03:07.5"))) == 187.5
    assert one(spark, formats.parse_clock(F.lit("3:60"))) is None
    assert one(spark, formats.remaining(F.lit(10.0), F.lit(75.0))) == "-01:05.0"
    assert one(spark, formats.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, formats.length_told(F.lit(4320.0))) == "1h 12m"


def test_tags_split_but_keep_whole_words(spark):
    value = F.lit("Funk / Soul - Contemporary R&B; Hi-NRG, house; House")
    assert one(spark, tags.split_tag(value)) == ["Funk / Soul", "Contemporary R&B", "Hi-NRG", "house"]
    assert one(spark, tags.title_case(F.lit("r&b/soul hi-nrg"))) == "R&B/Soul Hi-Nrg"


def test_moods(spark):
    assert one(spark, moods.word_valence(F.lit("Dark"))) == -1.0
    assert one(spark, moods.word_valence(F.lit(""))) is None
    assert one(spark, moods.word_valence(F.lit("Dark; Energetic"))) == pytest.approx(-2 / 3)
    packed = moods.weights(F.lit("Dark:0.62; Deep:0.41; junk; Odd:x"))
    assert one(spark, moods.spell_weights(packed)) == "Dark:0.620; Deep:0.410"
    assert one(spark, moods.valence_of(moods.weights(F.lit("Energetic:0.9")))) is None
    assert one(spark, moods.faint_only(moods.weights(F.lit("Sad:0.04; Energetic:0.5"))))


def test_texts_become_strings_in_steps(monkeypatch):
    import pyarrow as pa
    seen = []
    monkeypatch.setattr(text, "STEP_BYTES", 40)
    texts = ["Éne", None, "x" * 100, "", "Straße", "ﬁn"] * 5
    work = lambda t: seen.append(t) or text._fold(t)
    assert text._in_steps(pa.array(texts, pa.string()), work).to_pylist() == [text._fold(t) for t in texts]
    assert seen == [t for t in texts if t is not None]
    assert text._in_steps(pa.array([], pa.string()), work).to_pylist() == []


def test_folding_takes_arrow_batches(spark):
    rows = spark.createDataFrame([("Éne THE",), (None,), ("",), ("Straße",)], "t string").select("t", text.folded("t").alias("f"), text.composed("t").alias("c"))
    assert {r["t"]: (r["f"], r["c"]) for r in rows.collect()} == {"Éne THE": ("ene the", "Éne THE"), None: (None, None), "": ("", ""), "Straße": ("strasse", "Straße")}
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
