"""Keys, tempo and small vector functions."""

from pyspark.sql import functions as F

from ..functions import keys, vectors
from ..operators import cost
from . import query
from .stand_ins import TRACKS, catalogue, table, tracks, with_catalogue

_SPELLINGS = ("A minor", "C", "F# minor", "Gbm", "Bb major", "8A", "Fis minor", "c# Major", "E♭ min", "12b", "Cb", "", "what",
              "13A", "D-minor", "B#", "Abm")
_CODES = ("8A", "8B", "11A", "11A", "6B", "8A", "11A", "3B", "2A", "12B", "1B", None, None, None, "7A", "8B", "1A")


def _values(items):
    return ", ".join("NULL" if i is None else "'" + i + "'" for i in items)


@query("K1_key_spellings", with_catalogue(
    f"SELECT id, [{_values(_SPELLINGS)}][id % {len(_SPELLINGS)} + 1] AS key, [{_values(_CODES)}][id % {len(_SPELLINGS)} + 1] AS code FROM catalogue"))
def key_spellings(spark, sf):
    spelled = F.element_at(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col("id") % len(_SPELLINGS) + 1).cast("int"))
    return catalogue(spark, sf).select("id", spelled.alias("key")).withColumn("code", keys.to_camelot("key"))


@query("K2_fold_tempo", with_catalogue(
    "SELECT id, round(CASE WHEN t IS NULL OR t <= 0 THEN NULL WHEN t >= 70 THEN t WHEN t >= 35 THEN t * 2 WHEN t >= 17.5 THEN t * 4 "
    "WHEN t >= 8.75 THEN t * 8 WHEN t >= 4.375 THEN t * 16 WHEN t >= 2.1875 THEN t * 32 WHEN t >= 1.09375 THEN t * 64 ELSE t * 128 END, 6) AS tempo "
    "FROM (SELECT id, CAST(id % 187 AS DOUBLE) AS t FROM catalogue)"))
def fold_tempo(spark, sf):
    return catalogue(spark, sf).select("id", F.round(keys.fold_tempo((F.col("id") % 187).cast("double")), 6).alias("tempo"))


# Pairs: every row against the one with the mirrored id, an equi-join on the id.
_PAIRS = ("SELECT a.id, a.bpm AS b1, b.bpm AS b2, a.camelot AS k1, b.camelot AS k2, a.vec AS v1, b.vec AS v2 "
          f"FROM ({TRACKS}) a JOIN ({TRACKS}) b ON b.id = (SELECT max(vec_id) FROM embeddings) - a.id")


def pairs(spark, sf):
    rows = tracks(spark, sf)
    last = table(spark, sf, "embeddings").agg(F.max("vec_id")).scalar()
    left = rows.select("id", F.col("bpm").alias("b1"), F.col("camelot").alias("k1"), F.col("vec").alias("v1"), (last - F.col("id")).alias("_b"))
    right = rows.select(F.col("id").alias("_b"), F.col("bpm").alias("b2"), F.col("camelot").alias("k2"), F.col("vec").alias("v2"))
    return left.join(right, "_b").drop("_b")


_NUM = "CAST(regexp_extract({0}, '^([0-9]+)', 1) AS INT)"
_N1, _N2 = _NUM.format("k1"), _NUM.format("k2")
_UP = f"((({_N2} - {_N1}) % 12 + 12) % 12)"
_STEPS = f"least({_UP}, (12 - {_UP}) % 12)"
KEY_COST = (f"CASE WHEN k1 IS NULL OR k2 IS NULL THEN 0.5e0 ELSE least(1e0, [0e0, 0e0, 0.4e0, 0.6e0, 0.8e0, 0.9e0, 1e0][{_STEPS} + 1] "
            f"+ CASE WHEN {_STEPS} <> 0 AND right(k1, 1) <> right(k2, 1) THEN 0.2e0 ELSE 0e0 END) END")
_GAP = "least(abs(b2 * 0.5e0 - b1) / b1, abs(b2 - b1) / b1, abs(b2 * 2e0 - b1) / b1)"
TEMPO_COST = (f"CASE WHEN b1 IS NULL OR b2 IS NULL THEN 0.5e0 WHEN {_GAP} <= 0.06e0 THEN 0.5e0 * {_GAP} / 0.06e0 "
              f"ELSE least(1e0, 0.5e0 + 0.5e0 * ({_GAP} - 0.06e0) / 0.06e0) END")
SOUND_COST = "greatest(0e0, least(1e0, 1 - list_cosine_similarity(v1::DOUBLE[], v2::DOUBLE[])))"


def _pair(name, sql, make):
    @query(name, f"SELECT id, {sql} AS value FROM ({_PAIRS})")
    def run(spark, sf):
        return pairs(spark, sf).select("id", make().alias("value"))


_pair("K3_key_distance", f"round({KEY_COST}, 6)", lambda: F.round(keys.key_distance("k1", "k2"), 6))
_pair("K4_key_steps", f"CASE WHEN k1 IS NOT NULL AND k2 IS NOT NULL THEN (({_N2} - {_N1} + 6) % 12 + 12) % 12 - 6 END",
      lambda: keys.key_steps("k1", "k2"))
_pair("K5_tempo_distance", f"round({TEMPO_COST}, 6)", lambda: F.round(keys.tempo_distance("b1", "b2"), 6))
_pair("K6_tempo_shift", "round(CASE WHEN b1 IS NULL OR b2 IS NULL THEN NULL WHEN abs(b2 * 0.5e0 - b1) <= abs(b2 - b1) AND abs(b2 * 0.5e0 - b1) <= abs(b2 * 2e0 - b1) "
      "THEN b2 * 0.5e0 - b1 WHEN abs(b2 - b1) <= abs(b2 * 2e0 - b1) THEN b2 - b1 ELSE b2 * 2e0 - b1 END, 6)",
      lambda: F.round(keys.tempo_shift("b1", "b2"), 6))
_pair("V1_sound_distance", f"round({SOUND_COST}, 6)", lambda: F.round(vectors.sound_distance("v1", "v2"), 6))
_pair("J12_transition_cost", f"round((2e0 * {SOUND_COST} + {TEMPO_COST} + 0.5e0 * {KEY_COST}) / 3.5e0, 6)",
      lambda: F.round(cost.pair_cost("v1", "v2", "b1", "b2", "k1", "k2", (2.0, 1.0, 0.5)), 6))


@query("K7_wheel_rank", with_catalogue(
    "SELECT id, CAST(regexp_extract(camelot, '^([0-9]+)', 1) AS INT) * 2 + CASE WHEN right(camelot, 1) = 'B' THEN 1 ELSE 0 END AS rank FROM catalogue WHERE camelot IS NOT NULL "
    "UNION ALL SELECT id, NULL FROM catalogue WHERE camelot IS NULL"))
def wheel_rank(spark, sf):
    return catalogue(spark, sf).select("id", keys.wheel_rank("camelot").alias("rank"))


@query("K8_tag_tempo", with_catalogue(
    "SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN duration BETWEEN 40 AND 220 THEN duration END AS tempo FROM catalogue"))
def tag_tempo(spark, sf):
    said = F.when(F.col("id") % 3 == 0, F.lit("fast")).otherwise(F.concat(F.lit(" "), F.col("duration").cast("string"), F.lit(" ")))
    return catalogue(spark, sf).select("id", keys.tag_tempo(said).alias("tempo"))


@query("A26_onsets_per_beat", with_catalogue(
    "SELECT id, round(energy_pulse * 60 / CASE WHEN bpm < 70 THEN bpm * 2 ELSE bpm END, 6) AS per_beat FROM catalogue"))
def onsets_per_beat(spark, sf):
    return catalogue(spark, sf).select("id", F.round(keys.onsets_per_beat("energy_pulse", "bpm"), 6).alias("per_beat"))


@query("V2_unit_vectors", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, "
       "round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS head FROM embeddings")
def unit_vectors(spark, sf):
    rows = tracks(spark, sf)
    return rows.select("id", F.round(vectors.norm("vec"), 6).alias("length"),
                       F.round(F.element_at(vectors.unit("vec"), 1), 6).alias("head"))


@query("T7_look_ahead", f"SELECT id, round(CASE WHEN b1 IS NULL THEN b2 ELSE b2 + 0.5e0 * (b2 - b1) END, 6) AS bpm, k2 AS camelot, "
       f"round(v2[1]::DOUBLE + 0.5e0 * (v2[1]::DOUBLE - v1[1]::DOUBLE), 6) AS head FROM ({_PAIRS})")
def look_ahead(spark, sf):
    rows = pairs(spark, sf)
    return rows.select("id", F.round(vectors.ahead_number("b1", "b2", 0.5), 6).alias("bpm"), F.col("k2").alias("camelot"),
                       F.round(F.element_at(vectors.ahead("v1", "v2", 0.5), 1), 6).alias("head"))
