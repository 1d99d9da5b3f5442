"""Neighbours, rosters and corridors over the vectors."""

from pyspark.sql import functions as F

from ..functions.vectors import ahead, ahead_number
from ..operators import neighbours
from . import query
from .keys import KEY_COST, SOUND_COST, TEMPO_COST
from .stand_ins import TRACKS, table, tracks

_COS = "list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[])"
_ALL = f"FROM ({TRACKS}) a JOIN ({TRACKS}) b ON a.id <> b.id"
# The request is the row of the smallest id: the operator answers one seed.
_SEED = "(SELECT min(vec_id) FROM embeddings)"
_FROM = (f"SELECT b.*, a.bpm AS b1, b.bpm AS b2, a.camelot AS k1, b.camelot AS k2, a.vec AS v1, b.vec AS v2 {_ALL} AND a.id = {_SEED}")
_COST = f"({SOUND_COST} + {TEMPO_COST} + {KEY_COST}) / 3"


def seed_rows(spark, sf):
    first = table(spark, sf, "embeddings").agg(F.min("vec_id")).scalar()
    return tracks(spark, sf).filter(F.col("id") == first)


def request(spark, sf):
    return seed_rows(spark, sf).select(F.lit(1).alias("request"), F.col("id").alias("seed"), "vec", "bpm", "camelot")


@query("T2_similar", f"SELECT b.id, round({_COS}, 6) AS cosine, row_number() OVER (ORDER BY {_COS} DESC, b.id) AS place {_ALL} AND a.id = {_SEED} ORDER BY place LIMIT 20")
def similar(spark, sf):
    found = neighbours.similar(tracks(spark, sf), seed_rows(spark, sf).select(F.col("id").alias("seed"), "vec"), 20)
    return found.select("id", F.round("cosine", 6).alias("cosine"), "place")


@query("T3_nearest", f"SELECT id, round(c, 6) AS cost, row_number() OVER (ORDER BY c, id) AS place FROM (SELECT *, {_COST} AS c FROM ({_FROM})) ORDER BY place LIMIT 20")
def nearest(spark, sf):
    return neighbours.nearest(tracks(spark, sf), request(spark, sf), 20).select("id", F.round("cost", 6).alias("cost"), "place")


@query("T3_nearest_in_pool", f"SELECT id, round(c, 6) AS cost, row_number() OVER (ORDER BY c, id) AS place FROM (SELECT *, {_COST} AS c FROM ({_FROM}) WHERE camelot IN ('8A', '1A', '2B')) ORDER BY place LIMIT 20")
def nearest_in_pool(spark, sf):
    rows = tracks(spark, sf)
    pool = rows.filter(F.col("camelot").isin("8A", "1A", "2B"))
    return neighbours.nearest(rows, request(spark, sf), 20, pool=pool).select("id", F.round("cost", 6).alias("cost"), "place")


@query("T3_nearest_ahead", f"""SELECT id, round(c, 6) AS cost FROM (SELECT id, {_COST} AS c FROM (
 SELECT b.id, p.bpm AS b1, b.bpm AS b2, p.camelot AS k1, b.camelot AS k2, p.vec AS v1, b.vec AS v2 FROM ({TRACKS}) b,
  (SELECT l.id, CASE WHEN f.bpm IS NULL THEN l.bpm ELSE l.bpm + 0.5e0 * (l.bpm - f.bpm) END AS bpm, l.camelot,
    list_transform(list_zip(l.vec, f.vec), lambda z: z[1]::DOUBLE + 0.5e0 * (z[1]::DOUBLE - z[2]::DOUBLE)) AS vec
   FROM ({TRACKS}) l, ({TRACKS}) f WHERE l.id = {_SEED} AND f.id = (SELECT max(vec_id) FROM embeddings)) p WHERE b.id <> p.id)) ORDER BY c, id LIMIT 20""")
def nearest_ahead(spark, sf):
    rows = tracks(spark, sf)
    last = table(spark, sf, "embeddings").agg(F.max("vec_id")).scalar()
    before = rows.filter(F.col("id") == last).select(F.col("vec").alias("v0"), F.col("bpm").alias("b0"), F.lit(1).alias("request"))
    point = request(spark, sf).join(before, "request").select(
        "request", "seed", ahead("v0", "vec", 0.5).alias("vec"), ahead_number("b0", "bpm", 0.5).alias("bpm"), "camelot")
    return neighbours.nearest(rows, point, 20).select("id", F.round("cost", 6).alias("cost"))


@query("T4_all_neighbours", f"SELECT id, other, cosine, place FROM (SELECT a.id, b.id AS other, round({_COS}, 6) AS cosine, "
       f"row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS place {_ALL}) WHERE place <= 10")
def all_neighbours(spark, sf):
    return neighbours.knn_join(tracks(spark, sf), 10).select("id", "other", F.round("cosine", 6).alias("cosine"), "place")


@query("T19_by_distance", f"SELECT b.id, round(greatest(0e0, least(2e0, 1 - {_COS})), 6) AS distance, row_number() OVER (ORDER BY greatest(0e0, least(2e0, 1 - {_COS})), b.id) AS place "
       f"FROM ({TRACKS}) a, ({TRACKS}) b WHERE a.id = (SELECT max(vec_id) FROM embeddings)")
def by_distance(spark, sf):
    last = table(spark, sf, "embeddings").agg(F.max("vec_id")).scalar()
    rows = tracks(spark, sf)
    return neighbours.by_distance(rows, rows.filter(F.col("id") == last)).select("id", F.round("distance", 6).alias("distance"), "place")


@query("P29_seed_distances", f"SELECT b.id, round(greatest(0e0, least(2e0, 1 - {_COS})), 6) AS distance FROM ({TRACKS}) a, ({TRACKS}) b WHERE a.id = {_SEED}")
def seed_distances(spark, sf):
    from ..functions.vectors import seed_distance
    vec = seed_rows(spark, sf).select("vec").scalar()
    rows = tracks(spark, sf).withColumn("_seed", vec)
    return rows.select("id", F.round(seed_distance("vec", "_seed"), 6).alias("distance"))


_TAKEN = f"(SELECT id, song FROM ({TRACKS}) WHERE song = 'song 7' OR id = {_SEED})"
_ROSTER = f"""WITH found AS (SELECT id, song, label, {_COST} AS c FROM ({_FROM})),
 kept AS (SELECT * FROM found WHERE id NOT IN (SELECT id FROM {_TAKEN}) AND song NOT IN (SELECT song FROM {_TAKEN})),
 voices AS (SELECT label, min(c) AS cost, arg_min(id, (c, id)) AS id, count(*) AS copies FROM kept GROUP BY label)
 SELECT id, round(cost, 6) AS cost, copies, CAST(row_number() OVER (ORDER BY cost, id) AS INT) AS place FROM voices ORDER BY place LIMIT 8"""


def roster(spark, sf):
    rows = tracks(spark, sf)
    first = table(spark, sf, "embeddings").agg(F.min("vec_id")).scalar()
    taken = rows.filter((F.col("song") == "song 7") | (F.col("id") == first)).select(F.lit(1).alias("request"), "id")
    return neighbours.suggestions(rows, request(spark, sf), taken, 8, F.col("label"), F.col("song"))


@query("T5_suggestions", _ROSTER)
def suggestions(spark, sf):
    return roster(spark, sf).select("id", F.round("cost", 6).alias("cost"), "copies", "place")


@query("T6_roster_table", f"SELECT r.id, round_even(r.cost, 3) AS cost, CASE WHEN copies > 1 THEN copies END AS copies, CAST(round_even(CASE WHEN s.bpm IS NULL OR t.bpm IS NULL THEN NULL "
       "WHEN abs(t.bpm * 0.5e0 - s.bpm) <= abs(t.bpm - s.bpm) AND abs(t.bpm * 0.5e0 - s.bpm) <= abs(t.bpm * 2e0 - s.bpm) THEN t.bpm * 0.5e0 - s.bpm "
       f"WHEN abs(t.bpm - s.bpm) <= abs(t.bpm * 2e0 - s.bpm) THEN t.bpm - s.bpm ELSE t.bpm * 2e0 - s.bpm END, 0) AS INT) AS d_bpm, round_even(round(t.danceability - s.danceability, 8), 2) AS d_groove "
       f"FROM ({_ROSTER}) r JOIN ({TRACKS}) t ON t.id = r.id, ({TRACKS}) s WHERE s.id = {_SEED}")
def roster_table(spark, sf):
    from ..operators.playlists import measures_of, signed_deltas
    rows = tracks(spark, sf)
    source = seed_rows(spark, sf).select(F.lit(1).alias("request"), *[F.col(c).alias(f"_s_{c}") for c in ("bpm", "camelot", "danceability", "energy")])
    joined = roster(spark, sf).join(rows, "id").join(source, "request")
    deltas = signed_deltas(measures_of("_s_"), measures_of())
    return joined.select("id", F.bround("cost", 3).alias("cost"), F.when(F.col("copies") > 1, F.col("copies")).alias("copies"),
                         deltas["d_bpm"].alias("d_bpm"), deltas["d_groove"].alias("d_groove"))


_LAST = "(SELECT max(vec_id) FROM embeddings)"
def _from(seed):
    body = (f"SELECT b.id, b.song, a.bpm AS b1, b.bpm AS b2, a.camelot AS k1, b.camelot AS k2, a.vec AS v1, b.vec AS v2 {_ALL} AND a.id = {seed}")
    return f"SELECT id, song, {_COST} AS c FROM ({body})"


@query("T8_corridor", f"""SELECT id, round(c, 6) AS cost, CAST(row_number() OVER (ORDER BY c, id) AS INT) AS place FROM (
 SELECT arg_min(id, (c, id)) AS id, min(c) AS c FROM (SELECT f.id, f.song, f.c + t.c AS c FROM ({_from(_SEED)}) f JOIN ({_from(_LAST)}) t ON t.id = f.id)
 WHERE song NOT IN (SELECT song FROM ({TRACKS}) WHERE id IN ({_SEED}, {_LAST})) GROUP BY song) ORDER BY place LIMIT 150""")
def corridor(spark, sf):
    ends = table(spark, sf, "embeddings").agg(F.min("vec_id").alias("start"), F.max("vec_id").alias("end"))
    requests = ends.select(F.lit(1).alias("request"), "start", "end", F.lit(150).alias("reach"))
    found = neighbours.corridor(tracks(spark, sf), requests, F.col("song"))
    return found.select("id", F.round("cost", 6).alias("cost"), "place")


@query("DD10_sound_twins", f"SELECT b.id AS at, min(a.id) AS twin_of FROM ({TRACKS}) a JOIN ({TRACKS}) b ON a.id < b.id AND {_COS} >= 0.35 GROUP BY b.id")
def sound_twins(spark, sf):
    return neighbours.first_twins(tracks(spark, sf), 0.35, order="id").select("at", "twin_of")


@query("DD11_losers_at_threshold", f"SELECT id FROM ({TRACKS}) t WHERE id > (SELECT min(id) FROM ({TRACKS}) m WHERE m.song = t.song) "
       f"UNION SELECT b.id FROM ({TRACKS}) a JOIN ({TRACKS}) b ON a.id < b.id AND a.song <> b.song AND {_COS} >= 0.4")
def losers_at_threshold(spark, sf):
    from ..operators.duplicates import losers
    return losers(tracks(spark, sf).withColumn("playlist", F.lit(1)).withColumnRenamed("id", "pos"), 0.4).select(F.col("pos").alias("id"))


@query("UF1_scored_vectors", "SELECT vec_id AS id, round(1 / (1 + exp(-(embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE))), 6) AS score FROM embeddings")
def scored_vectors(spark, sf):
    def head(matrix):
        import numpy as np
        x = np.asarray(matrix, dtype=float)
        return 1.0 / (1.0 + np.exp(-(x[:, :1] + 2 * x[:, 1:2])))

    out = neighbours.batched_scores(tracks(spark, sf), head, "scores")
    return out.select("id", F.round(F.element_at("scores", 1), 6).alias("score"))
