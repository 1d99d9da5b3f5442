"""Playlists made of order lines, joined to the catalogue of parts."""

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import arcs, playlists, ranks, readings
from ..plans.ordered import positions
from ..sources import playlist_files
from . import query
from .keys import KEY_COST, SOUND_COST, TEMPO_COST
from .stand_ins import CATALOGUE, ENTRY_ORDER, POSITIONS, catalogue, entries, table

MEASURES = ("id", "path", "name", "folder", "bpm", "camelot", "danceability", "energy", "valence_rank", "duration", "moods", "genres", "top_genre")
# Measures of an entry's track; the energy is a stored rank here. A ninth of the tracks are unknown.
KNOWN = f"SELECT *, energy_pulse AS energy, valence AS valence_rank FROM ({CATALOGUE}) WHERE id % 9 <> 4"
LISTED = f"""SELECT e.playlist, e.track, e.pos, c.id IS NOT NULL AS known, c.* EXCLUDE (id) FROM ({POSITIONS}) e LEFT JOIN ({KNOWN}) c ON c.id = e.track"""


def known_rows(spark, sf):
    rows = catalogue(spark, sf)
    return rows.withColumn("energy", F.col("energy_pulse")).withColumn("valence_rank", F.col("valence")).filter(F.col("id") % 9 != 4)


def numbered(spark, sf):
    return positions(entries(spark, sf), ["playlist"], list(ENTRY_ORDER))


def listed(spark, sf):
    seq = numbered(spark, sf)
    rows = known_rows(spark, sf).select(*MEASURES).withColumnRenamed("id", "track")
    return seq.with_rows(playlists.to_catalogue(seq.rows.select("playlist", "track", "pos"), rows, "track"))


@query("J1_path_to_row", f"SELECT playlist, pos, track, known, bpm FROM ({LISTED})")
def path_to_row(spark, sf):
    return listed(spark, sf).rows.select("playlist", "pos", "track", "known", "bpm")


_N = "CAST(regexp_extract({0}, '^([0-9]+)', 1) AS INT)"
_DECILE = "CASE WHEN {0} IS NULL THEN NULL ELSE CAST(least(10, greatest(1, 1 + floor({0} * 10))) AS INT) END"
_SHIFT = ("CASE WHEN pb IS NULL OR bpm IS NULL THEN NULL WHEN abs(bpm * 0.5e0 - pb) <= abs(bpm - pb) AND abs(bpm * 0.5e0 - pb) <= abs(bpm * 2e0 - pb) "
          "THEN bpm * 0.5e0 - pb WHEN abs(bpm - pb) <= abs(bpm * 2e0 - pb) THEN bpm - pb ELSE bpm * 2e0 - pb END")
_LAGGED = f"""SELECT *, lag(bpm) OVER w AS pb, lag(camelot) OVER w AS pk, lag(danceability) OVER w AS pd, lag(energy) OVER w AS pe
 FROM ({LISTED}) WINDOW w AS (PARTITION BY playlist ORDER BY pos)"""
_DELTAS = f"""SELECT playlist, pos, track, known, CAST(round_even({_SHIFT}, 0) AS INT) AS d_bpm,
 CAST((({_N.format('camelot')} - {_N.format('pk')} + 6) % 12 + 12) % 12 - 6 AS INT) AS d_key, right(camelot, 1) <> right(pk, 1) AS d_mode,
 round_even(round(danceability - pd, 8), 2) AS d_groove, CAST({_DECILE.format('energy')} - {_DECILE.format('pe')} AS INT) AS d_energy FROM ({_LAGGED})"""


@query("W1_signed_deltas", f"SELECT playlist, pos, d_bpm, d_key, d_mode, d_groove, d_energy FROM ({_DELTAS})")
def signed_deltas(spark, sf):
    return playlists.with_deltas(listed(spark, sf)).rows.select("playlist", "pos", "d_bpm", "d_key", "d_mode", "d_groove", "d_energy")


@query("W2_delta_texts", f"""SELECT playlist, pos, printf('%+d', d_bpm) AS t_bpm, CASE WHEN d_key <> 0 THEN printf('%+d', d_key) WHEN d_mode THEN 'rel' WHEN d_key = 0 THEN '=' END AS t_key,
 replace(printf('%+.2f', d_groove), '0.', '.') AS t_groove, printf('%+d', d_energy) AS t_energy, CAST(sign(d_bpm) AS INT) AS way_bpm FROM ({_DELTAS})""")
def delta_texts(spark, sf):
    rows = playlists.with_deltas(listed(spark, sf)).rows.withColumns(playlists.delta_texts())
    return rows.select("playlist", "pos", "t_bpm", "t_key", "t_groove", "t_energy", "way_bpm")


@query("W3_chain_table", f"SELECT playlist, pos + 1 AS number, track, d_bpm, d_key FROM ({_DELTAS}) WHERE known")
def chain_table(spark, sf):
    return playlists.chain_table(listed(spark, sf)).select("playlist", "number", "track", "d_bpm", "d_key")


@query("W4_playlist_costs", f"""SELECT playlist, pos + 1 AS number, track, CASE WHEN pos > 0 AND v1 IS NOT NULL AND v2 IS NOT NULL THEN
 round_even(({SOUND_COST} + {TEMPO_COST} + {KEY_COST}) / 3, 3) END AS from_previous FROM (
 SELECT *, lag(v2) OVER w AS v1, lag(b2) OVER w AS b1, lag(k2) OVER w AS k1 FROM (SELECT p.playlist, p.pos, p.track, t.embedding AS v2, bpm AS b2, camelot AS k2
 FROM ({LISTED}) p LEFT JOIN embeddings t ON t.vec_id = p.track) WINDOW w AS (PARTITION BY playlist ORDER BY pos))""")
def playlist_costs(spark, sf):
    seq = listed(spark, sf)
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("track"), F.col("embedding").alias("vec"))
    return playlists.playlist_table(seq.with_rows(seq.rows.join(vecs, "track", "left"))).select(
        "playlist", "number", "track", "from_previous")


@query("W5_regions", f"""SELECT playlist, split_part(top_genre, ' - ', 1) AS chapter, min(pos) AS start, max(pos) AS "end" FROM (
 SELECT *, pos - row_number() OVER (PARTITION BY playlist, split_part(top_genre, ' - ', 1) ORDER BY pos) AS island FROM ({LISTED}))
 WHERE top_genre IS NOT NULL GROUP BY playlist, island, split_part(top_genre, ' - ', 1)""")
def regions(spark, sf):
    seq = listed(spark, sf)
    seq = seq.with_rows(seq.rows.withColumn("chapter", F.split_part("top_genre", F.lit(" - "), F.lit(1))))
    return playlists.regions(seq, "chapter").select("playlist", "chapter", "start", "end")


@query("W15_name_doubles", f"SELECT e.playlist, e.pos, f.pos AS copy_of FROM (SELECT *, track % 50 AS song FROM ({POSITIONS})) e JOIN "
       f"(SELECT playlist, track % 50 AS song, min(pos) AS pos FROM ({POSITIONS}) GROUP BY ALL) f ON f.playlist = e.playlist AND f.song = e.song WHERE e.pos > f.pos")
def name_doubles(spark, sf):
    rows = numbered(spark, sf).rows.withColumn("song", F.col("track") % 50)
    return playlists.doubles(rows, "song").select("playlist", "pos", "copy_of")


@query("W16_moved_row", f"""SELECT playlist, pos, CASE WHEN n < 2 THEN pos WHEN pos = 1 THEN least(n, 4) - 1 WHEN pos > 1 AND pos <= least(n, 4) - 1 THEN pos - 1 ELSE pos END AS new_pos
 FROM (SELECT *, count(*) OVER (PARTITION BY playlist) AS n FROM ({POSITIONS}))""")
def moved_row(spark, sf):
    rows = numbered(spark, sf).rows
    sizes = rows.groupBy("playlist").agg(F.count("*").alias("n"))
    return playlists.moved(rows.join(sizes, "playlist"), 1, 4, F.col("n")).select("playlist", "pos", "new_pos")


@query("W16_several_moves", f"""SELECT playlist, pos, CASE WHEN n = 1 THEN pos WHEN n = 2 THEN pos ELSE list_position(
 list_concat([2, 0], list_filter(range(n), lambda x: x NOT IN (0, 2))), pos) - 1 END AS new_pos
 FROM (SELECT playlist, pos, count(*) OVER (PARTITION BY playlist) AS n FROM ({POSITIONS}))""")
def several_moves(spark, sf):
    rows = numbered(spark, sf).rows.select("playlist", "pos")
    lists = rows.select("playlist").distinct()
    moves = lists.withColumn("m", F.explode(F.array(
        F.struct(F.lit(0).alias("row"), F.lit(1).alias("place")), F.struct(F.lit(2).alias("row"), F.lit(1).alias("place"))))).select(
            "playlist", "m.row", "m.place")
    return playlists.moved_all(rows, moves).select("playlist", "pos", "new_pos")


# Every entry with an even track moves to a place told by its track: one round of the recursion takes one entry out and puts it back.
_ASKED = f"SELECT playlist, pos AS row, track % 11 AS place FROM ({POSITIONS}) WHERE track % 2 = 0"


@query("W16_many_moves", f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY row) AS i FROM ({_ASKED})),
 o AS (SELECT playlist, 0 AS i, list(pos ORDER BY pos) AS l FROM ({POSITIONS}) GROUP BY playlist UNION ALL
  SELECT playlist, i, list_concat(list_concat(list_slice(rest, 1, goal), [row]), list_slice(rest, goal + 1, len(rest))) FROM (SELECT o.playlist, m.i, m.row, list_filter(o.l, lambda x: x <> m.row) AS rest,
   greatest(1, least(len(o.l), m.place)) - 1 AS goal FROM o JOIN m ON m.playlist = o.playlist AND m.i = o.i + 1))
 SELECT playlist, unnest(l) AS pos, unnest(range(len(l))) AS new_pos FROM (SELECT playlist, arg_max(l, i) AS l FROM o GROUP BY playlist)""")
def many_moves(spark, sf):
    rows = numbered(spark, sf).rows
    asked = rows.filter(F.col("track") % 2 == 0).select("playlist", F.col("pos").alias("row"), (F.col("track") % 11).alias("place"))
    return playlists.moved_all(rows, asked).select("playlist", "pos", "new_pos")


_INCOMING = f"SELECT playlist, CASE WHEN pos % 2 = 0 THEN track ELSE track + 1 END AS track, pos FROM ({POSITIONS})"


@query("W17_appended", f"""SELECT playlist, track, row_number() OVER (PARTITION BY playlist ORDER BY s, pos) - 1 AS new_pos FROM (
 SELECT playlist, track, min((s, pos)).s AS s, min((s, pos)).pos AS pos FROM (SELECT playlist, track, {{'s': s, 'pos': pos}} AS sp, s, pos FROM (
  SELECT *, 0 AS s FROM ({POSITIONS}) UNION ALL BY NAME SELECT *, 1 AS s FROM ({_INCOMING}))) GROUP BY playlist, track)""".replace(
      "min((s, pos)).s AS s, min((s, pos)).pos AS pos", "min(sp).s AS s, min(sp).pos AS pos"))
def appended(spark, sf):
    rows = numbered(spark, sf).rows.select("playlist", "track", "pos")
    coming = rows.withColumn("track", F.when(F.col("pos") % 2 == 0, F.col("track")).otherwise(F.col("track") + 1))
    return playlists.appended(rows, coming)[0].select("playlist", "track", "new_pos")


@query("W17_skipped", f"""SELECT playlist, track, min(pos) AS arrived FROM ({_INCOMING}) i GROUP BY playlist, track
 HAVING count(*) > 1 OR (playlist, track) IN (SELECT (playlist, track) FROM ({POSITIONS}))""")
def skipped(spark, sf):
    rows = numbered(spark, sf).rows.select("playlist", "track", "pos")
    coming = rows.withColumn("track", F.when(F.col("pos") % 2 == 0, F.col("track")).otherwise(F.col("track") + 1))
    return playlists.appended(rows, coming)[1]


@query("W18_chapter_of_place", f"""SELECT playlist, pos, CASE WHEN n = 1 THEN 0 WHEN s < 0.15e0 THEN 0 WHEN s < 0.15e0 + 0.25e0 THEN 1 WHEN s < 0.15e0 + 0.25e0 + 0.2e0 THEN 2
 WHEN s < 0.15e0 + 0.25e0 + 0.2e0 + 0.25e0 THEN 3 ELSE 4 END AS chapter FROM (SELECT playlist, pos, n, pos / greatest(1, n - 1) * (1 - 1e-9) AS s
 FROM (SELECT *, count(*) OVER (PARTITION BY playlist) AS n FROM ({POSITIONS})))""")
def chapter_of_place(spark, sf):
    rows = numbered(spark, sf).rows
    sizes = rows.groupBy("playlist").agg(F.count("*").alias("n"))
    return rows.join(sizes, "playlist").select("playlist", "pos", arcs.chapter_of_place(F.col("pos"), F.col("n")).alias("chapter"))


@query("A6_place_in_playlist", f"""SELECT playlist, pos, round((row_number() OVER (PARTITION BY playlist ORDER BY danceability NULLS FIRST, pos) - 1) / greatest(1, count(*) OVER (PARTITION BY playlist) - 1), 6) AS share FROM ({LISTED})""")
def place_in_playlist(spark, sf):
    rows = listed(spark, sf).rows
    return ranks.place_in_group(rows, ["playlist"], ["danceability", "pos"], "share").select("playlist", "pos", F.round("share", 6).alias("share"))


_TIME = "CASE WHEN m >= 60 THEN printf('%dh %02dm', m // 60, m % 60) ELSE printf('%dm', m) END"
_SHARED = f"SELECT track FROM (SELECT DISTINCT playlist, track FROM ({POSITIONS})) GROUP BY track HAVING count(*) > 1"


@query("A23_shelf_rows", f"""SELECT playlist, tracks, CASE WHEN lo IS NULL THEN '—' WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '–' || hi END AS bpm,
 coalesce(keys, '—') AS keys, {_TIME} AS length, shared, round(mean, 6) AS energy FROM (
 SELECT l.playlist, count(*) AS tracks, CAST(round_even(min(bpm), 0) AS BIGINT) AS lo, CAST(round_even(max(bpm), 0) AS BIGINT) AS hi, avg(energy) AS mean,
  CAST(round_even(sum(coalesce(duration, 0)) / 60, 0) AS BIGINT) AS m, count(s.track) AS shared, any_value(k.keys) AS keys
 FROM ({LISTED}) l LEFT JOIN ({_SHARED}) s ON s.track = l.track LEFT JOIN (
  SELECT playlist, string_agg(camelot, ' ' ORDER BY {_N.format('camelot')} * 2 + CASE WHEN right(camelot, 1) = 'B' THEN 1 ELSE 0 END) AS keys
  FROM (SELECT DISTINCT playlist, camelot FROM ({LISTED}) WHERE camelot IS NOT NULL) GROUP BY playlist) k ON k.playlist = l.playlist GROUP BY l.playlist)""")
def shelf_rows(spark, sf):
    rows = entries(spark, sf).select("playlist", "track")
    cat = known_rows(spark, sf).select(*MEASURES).withColumnRenamed("id", "track")
    mean = rows.join(cat, "track", "left").groupBy("playlist").agg(F.round(F.avg("energy"), 6).alias("energy"))
    return playlists.shelf_rows(rows, cat).drop("energy").join(mean, "playlist")


@query("A24_shelf_summary", f"""SELECT playlists, tracks, {_TIME} AS length, (SELECT count(*) FROM ({_SHARED})) AS shared FROM (
 SELECT count(DISTINCT playlist) AS playlists, count(*) AS tracks, CAST(round_even(sum(coalesce(duration, 0)) / 60, 0) AS BIGINT) AS m FROM ({LISTED}))""")
def shelf_summary(spark, sf):
    rows = entries(spark, sf).select("playlist", "track")
    return playlists.shelf_summary(rows, known_rows(spark, sf).withColumnRenamed("id", "track"))


@query("J15_shared_tracks", f"""SELECT playlist, d.track, homes FROM (SELECT DISTINCT playlist, track FROM ({POSITIONS})) d JOIN (
 SELECT track, count(DISTINCT playlist) AS homes FROM ({POSITIONS}) GROUP BY track HAVING count(DISTINCT playlist) > 1) s ON s.track = d.track""")
def shared_tracks(spark, sf):
    return playlists.shared_tracks(entries(spark, sf)).select("playlist", "track", "homes")


@query("J15_also_in", f"""SELECT playlist, track, homes - 1 AS others, CASE WHEN f <> playlist THEN f ELSE l END AS also_in FROM (
 SELECT playlist, track, count(*) OVER w AS homes, min(playlist) OVER w AS f, max(playlist) OVER w AS l FROM (SELECT DISTINCT playlist, track FROM ({POSITIONS}))
 WINDOW w AS (PARTITION BY track)) WHERE homes > 1""")
def also_in(spark, sf):
    return playlists.shelf_shared_text(entries(spark, sf))


@query("J9_external_plan", """SELECT l_orderkey AS playlist, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_partkey)) AS found,
 count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_partkey)) AS missing,
 l_orderkey IN (SELECT c_custkey FROM customer) AS replaces FROM lineitem GROUP BY l_orderkey""")
def external_plan(spark, sf):
    library = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("track"))
    existing = table(spark, sf, "customer").select(F.col("c_custkey").alias("playlist"))
    return playlists.external_plan(entries(spark, sf), library, existing)


@query("J9_external_missing", "SELECT l_orderkey AS playlist, l_partkey AS track FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def external_missing(spark, sf):
    library = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("track"))
    return playlists.external_missing(entries(spark, sf), library).select("playlist", "track")


_ASKED = f"""SELECT e.playlist, e.pos, e.track % 12 = 5 AS gone, CASE WHEN e.track % 12 = 5 THEN '/nowhere/' || e.track || '.x' WHEN e.track % 4 = 1
 THEN '/other/' || regexp_extract(c.path, '([^/]*)$', 1) ELSE c.path END AS path FROM ({POSITIONS}) e JOIN ({CATALOGUE}) c ON c.id = e.track"""


@query("J2_playlist_positions", f"""WITH cat AS (SELECT id, path, regexp_extract(path, '([^/]*)$', 1) AS f FROM ({CATALOGUE})), hit AS (
 SELECT a.playlist, a.pos, coalesce(p.id, n.id) AS id FROM ({_ASKED}) a LEFT JOIN (SELECT path, min(id) AS id FROM cat GROUP BY path) p ON p.path = a.path
 LEFT JOIN (SELECT f, min(id) AS id FROM cat GROUP BY f) n ON n.f = regexp_extract(a.path, '([^/]*)$', 1))
 SELECT playlist, id, min(pos) AS first_pos, true AS found FROM hit WHERE id IS NOT NULL GROUP BY playlist, id
 UNION ALL SELECT playlist, id, pos, false FROM hit WHERE id IS NULL""")
def playlist_positions(spark, sf):
    rows = numbered(spark, sf).rows.select("playlist", "track", "pos")
    cat = catalogue(spark, sf)
    joined = rows.join(cat.select(F.col("id").alias("track"), "path"), "track")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    path = (F.when(F.col("track") % 12 == 5, F.concat(F.lit("/nowhere/"), F.col("track").cast("string"), F.lit(".x")))
            .when(F.col("track") % 4 == 1, F.concat(F.lit("/other/"), name)).otherwise(F.col("path")))
    asked = joined.select("playlist", "pos", path.alias("path"))
    return playlists.playlist_positions(asked, cat).select("playlist", "id", "first_pos", "found")


@query("U6_collection_keys", f"""SELECT track, row_number() OVER (ORDER BY p, q, track) AS key FROM (SELECT track, min(playlist) AS p, arg_min(pos, (playlist, pos)) AS q
 FROM ({POSITIONS}) GROUP BY track)""")
def collection_keys(spark, sf):
    return playlists.collection(numbered(spark, sf).rows, ["playlist", "pos"])


@query("T1_ordered_by_key", f"""SELECT id, row_number() OVER (ORDER BY {_N.format('camelot')} * 2 + CASE WHEN right(camelot, 1) = 'B' THEN 1 ELSE 0 END DESC NULLS LAST, id) AS place FROM ({CATALOGUE})""")
def ordered_by_key(spark, sf):
    from ..plans.ordered import indexed
    rank = keys.wheel_rank("camelot")
    return indexed(catalogue(spark, sf), [rank.desc_nulls_last(), F.col("id")], "at").select("id", (F.col("at") + 1).alias("place"))


@query("P34_board_rows", f"""SELECT b.playlist, b.pos + 1 AS number, CASE WHEN length(coalesce(name, '?')) <= 22 THEN coalesce(name, '?') END AS label, d_bpm, d_energy,
 round(CASE WHEN danceability IS NULL THEN 0.5e0 ELSE greatest(0e0, least(1e0, (danceability - lo) / (hi - lo))) END, 6) AS height
 FROM ({LISTED}) b JOIN ({_DELTAS}) d ON d.playlist = b.playlist AND d.pos = b.pos,
 (SELECT quantile_cont(danceability, 0.1) AS lo, quantile_cont(danceability, 0.9) AS hi FROM ({KNOWN}))""")
def board_rows(spark, sf):
    board = playlists.with_deltas(listed(spark, sf)).rows
    shown = readings.heights(board.withColumn("groove_value", F.col("danceability")), known_rows(spark, sf))
    return shown.select("playlist", (F.col("pos") + 1).alias("number"), playlists.shelf_label(F.coalesce("name", F.lit("?"))).alias("label"),
                        "d_bpm", "d_energy", F.round(F.coalesce("groove", F.lit(0.5)), 6).alias("height"))


@query("S10_m3u8_lines", f"""SELECT playlist, line_no, line FROM (
 SELECT playlist, -1 AS line_no, '#EXTM3U' AS line FROM (SELECT DISTINCT playlist FROM ({POSITIONS})) UNION ALL
 SELECT playlist, pos * 2, '#EXTINF:' || CAST(CAST(round_even(c.duration, 0) AS BIGINT) AS VARCHAR) || ',' || c.name FROM ({POSITIONS}) p JOIN ({CATALOGUE}) c ON c.id = p.track UNION ALL
 SELECT playlist, pos * 2 + 1, c.path FROM ({POSITIONS}) p JOIN ({CATALOGUE}) c ON c.id = p.track)""")
def m3u8_lines(spark, sf):
    rows = numbered(spark, sf).rows.join(catalogue(spark, sf).withColumnRenamed("id", "track"), "track")
    return playlist_files.m3u8_lines(rows.withColumn("artist", F.lit("")))
