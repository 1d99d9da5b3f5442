"""Ranks, readings and derived columns of the catalogue."""

from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions.columns import labels
from ..functions import moods
from ..operators import arcs, ranks, readings
from ..operators import tag_counts as tag_ops
from ..operators.filters import Wanted, filter_rows
from ..operators.playlists import order_by
from . import query
from .stand_ins import catalogue, rank_sql, with_catalogue


@query("A1_percentile_rank", with_catalogue(
    f"SELECT id, round({rank_sql('danceability')}, 6) AS rank FROM catalogue"))
def percentile_rank(spark, sf):
    ranked = ranks.percentile_rank(catalogue(spark, sf), "danceability", "rank")
    return ranked.select("id", F.round("rank", 6).alias("rank"))


_RANKED = "SELECT *, " + ", ".join(f"{rank_sql(c)} AS r{i}" for i, c in enumerate(ranks.INGREDIENTS)) + " FROM catalogue"


def _mix_sql(weights=(1, 1, 1, 1)):
    top = " + ".join(f"coalesce(r{i} * {w}e0, 0e0)" for i, w in enumerate(weights))
    under = " + ".join(f"CASE WHEN r{i} IS NULL THEN 0e0 ELSE {w}e0 END" for i, w in enumerate(weights))
    return f"({top}) / nullif({under}, 0e0)"


@query("A2_weighted_mean_of_ranks", with_catalogue(
    f"SELECT id, round({_mix_sql((1, 2, 1, 3))}, 6) AS mix FROM ({_RANKED})"))
def weighted_mean_of_ranks(spark, sf):
    mixed = ranks.mix(catalogue(spark, sf), ranks.INGREDIENTS, "mix", (1.0, 2.0, 1.0, 3.0))
    return mixed.select("id", F.round("mix", 6).alias("mix"))


ENERGY_SQL = (f"SELECT *, {rank_sql('mixed')} AS energy FROM "
              f"(SELECT *, {_mix_sql()} AS mixed FROM ({_RANKED}))")


@query("A3_rank_of_the_mix", with_catalogue(
    f"SELECT id, round({rank_sql('m')}, 6) AS spread FROM "
    f"(SELECT id, ((coalesce({rank_sql('bpm')}, 0e0) + coalesce({rank_sql('danceability')}, 0e0))) / "
    "nullif(CASE WHEN bpm IS NULL THEN 0e0 ELSE 1e0 END + CASE WHEN danceability IS NULL THEN 0e0 ELSE 1e0 END, 0e0) AS m "
    "FROM catalogue)"))
def rank_of_the_mix(spark, sf):
    out = ranks.spread(catalogue(spark, sf), ("bpm", "danceability"), "spread")
    return out.select("id", F.round("spread", 6).alias("spread"))


@query("A4_energy_of_rows", with_catalogue(f"SELECT id, round(energy, 6) AS energy FROM ({ENERGY_SQL})"))
def energy_of_rows(spark, sf):
    return ranks.energy(catalogue(spark, sf), key="id").select("id", F.round("energy", 6).alias("energy"))


LEVEL_SQL = "CASE WHEN {0} IS NULL THEN NULL ELSE CAST(least(10, greatest(1, 1 + floor({0} * 10))) AS INT) END"


@query("A5_levels", with_catalogue(
    f"SELECT id, {LEVEL_SQL.format('energy')} AS level FROM ({ENERGY_SQL})"))
def levels(spark, sf):
    return ranks.levels(catalogue(spark, sf), ranks.INGREDIENTS, "level").select("id", "level")


@query("flagship_ranked_filter", with_catalogue(
    f"SELECT id, path, bpm, camelot, {LEVEL_SQL.format('energy')} AS level FROM ({ENERGY_SQL}) "
    "WHERE (bpm IS NULL OR bpm BETWEEN 100 AND 140) AND camelot IN ('8A', '8B', '7A', '9A') "
    "AND (energy IS NULL OR energy BETWEEN 0.2 AND 1.0) ORDER BY bpm NULLS LAST, id LIMIT 20"))
def flagship_ranked_filter(spark, sf):
    ranked = ranks.energy(catalogue(spark, sf), key="id")
    kept = filter_rows(ranked.withColumn("genre_list", labels("genres")).withColumn("mood_list", labels("moods")),
                       Wanted(keys=["8A", "8B", "7A", "9A"], bpm=(100, 140), energy=(0.2, 1.0)))
    return order_by(kept, "bpm", ["id"]).limit(20).select("id", "path", "bpm", "camelot", fmt.decile("energy").alias("level"))


_VIBE = """CASE WHEN bpm IS NULL THEN 'Unknown-Tempo' WHEN bpm >= 0 AND bpm < 100 THEN 'Warm-Up'
 WHEN bpm >= 100 AND bpm < 118 THEN 'Groove' WHEN bpm >= 118 AND bpm < 128 THEN 'Peak-Time'
 WHEN bpm >= 128 AND bpm < 999 THEN 'High-Energy-Tempo' ELSE 'Unknown-Tempo' END"""


@query("P7_tempo_band", with_catalogue(f"SELECT id, {_VIBE} AS band FROM catalogue"))
def tempo_band(spark, sf):
    return catalogue(spark, sf).select("id", fmt.tempo_band("bpm").alias("band"))


@query("P8_vibe", with_catalogue(
    f"SELECT id, {_VIBE} || '-' || CASE WHEN energy_density IS NULL THEN 'Unknown-Energy' WHEN energy_density <= lo THEN 'Low' "
    "WHEN energy_density <= hi THEN 'Mid' ELSE 'High' END AS vibe FROM catalogue, "
    "(SELECT quantile_cont(energy_density, 0.33) AS lo, quantile_cont(energy_density, 0.66) AS hi FROM catalogue)"))
def vibe(spark, sf):
    return ranks.with_vibe(catalogue(spark, sf), level="energy_density").select("id", "vibe")


@query("P9_organise_plan", with_catalogue(
    f"SELECT path, '/dest/' || top_genre || '/' || CASE WHEN id % 7 = 0 THEN 'Unknown' ELSE {_VIBE} END || '/' "
    "|| regexp_extract(path, '([^/]*)$', 1) AS target FROM catalogue"))
def organise_plan(spark, sf):
    rows = catalogue(spark, sf).withColumn("vibe", F.when(F.col("id") % 7 != 0, fmt.tempo_band("bpm")))
    return readings.organise_plan(rows, "/dest")


@query("P25_marker_size", with_catalogue(
    "SELECT id, round(CASE WHEN hi <= lo THEN 7e0 WHEN bpm IS NULL THEN 4e0 ELSE 4e0 + coalesce(greatest(0e0, least(1e0, (bpm - lo) / (hi - lo))), 0e0) * 11 END, 6) "
    "AS marker_size FROM catalogue, (SELECT quantile_cont(bpm, 0.05) lo, quantile_cont(bpm, 0.95) hi FROM catalogue)"))
def marker_size(spark, sf):
    return ranks.with_marker_size(catalogue(spark, sf), "bpm").select("id", F.round("marker_size", 6).alias("marker_size"))


@query("P26_axis_guide", with_catalogue("SELECT round(median(duration), 6) AS guide FROM catalogue"))
def axis_guide(spark, sf):
    return ranks.axis_guide(catalogue(spark, sf), "duration").select(F.round("guide", 6).alias("guide"))


@query("P1_profile_row", with_catalogue(
    "SELECT id, round_even(bpm, 1) AS bpm, round_even(danceability, 3) AS danceability, "
    "CASE WHEN genres = '' THEN '—' ELSE split_part(genres, '; ', 1) END AS top_genre, "
    "array_to_string(list_transform(string_split(genres, '; '), lambda g: g || ':' || printf('%.2f', (id % 100) / 1e2)), '; ') AS confidence "
    "FROM catalogue"))
def profile_row(spark, sf):
    rows = catalogue(spark, sf).withColumn("genres", F.transform(labels("genres"), lambda g: F.struct(
        g.alias("label"), ((F.col("id") % 100) / 100.0).alias("value"))))
    return readings.profile_row(rows).select("id", "bpm", "danceability", "top_genre", "confidence")


@query("P2_library_frame", with_catalogue(
    f"SELECT id, round(energy, 6) AS energy, round(v, 6) AS valence, round(valence_rank, 6) AS valence_rank, x, y FROM ("
    f"SELECT *, {rank_sql('v')} AS valence_rank FROM (SELECT e.*, coalesce(valence, wv) AS v FROM ({ENERGY_SQL}) e "
    "LEFT JOIN (SELECT id AS wid, sum(p / k) / sum(1e0 / k) AS wv FROM (SELECT id, generate_subscripts(string_split(moods, '; '), 1) AS k, "
    "unnest(string_split(moods, '; ')) AS m FROM catalogue WHERE moods <> '') t, LATERAL (SELECT CASE WHEN m IN "
    "('Dark','Deep','Drama','Dramatic','Emotional','Heavy','Melancholic','Sad') THEN -1e0 WHEN m IN ('Fun','Funny','Happy','Hopeful',"
    "'Inspiring','Love','Motivational','Party','Positive','Romantic','Summer','Upbeat','Uplifting') THEN 1e0 ELSE 0e0 END AS p) "
    "GROUP BY id) w ON w.wid = e.id)) WHERE x IS NOT NULL"))
def library_frame(spark, sf):
    frame = readings.library_frame(catalogue(spark, sf))
    return frame.select("id", *[F.round(c, 6).alias(c) for c in ("energy", "valence", "valence_rank")], "x", "y")


_READING = """SELECT c.id, name AS file, CAST(round_even(bpm, 0) AS BIGINT) AS "BPM", camelot AS key,
 CASE WHEN danceability IS NULL THEN NULL ELSE printf('%.2f', greatest(0e0, least(1e0, danceability))) END AS groove,
 CASE WHEN valence_share > 0.65 THEN '↑' WHEN valence_share < 0.35 THEN '↓' END AS emotion,
 coalesce(mood, '') AS mood, folder
 FROM (SELECT *, (valence + 1e0) / 2 AS valence_share FROM catalogue) c LEFT JOIN (
   SELECT id, rare || CASE WHEN rest IS NULL THEN '' ELSE ' · ' || rest END AS mood FROM (
     SELECT id, arg_min(m, (n, k)) AS rare, string_agg(m, '; ' ORDER BY k) FILTER (WHERE m <> best) AS rest FROM (
       SELECT t.id, t.m, t.k, n, first_value(t.m) OVER (PARTITION BY t.id ORDER BY n, k) AS best FROM (
         SELECT id, generate_subscripts(string_split(moods, '; '), 1) AS k, unnest(string_split(moods, '; ')) AS m FROM catalogue WHERE moods <> '') t
       JOIN (SELECT m, count(*) AS n FROM (SELECT unnest(string_split(moods, '; ')) AS m FROM catalogue WHERE moods <> '') GROUP BY m) p ON p.m = t.m)
     GROUP BY id)) s ON s.id = c.id"""


@query("P3_reading", with_catalogue(_READING))
def reading(spark, sf):
    rows = catalogue(spark, sf).withColumn("valence_rank", (F.col("valence") + 1.0) / 2)
    shown = readings.reading(rows)
    return shown.select("id", "file", "BPM", "key", "groove", "emotion", "mood", "folder")


_SCALARS = {
    "P4_groove_pill": ("CASE WHEN danceability IS NULL THEN NULL ELSE printf('%.2f', greatest(0e0, least(1e0, danceability))) END",
                       lambda: fmt.groove_pill("danceability")),
    "P5_decile_text": ("CASE WHEN danceability IS NULL THEN NULL ELSE CAST(least(10, greatest(1, 1 + floor(danceability * 10))) AS INT) END",
                       lambda: fmt.decile("danceability")),
    "P6_emotion_arrow": ("CASE WHEN danceability > 0.5e0 + 0.15e0 THEN '↑' WHEN danceability < 0.5e0 - 0.15e0 THEN '↓' END",
                         lambda: fmt.emotion_arrow("danceability")),
    "P10_genre_parent": ("split_part(top_genre, ' - ', 1)", lambda: fmt.genre_level("top_genre", "parent")),
    "P13_duration_text": ("printf('%02d:%02d:%02d', CAST(duration AS BIGINT) * 13 // 3600, (CAST(duration AS BIGINT) * 13 % 3600) // 60, CAST(duration AS BIGINT) * 13 % 60)",
                          lambda: fmt.human_duration(F.col("duration") * 13)),
    "P14_remaining_time": ("'-' || printf('%02d:%04.1f', CAST(floor((600 - duration) / 60) AS INT), (600 - duration) - floor((600 - duration) / 60) * 60)",
                           lambda: fmt.remaining("duration", F.lit(600.0))),
    "P15_length_told": ("CASE WHEN m >= 60 THEN printf('%dh %02dm', m // 60, m % 60) ELSE printf('%dm', m) END",
                        lambda: fmt.length_told(F.col("duration") * 20)),
    "P16_energy_bar": ("CASE WHEN danceability IS NULL THEN '—' ELSE printf('%.2f', danceability) || ' ' || substr('▁▂▃▄▅▆▇█', 1 + CAST(least(7, floor(danceability * 8)) AS INT), 1) END",
                       lambda: fmt.energy_bar("danceability")),
    "P17_gain": ("round(CASE WHEN lufs * 5 < -70 THEN 1e0 ELSE least(pow(10, (-14 - lufs * 5) / 20), pow(10, 12 / 20e0)) END, 6)",
                 lambda: F.round(fmt.gain_for_target(F.col("lufs") * 5), 6)),
}


def _scalar(name, sql, make):
    with_minutes = "(SELECT *, CAST(round_even(duration * 20 / 60, 0) AS BIGINT) AS m FROM catalogue)"

    @query(name, with_catalogue(f"SELECT id, {sql} AS told FROM {with_minutes}"))
    def run(spark, sf):
        return catalogue(spark, sf).select("id", make().alias("told"))


for _name, (_sql, _make) in _SCALARS.items():
    _scalar(_name, _sql, _make)


@query("P14_clock_round_trip", with_catalogue(
    "SELECT id, printf('%02d:%04.1f', CAST(floor(duration / 60) AS INT), duration - floor(duration / 60) * 60) AS told, "
    "duration AS parsed FROM catalogue"))
def clock_round_trip(spark, sf):
    told = fmt.elapsed("duration")
    return catalogue(spark, sf).select("id", told.alias("told"), fmt.parse_clock(told).alias("parsed"))


@query("P27_scaled_heights", with_catalogue("""
SELECT id, round(CASE WHEN danceability IS NULL THEN NULL WHEN g_hi > g_lo THEN greatest(0e0, least(1e0, (danceability - g_lo) / (g_hi - g_lo)))
   ELSE 5e-1 END, 6) AS groove,
 round(CASE WHEN bpm IS NOT NULL THEN greatest(0e0, least(1e0, (bpm - mid * 0.94e0) / (mid * 1.06e0 - mid * 0.94e0))) END, 6) AS tempo,
 round((CAST(regexp_extract(camelot, '^([0-9]+)', 1) AS INT) - 1) / 11e0, 6) AS key
FROM catalogue, (SELECT quantile_cont(danceability, 0.1) AS g_lo, quantile_cont(danceability, 0.9) AS g_hi FROM catalogue),
 (SELECT bpm AS mid FROM (SELECT bpm, row_number() OVER (ORDER BY bpm) - 1 AS i, count(*) OVER () AS n FROM catalogue WHERE bpm IS NOT NULL)
  WHERE i = n // 2)"""))
def scaled_heights(spark, sf):
    rows = readings.heights(catalogue(spark, sf))
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("groove", "tempo", "key")])


_POLARITY = """CASE WHEN m IN ('Dark','Deep','Drama','Dramatic','Emotional','Heavy','Melancholic','Sad') THEN -1e0
 WHEN m IN ('Fun','Funny','Happy','Hopeful','Inspiring','Love','Motivational','Party','Positive','Romantic','Summer','Upbeat','Uplifting') THEN 1e0 ELSE 0e0 END"""
_MOOD_ROWS = """SELECT id, generate_subscripts(string_split(moods, '; '), 1) AS k, unnest(string_split(moods, '; ')) AS m
 FROM catalogue WHERE moods <> ''"""


@query("M10_word_valence", with_catalogue(
    f"SELECT id, round(v, 6) AS valence FROM catalogue LEFT JOIN (SELECT id AS i, sum({_POLARITY} / k) / sum(1e0 / k) AS v "
    f"FROM ({_MOOD_ROWS}) GROUP BY id) ON i = id"))
def word_valence(spark, sf):
    return catalogue(spark, sf).select("id", F.round(moods.word_valence("moods"), 6).alias("valence"))


@query("M12_valence_with_fallback", with_catalogue(
    f"SELECT id, round(coalesce(valence, v), 6) AS valence FROM catalogue LEFT JOIN (SELECT id AS i, sum({_POLARITY} / k) / sum(1e0 / k) AS v "
    f"FROM ({_MOOD_ROWS}) GROUP BY id) ON i = id"))
def valence_with_fallback(spark, sf):
    return catalogue(spark, sf).select("id", F.round(readings.valence(), 6).alias("valence"))


@query("M14_distinctive_label", with_catalogue(
    f"SELECT c.id, d AS distinctive FROM catalogue c LEFT JOIN (SELECT t.id, arg_min(t.m, (n, k)) AS d FROM ({_MOOD_ROWS}) t JOIN "
    f"(SELECT m, count(*) AS n FROM ({_MOOD_ROWS}) GROUP BY m) p ON p.m = t.m GROUP BY t.id) s ON s.id = c.id"))
def distinctive_label(spark, sf):
    rows = catalogue(spark, sf)
    return readings.with_summary(rows).select("id", F.col("distinctive"))


@query("A9_label_popularity", with_catalogue(f"SELECT m AS label, count(*) AS n FROM ({_MOOD_ROWS}) GROUP BY m"))
def label_popularity(spark, sf):
    return tag_ops.popularity(catalogue(spark, sf), "moods")


@query("M16_arc_measures", with_catalogue(
    f"SELECT id, round(coalesce({rank_sql('bpm')}, 0.5e0), 6) AS bpm, round(coalesce(energy_pulse, 0.5e0), 6) AS arousal, "
    f"round(coalesce(valence, 0.5e0), 6) AS valence, round(coalesce({rank_sql('danceability')}, 0.5e0), 6) AS groove FROM catalogue"))
def arc_measures(spark, sf):
    rows = arcs.measures(catalogue(spark, sf), energy="energy_pulse", valence="valence")
    return rows.select("id", *[F.round(f"arc_{c}", 6).alias(c) for c in ("bpm", "arousal", "valence", "groove")])


_CHAPTERS = """(VALUES ('Intro',0.0,0.15,0.0,0.25,0.3,0.5,0.2,0.4),('Buildup',0.15,0.4,0.25,0.6,0.4,0.6,0.75,0.95),
 ('Tension',0.4,0.7,0.6,0.8,0.0,0.2,0.8,1.0),('Climax',0.7,1.0,0.85,1.0,0.75,1.0,0.0,0.9),('Release',0.3,0.5,0.3,0.5,0.2,0.45,0.3,0.6))
 ch(chapter,b0,b1,a0,a1,v0,v1,g0,g1)"""


def _outside(v, lo, hi):
    return f"greatest({lo}::DOUBLE - {v}, {v} - {hi}::DOUBLE, 0e0)"


@query("M15_chapter_costs", with_catalogue(
    f"SELECT id, chapter, round(({_outside('b', 'b0', 'b1')} + {_outside('a', 'a0', 'a1')} + {_outside('v', 'v0', 'v1')} + "
    f"{_outside('g', 'g0', 'g1')}) / 4, 6) AS cost FROM (SELECT id, coalesce({rank_sql('bpm')}, 0.5e0) AS b, coalesce(energy_pulse, 0.5e0) AS a, "
    f"coalesce(valence, 0.5e0) AS v, coalesce({rank_sql('danceability')}, 0.5e0) AS g FROM catalogue), {_CHAPTERS}"))
def chapter_costs(spark, sf):
    rows = arcs.measures(catalogue(spark, sf), energy="energy_pulse", valence="valence")
    return arcs.chapter_costs(rows).select("id", "chapter", F.round("cost", 6).alias("cost"))
