"""Frames, sections, cues and strokes out of vectors, events and conversations."""

from pyspark.sql import functions as F

from ..operators import paths, readings, segments, structure
from ..plans.ordered import Ordered, already_ordered, positions
from . import query
from .stand_ins import catalogue, table, tracks, with_catalogue

FRAMES = "SELECT vec_id AS track, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings"


def frames(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("track"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select("track", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


def frame_seq(spark, sf, **columns):
    return already_ordered(frames(spark, sf).withColumns(columns), ["track"], "pos")


@query("W8_active_regions", f"""WITH f AS (SELECT track, pos, pos * 0.1e0 AS t, abs(v) >= 0.1e0 AS a FROM ({FRAMES})),
 n AS (SELECT *, lead(t) OVER w AS nt, CASE WHEN a AND lag(a) OVER w THEN 0 ELSE 1 END AS c FROM f WINDOW w AS (PARTITION BY track ORDER BY pos)),
 r AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY pos) AS run FROM n),
 s AS (SELECT track, min(t) AS st, arg_max(coalesce(nt, t), pos) AS en FROM r WHERE a GROUP BY track, run),
 g AS (SELECT *, CASE WHEN st - lag(en) OVER (PARTITION BY track ORDER BY st) <= 0.15e0 THEN 0 ELSE 1 END AS c FROM s),
 m AS (SELECT track, min(st) AS start, max(en) AS "end" FROM (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY st) AS k FROM g) GROUP BY track, k)
 SELECT track, round(start, 6) AS start, round("end", 6) AS "end" FROM m WHERE "end" - start >= 0.45e0""")
def active_regions(spark, sf):
    seq = frame_seq(spark, sf, t=F.col("pos") * 0.1, ratio=F.abs("v"))
    found = segments.active_regions(seq, 0.1, 0.15, 0.45)
    return found.select("track", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_SECTIONS = """SELECT conv_id AS track, turn AS ord, role AS label, turn * 10e0 AS start, turn * 10e0 + 8 AS stop,
 ((conv_id * 7 + turn * 13) % 21) / 2e1 AS energy, ((conv_id * 5 + turn * 11) % 20) / 2e1 AS bass, ((conv_id * 3 + turn * 17) % 19 - 6) / 2e1 AS slope FROM conversations"""
_CONV = "SELECT *, row_number() OVER (PARTITION BY track ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY track) AS n FROM (" + _SECTIONS + ")"


def sections(spark, sf):
    rows = spark.sql(_SECTIONS.replace("FROM conversations", "FROM {c}"), c=table(spark, sf, "conversations"))
    return positions(rows, ["track"], ["ord"])


@query("W6_phrase_ends", f"SELECT track, ord, coalesce(lead(start) OVER (PARTITION BY track ORDER BY ord), stop) AS phrase_end FROM ({_SECTIONS})")
def phrase_ends(spark, sf):
    return segments.phrase_ends(sections(spark, sf), end="stop").select("track", "ord", "phrase_end")


@query("W7_merged_sections", f"""SELECT track, label, min(start) AS start, max(stop) AS "end", max(energy) AS energy FROM (SELECT *, pos - row_number() OVER (PARTITION BY track, label ORDER BY pos) AS k FROM ({_CONV})) GROUP BY track, label, k""")
def merged_sections(spark, sf):
    seq = sections(spark, sf)
    return segments.merge_sections(seq.with_rows(seq.rows.withColumnRenamed("stop", "end"))).drop("run")


_DROP = "(energy >= 0.7e0 AND bass >= 0.5e0 AND slope < 0.35e0)"


@query("W10_section_labels", f"""SELECT track, ord, CASE WHEN n = 1 THEN 'Groove' WHEN n = 2 THEN CASE WHEN pos = 0 THEN 'Intro' ELSE 'Outro' END
 WHEN pos = 0 AND NOT d THEN 'Intro' WHEN pos = n - 1 AND NOT d THEN 'Outro' WHEN d THEN 'Drop/Chorus'
 WHEN pos > 0 AND pos < n - 1 AND slope < 0.35e0 AND bass < 0.5e0 AND energy < 0.7e0 AND energy < pe THEN 'Breakdown'
 WHEN (slope >= 0.35e0 AND ne >= energy) OR (nd AND energy < ne) THEN 'Build-up' ELSE 'Groove' END AS label FROM (
 SELECT *, {_DROP} AS d, lag(energy) OVER w AS pe, lead(energy) OVER w AS ne, lead({_DROP}) OVER w AS nd FROM ({_CONV}) WINDOW w AS (PARTITION BY track ORDER BY pos))""")
def section_labels(spark, sf):
    seq = sections(spark, sf)
    return segments.label_sections(seq.with_rows(seq.rows.drop("label"))).rows.select("track", "ord", "label")


@query("W9_cut_sections", """WITH b AS (SELECT conv_id AS track, greatest(0e0, least((turn * 37 % 90) * 1e0, 75e0)) AS start FROM conversations UNION SELECT DISTINCT conv_id, 0e0 FROM conversations),
 s AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY track ORDER BY start), 75e0) AS "end" FROM b)
 SELECT track, start, "end", round(("end" - start) / (24e1 / (100 + track % 50)), 6) AS bars FROM s""")
def cut_sections(spark, sf):
    c = table(spark, sf, "conversations")
    marks = c.select(F.col("conv_id").alias("track"), (F.col("turn") * 37 % 90).cast("double").alias("time"))
    known = c.select(F.col("conv_id").alias("track")).distinct().withColumns({"duration": F.lit(75.0), "bpm": (100 + F.col("track") % 50).cast("double")})
    return segments.cut_sections(marks, known).rows.select("track", "start", "end", F.round("bars", 6).alias("bars"))


_REGIONS = "SELECT conv_id AS track, turn * 10e0 + (turn * 7 + conv_id) % 9 AS start, turn * 10e0 + (turn * 7 + conv_id) % 9 + (conv_id + turn) % 14 AS stop FROM conversations"


def regions(spark, sf):
    return spark.sql(_REGIONS.replace("FROM conversations", "FROM {c}"), c=table(spark, sf, "conversations")).withColumnRenamed("stop", "end")


@query("J11_vocal_cover", f"""SELECT s.track, s.ord, round(coalesce(sum(least(r.stop, s.stop) - greatest(r.start, s.start)) FILTER (WHERE r.start IS NOT NULL), 0) / (s.stop - s.start), 6) AS vocal_score,
 coalesce(sum(least(r.stop, s.stop) - greatest(r.start, s.start)) FILTER (WHERE r.start IS NOT NULL), 0) / (s.stop - s.start) >= 0.1 AS vocal
 FROM ({_SECTIONS}) s LEFT JOIN ({_REGIONS}) r ON r.track = s.track AND r.stop > s.start AND r.start < s.stop GROUP BY s.track, s.ord, s.start, s.stop""")
def vocal_cover(spark, sf):
    rows = sections(spark, sf).rows.withColumnRenamed("stop", "end")
    return segments.vocal_cover(rows, regions(spark, sf), width=15.0).select("track", "ord", F.round("vocal_score", 6).alias("vocal_score"), "vocal")


@query("A30_section_features", f"""WITH f AS (SELECT track % 50 AS track, pos * 1e0 + track / 1e4 AS t, abs(v) AS total, abs(v) / (1 + pos % 3) AS low FROM ({FRAMES})),
 s AS (SELECT track, ord, ord * 16e0 AS start, ord * 16e0 + 16 AS stop FROM (SELECT DISTINCT track FROM f) a, range(4) r(ord)),
 m AS (SELECT s.track, s.ord, total, low, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s.track, s.ord) AS n FROM s JOIN f ON f.track = s.track AND t >= start AND t < stop WINDOW w AS (PARTITION BY s.track, s.ord ORDER BY t)),
 e AS (SELECT track, ord, avg(total) AS e, avg(low) AS b, avg(total) FILTER (WHERE i < n // 3) AS h, avg(total) FILTER (WHERE i >= n - n // 3) AS l FROM m GROUP BY track, ord)
 SELECT track, ord, round(e / max(e) OVER (PARTITION BY track), 6) AS energy, round(b / max(b) OVER (PARTITION BY track), 6) AS bass, round((l - h) / e, 6) AS slope FROM e""")
def section_features(spark, sf):
    rows = frames(spark, sf).select((F.col("track") % 50).alias("track"), (F.col("pos") * 1.0 + F.col("track") / 1e4).alias("t"),
                                    F.abs("v").alias("total"), (F.abs("v") / (1 + F.col("pos") % 3)).alias("low"))
    cuts = rows.select("track").distinct().withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumns(
        {"start": F.col("ord") * 16.0, "end": F.col("ord") * 16.0 + 16.0})
    told = segments.section_features(cuts, rows)
    return told.select("track", "ord", *[F.round(c, 6).alias(c) for c in ("energy", "bass", "slope")])


# --- cues: three rows out of every turn -----------------------------------------------------
_CUES = """SELECT conv_id AS track, 'sec' || turn AS id, 'phrase_start' AS kind, role AS label, ((turn * 29 + conv_id) % 83) * 1e0 AS start, turn % 2 = 0 AS hot FROM conversations
 UNION ALL SELECT conv_id, 'vs' || turn, 'vocal_start', 'Vocal start', ((turn * 31 + conv_id) % 79) * 1e0, turn % 3 = 0 FROM conversations WHERE (conv_id + turn) % 5 <> 0
 UNION ALL SELECT conv_id, 've' || turn, 'vocal_end', 'Vocal end', ((turn * 31 + conv_id) % 79) * 1e0 + (conv_id + turn) % 4, false FROM conversations WHERE (conv_id + turn) % 7 <> 0"""


def cues(spark, sf):
    return spark.sql(_CUES.replace("FROM conversations", "FROM {c}"), c=table(spark, sf, "conversations"))


_HALVES = f"""SELECT coalesce(s.track, e.track) AS track, s.id AS start_id, e.id AS end_id, s.start AS st, e.start AS en, coalesce(e.start > s.start, false) AS paired
 FROM (SELECT *, substr(id, 3) AS no FROM ({_CUES}) WHERE kind = 'vocal_start') s FULL JOIN (SELECT *, substr(id, 3) AS no FROM ({_CUES}) WHERE kind = 'vocal_end') e ON s.track = e.track AND s.no = e.no"""


@query("J16_paired_halves", f"SELECT track, start_id, end_id, paired FROM ({_HALVES})")
def paired_halves(spark, sf):
    return segments.pair_halves(cues(spark, sf)).select("track", "start_id", "end_id", "paired")


_TWO = f"""WITH h AS ({_HALVES}), p AS (SELECT track, id, row_number() OVER (PARTITION BY track ORDER BY start, id) AS r FROM ({_CUES}) WHERE kind = 'phrase_start'),
 g AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY st, start_id) AS r FROM h WHERE paired),
 slots AS (SELECT track, id, 'Cue ' || r AS slot FROM p WHERE r <= 8 UNION ALL SELECT track, start_id, 'Loop ' || r FROM g WHERE r <= 8 UNION ALL SELECT track, end_id, 'Loop ' || r FROM g WHERE r <= 8)"""


@query("W11_two_bank_plan", f"""{_TWO} SELECT c.track, c.id, coalesce(slot, '') AS slot, CASE WHEN slot IS NOT NULL THEN 'placed' WHEN EXISTS (SELECT 1 FROM h WHERE NOT paired AND h.track = c.track AND coalesce(h.start_id, h.end_id) = c.id)
 THEN 'unpaired' ELSE 'dropped' END AS state FROM ({_CUES}) c LEFT JOIN slots s ON s.track = c.track AND s.id = c.id""")
def two_bank_plan(spark, sf):
    return segments.two_bank_plan(cues(spark, sf)).select("track", "id", "slot", "state")


_ONE = f"""WITH m AS (SELECT track, id, start, NULL::DOUBLE AS stop, hot FROM ({_CUES}) WHERE kind = 'phrase_start' UNION ALL
 SELECT h.track, h.start_id, st, en, c.hot FROM ({_HALVES}) h JOIN ({_CUES}) c ON c.track = h.track AND c.id = h.start_id WHERE paired),
 a AS (SELECT track, id, row_number() OVER (PARTITION BY track ORDER BY start, id) AS r FROM m WHERE hot),
 plan AS (SELECT m.track, m.id, start, stop, CASE WHEN r <= 8 THEN r END AS pad FROM m LEFT JOIN a ON a.track = m.track AND a.id = m.id)"""


@query("W12_one_bank_plan", f"""{_ONE} SELECT track, id, start, stop AS "end", CAST(pad AS INT) AS pad, CASE WHEN pad IS NOT NULL THEN 'Hot ' ELSE 'Memory ' END || CASE WHEN stop IS NULL THEN 'cue' ELSE 'loop' END
 || CASE WHEN pad IS NOT NULL THEN ' ' || substr('ABCDEFGH', CAST(pad AS INT), 1) ELSE '' END AS slot FROM plan""")
def one_bank_plan(spark, sf):
    return segments.one_bank_plan(cues(spark, sf)).select("track", "id", "start", "end", "pad", "slot")


_TAKEN = "SELECT DISTINCT conv_id AS track, CAST(1 + turn % 8 AS INT) AS pad FROM conversations WHERE (conv_id + turn) % 3 = 0"


@query("W13_fitted_pads", f"""{_ONE}, free AS (SELECT t.track, p AS pad, row_number() OVER (PARTITION BY t.track ORDER BY p) AS r FROM (SELECT DISTINCT track FROM plan) t, range(1, 9) x(p)
   WHERE NOT EXISTS (SELECT 1 FROM ({_TAKEN}) k WHERE k.track = t.track AND k.pad = p)), asking AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY start, id) AS r FROM plan WHERE pad IS NOT NULL)
 SELECT p.track, p.id, CAST(f.pad AS INT) AS pad FROM plan p LEFT JOIN asking a ON a.track = p.track AND a.id = p.id LEFT JOIN free f ON f.track = a.track AND f.r = a.r""")
def fitted_pads(spark, sf):
    taken = spark.sql(_TAKEN.replace("FROM conversations", "FROM {c}"), c=table(spark, sf, "conversations"))
    return segments.fit_to_free(segments.one_bank_plan(cues(spark, sf)), taken).select("track", "id", "pad")


@query("W14_marker_checks", f"""SELECT track, count(*) AS markers, count_if(NOT pad BETWEEN 1 AND 8) AS out_of_range, count_if(pad BETWEEN 1 AND 8) - count(DISTINCT CASE WHEN pad BETWEEN 1 AND 8 THEN pad END) AS repeated,
 count_if(start < 0) AS early, count_if(stop <= start) AS backward FROM (SELECT track, start - 5 AS start, start + (CAST(start AS INT) % 9) - 7 AS stop, CAST(start AS INT) % 10 AS pad FROM ({_CUES})) GROUP BY track""")
def marker_checks(spark, sf):
    rows = cues(spark, sf).select("track", (F.col("start") - 5).alias("start"), (F.col("start") + F.col("start").cast("int") % 9 - 7).alias("end"),
                                  (F.col("start").cast("int") % 10).alias("pad"))
    return segments.check_markers(rows)


@query("P32_cue_values", f"""{_ONE} SELECT track, id, CAST(start * 1000 AS BIGINT) AS in_ms, CAST(start * 1000 AS BIGINT) * 150 // 1000 AS in_frame, CAST(coalesce(pad, 0) AS INT) AS kind,
 CASE WHEN stop IS NULL THEN -1 ELSE CAST(greatest(start, stop) * 1000 AS BIGINT) END AS out_ms, CASE WHEN stop IS NULL THEN 0 ELSE CAST(greatest(start, stop) * 1000 AS BIGINT) * 150 // 1000 END AS out_frame FROM plan""")
def cue_values(spark, sf):
    rows = segments.one_bank_plan(cues(spark, sf))
    values = segments.cue_values()
    return rows.select("track", "id", *[values[c].alias(c) for c in ("in_ms", "in_frame", "kind", "out_ms", "out_frame")])


# --- tracks with nested sections, as they are at rest: four of them to every part ------------
_PARTS = "SELECT p_partkey AS track, k, k * 2e1 + p_partkey % 7 AS start, k * 2e1 + p_partkey % 7 + 12 AS stop FROM part, range(4) r(k)"


def nested(spark, sf):
    four = F.sequence(F.lit(0), F.lit(3))
    start = lambda k: k * 20.0 + F.col("p_partkey") % 7
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("track"), F.lit(120.0).alias("bpm"), F.transform(four, lambda k: F.struct(
            start(k).alias("start"), (start(k) + 12).alias("end"), F.concat(F.lit("S"), k).alias("label"), (k % 2 == 0).alias("vocal"),
            ((start(k) + 12) / 8).alias("bars"))).alias("sections"),
        F.transform(four, lambda k: F.struct(start(k).alias("start"), (start(k) + 12).alias("end"))).alias("regions"),
        F.transform(four, lambda k: F.struct(start(k).alias("time"), F.lit(0.5).alias("confidence"), F.lit("Rise").alias("label"))).alias("boundaries"))


@query("P31_cue_rows", f"""SELECT track, 'sec' || k AS id, 'phrase_start' AS kind, start, round_even((stop - start) / 0.5e0, 1) AS beats FROM ({_PARTS}) UNION ALL
 SELECT track, 'vs' || k, 'vocal_start', start, NULL FROM ({_PARTS}) UNION ALL SELECT track, 've' || k, 'vocal_end', stop, NULL FROM ({_PARTS})""")
def cue_rows(spark, sf):
    return segments.cue_rows(nested(spark, sf)).select("track", "id", "kind", "start", "beats")


_LEFT = "'-' || printf('%02d:%04.1f', CAST(floor((100 - start) / 60) AS INT), (100 - start) - floor((100 - start) / 60) * 60)"


@query("P30_report_row", f"""SELECT CAST(track AS VARCHAR) AS path, string_agg('S' || k || CASE WHEN k % 2 = 0 THEN ' 🎤' ELSE '' END || ' ' || {_LEFT} || ' [' || printf('%.0f', round_even(stop / 8, 0)) || 'b]', '; ' ORDER BY k) AS sections,
 string_agg({_LEFT} || '(Rise 0.50)', '; ' ORDER BY k) AS boundaries FROM ({_PARTS}) GROUP BY track""")
def report_row(spark, sf):
    full = nested(spark, sf).withColumns({
        "path": F.col("track").cast("string"), "genre": F.lit("x"), "vibe": F.lit(None).cast("string"),
        "error": F.lit(None).cast("string"), "duration": F.lit(100.0)})
    return readings.analysis_row(full).select("path", "sections", "boundaries")


# --- frames and spectra ---------------------------------------------------------------------
_SPECTRUM = f"SELECT track, pos * 5e1 AS freq, v * v AS power FROM ({FRAMES})"


def spectrum(spark, sf):
    return frames(spark, sf).select("track", (F.col("pos") * 50.0).alias("freq"), (F.col("v") * F.col("v")).alias("power"))


@query("A27_bass_share", f"SELECT track, round(sum(power) FILTER (WHERE freq >= 20 AND freq < 200) / sum(power) FILTER (WHERE freq >= 20), 6) AS bass FROM ({_SPECTRUM}) GROUP BY track")
def bass_share(spark, sf):
    return segments.bass_share(spectrum(spark, sf)).select("track", F.round("bass", 6).alias("bass"))


@query("A28_brightness", f"SELECT track, round(sum(freq * sqrt(power)) FILTER (WHERE freq >= 20) / sum(sqrt(power)) FILTER (WHERE freq >= 20), 6) AS bright FROM ({_SPECTRUM}) GROUP BY track")
def brightness(spark, sf):
    return segments.brightness(spectrum(spark, sf)).select("track", F.round("bright", 6).alias("bright"))


_PULSE = f"""SELECT track, CASE WHEN n / 8e0 * bpm / 60 >= 4 AND level > 0 THEN 2 * sqrt(c * c + s * s) / level END AS pulse FROM (
 SELECT track, n, bpm, sum(abs(v) * w) AS level, sum(abs(v) * w * cos(2 * pi() * (bpm / 60e0) / 8e0 * pos)) AS c, sum(abs(v) * w * sin(2 * pi() * (bpm / 60e0) / 8e0 * pos)) AS s FROM (
  SELECT *, 0.5e0 - 0.5e0 * cos(2 * pi() * pos / (n - 1)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY track) AS n, 9e1 + track % 60 AS bpm FROM ({FRAMES}))) GROUP BY track, n, bpm)"""


def _tempos(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("track"), (90.0 + F.col("vec_id") % 60).alias("bpm"))


@query("A29_pulse", f"SELECT track, round(pulse, 6) AS pulse FROM ({_PULSE})")
def pulse(spark, sf):
    seq = frame_seq(spark, sf, env=F.abs("v"))
    return segments.pulse(seq, _tempos(spark, sf), 8.0).select("track", F.round("pulse", 6).alias("pulse"))


_SAMPLES = f"SELECT track, k * 64 + pos AS pos, v * CASE WHEN track % 10 = 3 THEN 1e-6 ELSE 1e0 END AS x FROM ({FRAMES}), (SELECT unnest(range(40)) AS k) WHERE track % 10 <> 4 OR k < 2"


def samples(spark, sf):
    rows = frames(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).filter((F.col("track") % 10 != 4) | (F.col("k") < 2))
    return rows.select("track", (F.col("k") * 64 + F.col("pos")).alias("pos"), (F.col("v") * F.when(F.col("track") % 10 == 3, 1e-6).otherwise(1.0)).alias("x"))


@query("F16_usable_signal", f"SELECT track, count(*) >= 2048 AND sqrt(avg(x * x)) > 1e-4 AS usable FROM ({_SAMPLES}) GROUP BY track")
def usable_signal(spark, sf):
    return segments.usable(samples(spark, sf))


@query("A36_ingredients", f"""SELECT t.track, CASE WHEN ok THEN round(2e0 * 60 / (90 + t.track % 60), 6) END AS energy_density, CASE WHEN ok THEN round(bass, 6) END AS energy_bass, CASE WHEN ok THEN round(bright, 6) END AS energy_bright,
 CASE WHEN ok THEN round(pulse, 6) END AS energy_pulse FROM (SELECT track, count(*) >= 2048 AND sqrt(avg(x * x)) > 1e-4 AS ok FROM ({_SAMPLES}) GROUP BY track) t
 JOIN (SELECT track, sum(power) FILTER (WHERE freq >= 20 AND freq < 200) / sum(power) FILTER (WHERE freq >= 20) AS bass, sum(freq * sqrt(power)) FILTER (WHERE freq >= 20) / sum(sqrt(power)) FILTER (WHERE freq >= 20) AS bright
 FROM ({_SPECTRUM}) GROUP BY track) s ON s.track = t.track JOIN ({_PULSE}) p ON p.track = t.track""")
def ingredients(spark, sf):
    known = _tempos(spark, sf).withColumn("onset_rate", F.lit(2.0))
    out = segments.ingredients(known, samples(spark, sf), spectrum(spark, sf), frame_seq(spark, sf, env=F.abs("v")), 8.0)
    return out.select("track", *[F.round(c, 6).alias(c) for c in ("energy_density", "energy_bass", "energy_bright", "energy_pulse")])


@query("A25_groove", """SELECT track, round(CASE WHEN n >= 8 AND g >= 4 AND m > 0 THEN greatest(0e0, 1 - least(1e0, s / m)) END, 6) AS groove FROM (SELECT user_id AS track, count(*) AS n, count(gap) AS g, stddev_pop(gap) AS s, avg(gap) AS m FROM (
 SELECT user_id, CASE WHEN gap > 0 THEN gap END AS gap FROM (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id)""")
def groove(spark, sf):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf, "events").select(F.col("user_id").alias("track"), seconds.alias("t"), "event_id")
    return segments.groove(positions(rows, ["track"], ["t", "event_id"])).select("track", F.round("groove", 6).alias("groove"))


_USER = "SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, value FROM events"


def user_seq(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("track"), "ts", "event_id", "value")
    return positions(rows, ["track"], ["ts", "event_id"])


@query("A31_wave_bands", f"""WITH b AS (SELECT track, CASE WHEN pos < (n % p) * (n // p + 1) THEN pos // (n // p + 1) ELSE n % p + (pos - (n % p) * (n // p + 1)) // (n // p) END AS bin, pos, value FROM (SELECT *, least(16, n) AS p FROM ({_USER}))),
 m AS (SELECT track, bin, avg(pos * 1e0) AS t, avg(value) AS total, avg(value * 0.5e0) AS low, avg(value * value) AS mid, avg(value / (1 + pos)) AS high FROM b GROUP BY track, bin)
 SELECT track, bin, round(t, 6) AS t, round(total / max(total) OVER w, 6) AS level, round(least(1e0, low / quantile_cont(low, 0.99) OVER w), 6) AS low, round(least(1e0, mid / quantile_cont(mid, 0.99) OVER w), 6) AS mid,
 round(least(1e0, high / quantile_cont(high, 0.99) OVER w), 6) AS high FROM m WINDOW w AS (PARTITION BY track)""")
def wave_bands(spark, sf):
    seq = user_seq(spark, sf)
    rows = seq.rows.select("track", "pos", (F.col("pos") * 1.0).alias("t"), F.col("value").alias("total"), (F.col("value") * 0.5).alias("low"),
                           (F.col("value") * F.col("value")).alias("mid"), (F.col("value") / (1 + F.col("pos"))).alias("high"))
    out = segments.wave_bands(seq.with_rows(rows), 16)
    return out.select("track", "bin", *[F.round(c, 6).alias(c) for c in ("t", "level", "low", "mid", "high")])


@query("A32_peak_envelope", f"""WITH b AS (SELECT track, pos // (n // 20) AS bin, abs(value - 50) AS x FROM ({_USER}) WHERE n >= 20 AND pos // (n // 20) < 20), m AS (SELECT track, bin, max(x) AS p FROM b GROUP BY track, bin)
 SELECT track, bin, round_even(p / max(p) OVER (PARTITION BY track), 3) AS peak FROM m""")
def peak_envelope(spark, sf):
    seq = user_seq(spark, sf)
    return segments.peak_envelope(seq.with_rows(seq.rows.withColumn("x", F.col("value") - 50)), 20)


@query("P20_ending_ratio", f"SELECT track, round(CASE WHEN median(value) > 0 THEN avg(value) FILTER (WHERE pos >= n - 5) / median(value) END, 6) AS ending FROM ({_USER}) GROUP BY track")
def ending_ratio(spark, sf):
    return segments.ending_ratio(user_seq(spark, sf), 5, "value").select("track", F.round("ending", 6).alias("ending"))


@query("A35_pooled_vectors", """SELECT label AS track, i AS dim, round(avg(v), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i""")
def pooled_vectors(spark, sf):
    rows = tracks(spark, sf).select(F.col("label").alias("track"), "vec")
    return segments.pooled(rows).select("track", F.posexplode("vec").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@query("P28_fingerprint", f"""WITH c AS (SELECT track AS id, pos // 10 AS "column", avg(v) AS x FROM ({FRAMES}) WHERE pos < 60 GROUP BY track, pos // 10),
 m AS (SELECT *, x - median(x) OVER (PARTITION BY "column") AS off FROM c), s AS (SELECT *, quantile_cont(abs(off), 0.9) OVER (PARTITION BY "column") AS spread FROM m)
 SELECT id, "column", round(greatest(-1e0, least(1e0, off / greatest(spread, 1e-9))), 6) AS value FROM s""")
def fingerprint(spark, sf):
    return segments.fingerprint(tracks(spark, sf)).select("id", "column", F.round("value", 6).alias("value"))


def _starts_sql():
    kept = "SELECT id, duration, CAST([] AS DOUBLE[]) AS l FROM catalogue WHERE duration > 10"
    for i in range(12):
        start = f"least(greatest(0e0, duration * {(i + 0.5) / 12!r}::DOUBLE - 5e0), duration - 10e0)"
        kept = f"SELECT id, duration, CASE WHEN len(l) > 0 AND {start} - l[-1] <= 2.5e0 THEN l ELSE list_append(l, {start}) END AS l FROM ({kept})"
    told = "SELECT id, len(l) AS windows, round(list_sum(l), 6) AS total, round(l[-1], 6) AS last"
    return f"{told} FROM ({kept}) UNION ALL SELECT id, 1, CASE WHEN duration IS NULL THEN NULL ELSE 0e0 END, 0e0 FROM catalogue WHERE duration <= 10"


@query("P18_window_starts", with_catalogue(_starts_sql()))
def window_starts(spark, sf):
    rows = catalogue(spark, sf).filter(F.col("duration").isNotNull()).select("id", segments.window_starts(F.col("duration")).alias("s"))
    return rows.select("id", F.size("s").alias("windows"), F.round(F.aggregate("s", F.lit(0.0), lambda t, x: t + x), 6).alias("total"), F.round(F.element_at("s", -1), 6).alias("last"))


@query("P18_rhythm_start", with_catalogue("SELECT id, greatest(0e0, (duration - 30) / 2) AS rhythm FROM catalogue"))
def rhythm_start(spark, sf):
    return catalogue(spark, sf).select("id", segments.rhythm_start(F.col("duration")).alias("rhythm"))


# --- structure: the vectors of one label, in id order, are the beats of a track --------------
_BEATS = "SELECT label AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS beat, count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS f FROM embeddings"
_NOVELTY = f"""WITH b AS ({_BEATS}), k AS (SELECT a::INT AS a, sign(a) * exp(-0.5e0 * pow(a / 8e0, 2)) AS w FROM range(-16, 17) t(a)),
 d AS (SELECT track, beat, n, generate_subscripts(f, 1) AS d, unnest(f) AS v FROM b),
 s AS (SELECT b.track, b.beat, d.d, sum(k.w * d.v) AS x FROM b CROSS JOIN k JOIN d ON d.track = b.track AND d.beat = greatest(0, least(b.n - 1, b.beat + k.a)) WHERE b.n >= 33 GROUP BY ALL),
 r AS (SELECT track, beat, sum(x * x) AS raw FROM s GROUP BY ALL), nov AS (SELECT track, beat, raw / max(raw) OVER (PARTITION BY track) AS novelty FROM r)"""


def beats(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("track"), "vec_id", F.col("embedding").alias("features"))
    return positions(rows, ["track"], ["vec_id"])


def curve(spark, sf):
    """Novelty of the beats with a change of level every eighteen of them."""
    from ..plans.session import cut
    seq = beats(spark, sf)
    level = F.pmod(F.floor(F.col("pos") / 18), F.lit(2)) * 0.3
    rows = seq.rows.withColumn("features", F.transform("features", lambda x: x + level))
    return Ordered(cut(structure.novelty(seq.with_rows(rows))), ("track",), "beat", False)


@query("W19_novelty", f"{_NOVELTY} SELECT track, beat, round(novelty, 6) AS novelty FROM nov")
def novelty(spark, sf):
    return structure.novelty(beats(spark, sf)).select("track", "beat", F.round("novelty", 6).alias("novelty"))


@query("W20_boundary_peaks")
def boundary_peaks(spark, sf):
    seq = curve(spark, sf)
    marks = structure.peaks(seq)
    levels = seq.with_rows(seq.rows.withColumn("rms", F.col("novelty") + 0.1))
    return structure.boundary_labels(marks, levels).select("track", "beat", F.round("confidence", 6).alias("confidence"), "label")


_SNAP_MARKS = "SELECT vec_id AS track, 0 AS mark, 3e0 + vec_id % 3 AS time, 5e-1 + (vec_id % 5) / 1e1 AS period FROM embeddings"


@query("W21_snapped_times", f"""WITH m AS ({_SNAP_MARKS}), e AS (SELECT track, pos * 0.11e0 AS t, abs(v) AS env FROM ({FRAMES})),
 j AS (SELECT m.*, CAST(floor((((t - (time - 16 * period)) % period + period) % period) / period * 192) AS INT) % 192 AS b, env FROM m JOIN e ON e.track = m.track AND t >= time - 16 * period AND t <= time + 16 * period),
 s AS (SELECT track, mark, time, period, b, sum(env) AS x FROM j GROUP BY ALL), q AS (SELECT track, mark, time, period, arg_max(b, (x, -b)) AS b FROM s GROUP BY ALL),
 p AS (SELECT track, mark, (b + 5e-1) / 192 * period + time - period * 16 AS phase FROM q)
 SELECT m.track, m.mark, round(coalesce(phase + round_even((m.time - phase) / m.period, 0) * m.period, m.time), 5) AS snapped FROM m LEFT JOIN p ON p.track = m.track AND p.mark = m.mark""")
def snapped_times(spark, sf):
    rows = frames(spark, sf)
    marks = spark.sql(_SNAP_MARKS.replace("FROM embeddings", "FROM {e}"), e=table(spark, sf, "embeddings"))
    env = rows.select("track", (F.col("pos") * 0.11).alias("t"), F.abs("v").alias("env"))
    return structure.snap(marks, env, width=4.0).select("track", "mark", F.round("snapped", 5).alias("snapped"))


# --- strokes: the events of a user in time order ---------------------------------------------
_STROKE = "SELECT user_id AS stroke, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, (event_id * 37 % 101) * 1e0 AS x, value / 4 AS y FROM events"


def strokes(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("stroke"), "ts", "event_id", (F.col("event_id") * 37 % 101).cast("double").alias("x"), (F.col("value") / 4).alias("y"))
    return positions(rows, ["stroke"], ["ts", "event_id"])


_LEGS = f"SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM ({_STROKE}) WINDOW w AS (PARTITION BY stroke ORDER BY pos)"


@query("F14_closed_shapes", f"""SELECT stroke, points, round(length, 6) AS length, points >= 3 AND length > 0 AND sqrt(pow(x0 - x1, 2) + pow(y0 - y1, 2)) <= 0.01 * length AS closed FROM (
 SELECT stroke, count(*) AS points, sum(sqrt(pow(x - px, 2) + pow(y - py, 2))) AS length, arg_min(x, pos) AS x0, arg_min(y, pos) AS y0, arg_max(x, pos) AS x1, arg_max(y, pos) AS y1 FROM ({_LEGS}) GROUP BY stroke)""")
def closed_shapes(spark, sf):
    return paths.closed_shapes(strokes(spark, sf), 0.01).select("stroke", "points", F.round("length", 6).alias("length"), "closed")


_SAMPLED = f"""WITH g AS (SELECT *, coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0) AS gone FROM ({_LEGS})), u AS (SELECT *, sum(gone) OVER (PARTITION BY stroke ORDER BY pos) AS upto FROM g),
 t AS (SELECT *, max(upto) OVER (PARTITION BY stroke) AS total, max(pos) OVER (PARTITION BY stroke) AS fin FROM u),
 smp AS (SELECT stroke, k, px + s * (x - px) AS x, py + s * (y - py) AS y FROM (SELECT *, CASE WHEN gone > 0 THEN least(1e0, greatest(0e0, (k * 25e0 - (upto - gone)) / gone)) ELSE 1e0 END AS s FROM (
  SELECT *, unnest(range(CAST(ceil((upto - gone) / 25e0) AS BIGINT), CASE WHEN pos = fin THEN CAST(ceil(total / 25e0) AS BIGINT) + 1 ELSE CAST(ceil(upto / 25e0) AS BIGINT) END)) AS k FROM t WHERE (gone > 0 OR pos = fin) AND total > 0)))"""


@query("W22_resampled_paths", f"{_SAMPLED} SELECT stroke, k, round(x, 4) AS x, round(y, 4) AS y FROM smp")
def resampled_paths(spark, sf):
    return paths.resampled(strokes(spark, sf), 25.0).select("stroke", "k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("J13_along_path", _SAMPLED.replace("WITH g AS", "WITH pts AS (SELECT p_partkey AS id, (p_partkey * 37 % 997) * 1e-1 AS x, (p_partkey * 53 % 991) * 1e-1 AS y FROM part), g AS")
       + """ SELECT stroke, id, min(k) AS k FROM (SELECT s.stroke, p.id, s.k FROM smp s JOIN pts p ON sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)) <= 3) GROUP BY stroke, id""")
def along_path(spark, sf):
    samples_ = paths.resampled(strokes(spark, sf), 25.0)
    return paths.along_path(catalogue(spark, sf), samples_, 3.0).select("stroke", "id", "k")
