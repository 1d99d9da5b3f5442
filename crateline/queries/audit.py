"""Audits of measures and samples to listen to."""

from pyspark.sql import functions as F

from ..functions import moods
from ..functions.columns import labels
from ..operators import audit
from . import query
from .catalogue import ENERGY_SQL, LEVEL_SQL
from .stand_ins import catalogue, rank_sql, with_catalogue
from .tags import _SCORES, scored, valence_sql

_FIELDS = ("energy_density", "energy_bass", "energy_bright", "energy_pulse", "valence", "bpm", "camelot")


@query("A12_field_coverage", with_catalogue(" UNION ALL ".join(
    f"SELECT '{f}' AS field, count({f}) AS present, count(*) - count({f}) AS absent FROM catalogue" for f in _FIELDS)))
def field_coverage(spark, sf):
    return audit.field_coverage(catalogue(spark, sf), _FIELDS)


_BOTH = "SELECT bpm AS u, valence AS a FROM catalogue WHERE bpm IS NOT NULL AND valence IS NOT NULL"


@query("A13_rank_agreement", with_catalogue(
    f"""SELECT count(*) AS rows, round(corr(a, u), 6) AS correlation, count_if(u >= 0.5 AND a < 0.5) AS high_dark, count_if(u >= 0.5 AND a >= 0.5) AS high_bright, count_if(u < 0.5 AND a < 0.5) AS low_dark,
 count_if(u < 0.5 AND a >= 0.5) AS low_bright FROM (SELECT {rank_sql('u')} AS u, {rank_sql('a')} AS a FROM ({_BOTH}))"""))
def rank_agreement(spark, sf):
    return audit.rank_agreement(catalogue(spark, sf), "bpm", "valence").withColumn("correlation", F.round("correlation", 6))


_OTHERS = ("bpm", "danceability", "lufs", "energy_pulse")


@query("A14_correlations", with_catalogue(" UNION ALL ".join(
    f"SELECT '{o}' AS other, round(corr(energy_density, {o}), 6) AS r, abs(corr(energy_density, {o})) > 0.7 AS repeats FROM catalogue" for o in _OTHERS)))
def correlations(spark, sf):
    return audit.correlations(catalogue(spark, sf), "energy_density", _OTHERS, least=20).withColumn("r", F.round("r", 6))


@query("A15_head_against_others", with_catalogue(" UNION ALL ".join(
    f"SELECT '{o}' AS other, round(corr(energy_bass, {o}), 6) AS r, abs(corr(energy_bass, {o})) > 0.7 AS repeats FROM catalogue" for o in _OTHERS)))
def head_against_others(spark, sf):
    rows = catalogue(spark, sf).withColumn("constant", F.lit(1.0))
    return audit.correlations(rows, "energy_bass", (*_OTHERS, "constant")).withColumn("r", F.round("r", 6))


_NINE = ", ".join(f"round(quantile_cont(danceability, 0.{i}), 6) AS d{i}" for i in range(1, 10))


@query("A16_spread", with_catalogue(f"SELECT count(danceability) AS known, round(avg(CASE WHEN danceability >= 0.5 THEN 1e0 WHEN danceability IS NOT NULL THEN 0e0 END), 6) AS above_half, "
                                    f"round(count(DISTINCT danceability) / count(danceability), 6) AS distinct_share, {_NINE} FROM catalogue"))
def spread(spark, sf):
    told = audit.spread(catalogue(spark, sf), "danceability")
    return told.select("known", F.round("above_half", 6).alias("above_half"), F.round("distinct", 6).alias("distinct_share"),
                       *[F.round(F.col("deciles")[i], 6).alias(f"d{i + 1}") for i in range(9)])


_H = ("energy_bass", "energy_pulse")
_K = ("bpm", "danceability")


def _head_sql(head):
    others = [*_K, *[h for h in _H if h != head]]
    parts = [f"SELECT '{head}' AS head, 'above_half' AS figure, round(avg(CASE WHEN {head} >= 0.5 THEN 1e0 WHEN {head} IS NOT NULL THEN 0e0 END), 6) AS value FROM catalogue",
             f"SELECT '{head}', 'distinct', round(count(DISTINCT {head}) / count({head}), 6) FROM catalogue"]
    parts += [f"SELECT '{head}', 'decile {i}', round(quantile_cont({head}, 0.{i}), 6) FROM catalogue" for i in range(1, 10)]
    parts += [f"SELECT '{head}', 'vs {o}', round(corr({head}, {o}), 6) FROM catalogue" for o in others]
    return " UNION ALL ".join(parts)


@query("A17_head_report", with_catalogue(" UNION ALL ".join(_head_sql(h) for h in _H)))
def head_report(spark, sf):
    return audit.head_report(catalogue(spark, sf), _H, _K).withColumn("value", F.round("value", 6))


@query("A18_reading_audit")
def reading_audit(spark, sf):
    return audit.reading_audit(scored(spark, sf)).withColumn("value", F.round("value", 6))


_FRESH = f"""SELECT id, list(label ORDER BY r) FILTER (WHERE r <= 4 AND (value >= 0.05e0 OR r = 1)) AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, i) AS r FROM ({_SCORES})) GROUP BY id"""


@query("A18_label_agreement", with_catalogue(f"""SELECT c.id, CASE WHEN moods = '' THEN false ELSE fresh[1] = string_split(moods, '; ')[1] END AS first,
 round(CASE WHEN moods = '' THEN 0e0 ELSE len(list_intersect(fresh, string_split(moods, '; '))) / len(list_distinct(list_concat(fresh, string_split(moods, '; ')))) END, 6) AS share
 FROM catalogue c JOIN ({_FRESH}) f ON f.id = c.id"""))
def label_agreement(spark, sf):
    first, share = audit.agreement("scores", "moods")
    return scored(spark, sf).select("id", first.alias("first"), F.round(share, 6).alias("share"))


@query("U4_label_jaccard", with_catalogue("""SELECT id, round(CASE WHEN moods <> '' THEN len(list_intersect(string_split(moods, '; '), ['Dark', 'Deep', 'Happy'])) / len(list_distinct(list_concat(string_split(moods, '; '), ['Dark', 'Deep', 'Happy']))) ELSE 0e0 END, 6) AS share FROM catalogue"""))
def label_jaccard(spark, sf):
    rows = catalogue(spark, sf).withColumn("a", labels("moods")).withColumn("b", F.array(*[F.lit(x) for x in ("Dark", "Deep", "Happy")]))
    return rows.select("id", F.round(audit.jaccard("a", "b"), 6).alias("share"))


_SHIFT = f"SELECT *, after_ - before_ AS shift FROM (SELECT *, {rank_sql('valence')} AS before_, {rank_sql('danceability')} AS after_ FROM catalogue)"


def _shifts(spark, sf):
    return audit.shift_audit(catalogue(spark, sf), "valence", "danceability")


@query("A19_shift_summary", with_catalogue(f"""SELECT count(*) AS rows, round(avg(CASE WHEN abs(shift) >= 0.1e0 THEN 1e0 ELSE 0e0 END), 6) AS by_1, round(avg(CASE WHEN abs(shift) >= 0.2e0 THEN 1e0 ELSE 0e0 END), 6) AS by_2,
 round(avg(CASE WHEN abs(shift) >= 0.3e0 THEN 1e0 ELSE 0e0 END), 6) AS by_3, round(avg(CASE WHEN (before_ - 0.5e0) * (after_ - 0.5e0) < 0 THEN 1e0 ELSE 0e0 END), 6) AS crossing FROM ({_SHIFT}) WHERE shift IS NOT NULL"""))
def shift_summary(spark, sf):
    told = audit.shift_summary(_shifts(spark, sf))
    return told.select("rows", *[F.round(c, 6).alias(c) for c in ("by_1", "by_2", "by_3", "crossing")])


@query("A19_shift_list", with_catalogue(f"SELECT id, round(shift, 6) AS shift, (before_ - 0.5e0) * (after_ - 0.5e0) < 0 AS crosses FROM ({_SHIFT}) WHERE abs(shift) >= 0.35e0"))
def shift_list(spark, sf):
    return audit.shift_list(_shifts(spark, sf), 0.35).select("id", F.round("shift", 6).alias("shift"), "crosses")


def _long(spark, sf):
    return scored(spark, sf).select("id", F.inline("scores"))


@query("A20_calibrated_reading", with_catalogue(f"""SELECT id, round(avg(r) FILTER (WHERE label IN ('Happy', 'Fun')) - avg(r) FILTER (WHERE label IN ('Dark', 'Sad')), 6) AS reading FROM (
 SELECT id, label, (rank() OVER (PARTITION BY label ORDER BY value) - 1 + (count(*) OVER (PARTITION BY label, value) - 1) / 2e0) / (count(*) OVER (PARTITION BY label) - 1) AS r FROM ({_SCORES})) GROUP BY id"""))
def calibrated_reading(spark, sf):
    return audit.calibrated_reading(_long(spark, sf)).select("id", F.round("reading", 6).alias("reading"))


@query("A21_label_priors", with_catalogue(f"SELECT label, round(avg(value), 6) AS prior, CASE WHEN label IN ('Happy', 'Fun') THEN 'bright' ELSE 'dark' END AS side FROM ({_SCORES}) WHERE label <> 'Energetic' GROUP BY label"))
def label_priors(spark, sf):
    return audit.label_priors(_long(spark, sf)).withColumn("prior", F.round("prior", 6))


_QUAD = f"""SELECT *, CASE WHEN energy_pulse >= 0.5 THEN 0 ELSE 2 END + CASE WHEN before_ >= 0.5 THEN 1 ELSE 0 END AS q0, CASE WHEN energy_pulse >= 0.5 THEN 0 ELSE 2 END + CASE WHEN after_ >= 0.5 THEN 1 ELSE 0 END AS q1 FROM ({_SHIFT}) WHERE shift IS NOT NULL"""


def _quadrants(spark, sf):
    return audit.with_quadrants(_shifts(spark, sf).drop("shift"), "rank_before", "rank_after", "energy_pulse")


@query("A22_transitions", with_catalogue("SELECT q0, " + ", ".join(f"count_if(q1 = {i}) AS to_{i}" for i in range(4)) + f", count(*) AS total FROM ({_QUAD}) GROUP BY ROLLUP (q0)"))
def transitions(spark, sf):
    return audit.transitions(_quadrants(spark, sf))


@query("A22_movers", with_catalogue(f"SELECT q1, place, id, round(shift, 6) AS shift FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q1 ORDER BY abs(shift) DESC, id) AS INT) AS place FROM ({_QUAD}) WHERE q0 <> q1) WHERE place <= 6"))
def movers(spark, sf):
    return audit.movers(_quadrants(spark, sf)).select("q1", "place", "id", F.round("shift", 6).alias("shift"))


@query("A38_measured_table", with_catalogue(f"SELECT id, {LEVEL_SQL.format('energy')} AS level, round_even(energy_density, 3) AS energy_density FROM ({ENERGY_SQL})"))
def measured_table(spark, sf):
    return audit.measured_table(catalogue(spark, sf)).select("id", "level", "energy_density")


def _stepped_sql(order, sample, rows="catalogue"):
    return (f"SELECT id, i // step + 1 AS place FROM (SELECT *, greatest(1, n // least({sample}, n)) AS step FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i, count(*) OVER () AS n FROM {rows})) "
            f"WHERE i % step = 0 AND i // step < least({sample}, n)")


@query("T14_stepped_sample", with_catalogue(_stepped_sql("id", 150)))
def stepped_sample(spark, sf):
    return audit.stepped(catalogue(spark, sf), ["id"], 150).select("id", "place")


@query("T15_spread_sample", with_catalogue(_stepped_sql("valence, id", 40, "(SELECT * FROM catalogue WHERE valence IS NOT NULL)")))
def spread_sample(spark, sf):
    return audit.spread_sample(catalogue(spark, sf), "valence", 40).select("id", "place")


@query("T15_faint_sample", with_catalogue(_stepped_sql("r, id", 20,
    f"(SELECT v.id, round((v.b - v.d) / (v.b + v.d), 9) AS r FROM ({valence_sql('0.05e0')}) f JOIN ({valence_sql()}) v ON v.id = f.id WHERE f.b + f.d = 0 AND v.b + v.d > 0)")))
def faint_sample(spark, sf):
    rows = scored(spark, sf).filter(moods.faint_only("scores")).withColumn("reading", F.round(moods.valence_of("scores"), 9))
    return audit.stepped(rows, ["reading", "id"], 20).select("id", "place")


@query("T16_listening_sample", with_catalogue(_stepped_sql("coalesce(energy_bass, 2), id", 20)))
def listening_sample(spark, sf):
    rows = catalogue(spark, sf).withColumn("energy_bass", F.coalesce("energy_bass", F.lit(2.0)))
    return audit.listening_sample(rows, "energy_bass", 20).select("id", "place")


@query("T16_listening_top", with_catalogue("SELECT id FROM catalogue ORDER BY coalesce(energy_bass, 2) DESC, id LIMIT 20"))
def listening_top(spark, sf):
    rows = catalogue(spark, sf).withColumn("energy_bass", F.coalesce("energy_bass", F.lit(2.0)))
    return audit.listening_sample(rows, "energy_bass", 20, top=True).select("id")


@query("T13_capped_sample", with_catalogue("""SELECT id, id NOT IN (SELECT id FROM catalogue ORDER BY md5('0:' || id), id LIMIT 90) AS pointed FROM catalogue
 WHERE camelot = '8A' OR id IN (SELECT id FROM catalogue ORDER BY md5('0:' || id), id LIMIT 90)"""))
def capped_sample(spark, sf):
    rows = catalogue(spark, sf)
    marked = rows.filter(F.col("camelot") == "8A").select("id")
    return audit.capped_sample(rows, 90, marked=marked).select("id", "pointed")


@query("T17_stratified_sample", with_catalogue(f"""SELECT id, top_genre, row_number() OVER (ORDER BY r, md5('0:' || g), g) - 1 AS turn FROM (
 SELECT *, row_number() OVER (PARTITION BY g ORDER BY (a + 1) * {audit.GOLDEN!r}::DOUBLE - floor((a + 1) * {audit.GOLDEN!r}::DOUBLE), a) AS r FROM (
 SELECT id, top_genre, coalesce(top_genre, '—') AS g, row_number() OVER (PARTITION BY coalesce(top_genre, '—') ORDER BY valence NULLS LAST, path, id) - 1 AS a FROM catalogue)) ORDER BY turn LIMIT 60"""))
def stratified_sample(spark, sf):
    return audit.stratified(catalogue(spark, sf), 60, key="id").select("id", "top_genre", "turn")
