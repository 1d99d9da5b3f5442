"""Label texts: splitting, counting, coverage, writing."""

from pyspark.sql import functions as F

from ..functions import moods, tags
from ..functions.columns import labels
from ..operators import tag_counts
from . import query
from .stand_ins import catalogue, table, with_catalogue

# Tags as people type them: mixed case, repeated, separated in several ways.
_RAW = ("CASE WHEN id % 10 = 0 THEN ' ' WHEN id % 10 < 4 THEN top_genre || ', ' || lower(top_genre) || ';; Hi-NRG' "
        "ELSE upper(top_genre) || '; Funk / Soul - Contemporary R&B' END")
_ELEMENTS = (f"SELECT id, path, k, lower(e) AS key, e FROM (SELECT id, path, generate_subscripts(parts, 1) AS k, trim(unnest(parts)) AS e FROM "
             f"(SELECT id, path, string_split_regex({_RAW}, '[;,]| - ') AS parts FROM catalogue)) WHERE e <> ''")


def _tagged(spark, sf):
    return catalogue(spark, sf).withColumn("raw", F.expr(_RAW))


@query("X6_split_tag", with_catalogue(
    f"SELECT id, string_agg(e, '|' ORDER BY k) AS parts FROM (SELECT id, key, min(k) AS k, arg_min(e, k) AS e FROM ({_ELEMENTS}) GROUP BY id, key) GROUP BY id "
    "UNION ALL SELECT id, '' FROM catalogue WHERE id % 10 = 0"))
def split_tag(spark, sf):
    return _tagged(spark, sf).select("id", F.array_join(tags.split_tag("raw"), "|").alias("parts"))


@query("X7_mood_split", with_catalogue("SELECT id, CASE WHEN moods = '' THEN 0 ELSE len(string_split(moods, ';')) END AS n, "
                                       "trim(split_part(moods, ';', 1)) AS first FROM catalogue"))
def mood_split(spark, sf):
    return catalogue(spark, sf).select("id", F.size(labels("moods")).alias("n"),
                                       F.coalesce(F.try_element_at(labels("moods"), F.lit(1)), F.lit("")).alias("first"))


_PACKED = "CASE WHEN id % 9 = 0 THEN 'Odd; ' ELSE '' END || 'Dark:' || CAST((id % 90 + 5) / 1e2 AS STRING) || '; Deep:x; Happy:' || CAST((id % 70 + 3) / 1e2 AS STRING)"


@query("X8_packed_weights", with_catalogue(
    "SELECT id, CASE WHEN d >= h THEN 'Dark:' || printf('%.3f', d) || '; Happy:' || printf('%.3f', h) "
    "ELSE 'Happy:' || printf('%.3f', h) || '; Dark:' || printf('%.3f', d) END AS packed FROM "
    "(SELECT id, (id % 90 + 5) / 1e2 AS d, (id % 70 + 3) / 1e2 AS h FROM catalogue)"))
def packed_weights(spark, sf):
    return catalogue(spark, sf).select("id", moods.spell_weights(moods.weights(F.expr(_PACKED))).alias("packed"))


@query("A10_tag_breakdown", with_catalogue(
    f"SELECT arg_min(e, (id, k)) AS type, count(DISTINCT id) AS tracks FROM ({_ELEMENTS}) GROUP BY key"))
def tag_breakdown(spark, sf):
    return tag_counts.breakdown(_tagged(spark, sf), "raw", "id").select("type", "tracks")


@query("A10_with_and_without", with_catalogue(
    "SELECT count_if(id % 10 <> 0) AS tracks_with_any, count_if(id % 10 = 0) AS tracks_without FROM catalogue"))
def with_and_without(spark, sf):
    return tag_counts.with_and_without(_tagged(spark, sf), "raw")


@query("A11_rows_with_types", with_catalogue(f"SELECT DISTINCT path FROM ({_ELEMENTS}) WHERE key IN ('widget', 'small')"))
def rows_with_types(spark, sf):
    return tag_counts.rows_with(_tagged(spark, sf), "raw", "id", ["Widget", "small"])


@query("U1_union_over_types", with_catalogue(f"SELECT DISTINCT path FROM ({_ELEMENTS}) WHERE key IN ('hi-nrg', 'contemporary r&b', 'ring')"))
def union_over_types(spark, sf):
    return tag_counts.rows_with(_tagged(spark, sf), "raw", "id", ["Hi-NRG", "Contemporary R&B", "Ring"])


_LEAVES = "SELECT unnest(string_split(genres, '; ')) AS leaf FROM catalogue"


@query("A8_label_counts", with_catalogue(
    f"SELECT parent, leaf, count(*) AS n FROM (SELECT leaf, split_part(leaf, ' - ', 1) AS parent FROM ({_LEAVES})) GROUP BY ROLLUP (parent, leaf)"))
def label_counts(spark, sf):
    return tag_counts.label_counts(catalogue(spark, sf), "genres")


@query("A8_macro_counts", with_catalogue(
    f"SELECT split_part(leaf, ' - ', 1) AS parent, count(DISTINCT leaf) AS n FROM ({_LEAVES}) GROUP BY 1"))
def macro_counts(spark, sf):
    return tag_counts.macro_counts(catalogue(spark, sf), "genres")


@query("F18_leaves_under_parents", with_catalogue(
    f"SELECT DISTINCT leaf FROM ({_LEAVES}) WHERE split_part(leaf, ' - ', 1) IN ('SMALL', 'PROMO')"))
def leaves_under_parents(spark, sf):
    return tag_counts.leaves_wanted(catalogue(spark, sf), "genres", parents=["SMALL", "PROMO"])


_COVER = ("SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN '  ' WHEN l.quality = 1 THEN d.lang END AS genre, "
          "CASE WHEN l.toxic = 0 THEN 'ok ' END AS comment, CASE WHEN d.doc_id % 50 = 3 THEN 'broken' END AS error "
          "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")


def _coverage(spark, sf):
    return spark.sql(_COVER.replace("FROM documents d", "FROM {docs} d").replace("JOIN labels l", "JOIN {marks} l"),
                     docs=table(spark, sf, "documents"), marks=table(spark, sf, "labels"))


@query("P21_tag_coverage", "SELECT doc_id, g AS has_genre, c AS has_comment, g AND c AS complete FROM (SELECT doc_id, "
       f"coalesce(trim(genre) <> '', false) AS g, comment IS NOT NULL AS c FROM ({_COVER}))")
def tag_coverage(spark, sf):
    rows = _coverage(spark, sf)
    return rows.select("doc_id", *[v.alias(k) for k, v in tags.coverage("genre", "comment").items()])


@query("F10_missing_tags", f"SELECT doc_id FROM ({_COVER}) WHERE error IS NULL AND (coalesce(trim(genre), '') = '' OR comment IS NULL)")
def missing_tags(spark, sf):
    return tag_counts.missing_tags(_coverage(spark, sf)).select("doc_id")


@query("F10_missing_both", f"SELECT doc_id FROM ({_COVER}) WHERE error IS NULL AND coalesce(trim(genre), '') = '' AND comment IS NULL")
def missing_both(spark, sf):
    return tag_counts.missing_tags(_coverage(spark, sf), require_both=True).select("doc_id")


@query("U7_readable_split", f"SELECT error IS NULL AS readable, count(*) AS n FROM ({_COVER}) GROUP BY 1")
def readable_split(spark, sf):
    return _coverage(spark, sf).groupBy(F.col("error").isNull().alias("readable")).agg(F.count("*").alias("n"))


_SCORED = {"label": ("Rock---Alternative Rock", "Electronic---House", "Jazz"), "mood": ("dark", "happy r&b/soul", "deep")}


def _pairs(labels_, base):
    return F.array(*[F.struct(F.lit(n).alias("label"), ((F.col("id") * (i + 3) % 97) / 100.0).alias("value"))
                     for i, n in enumerate(labels_)])


@query("P22_tag_values", with_catalogue(
    "SELECT id, 'Rock - Alternative Rock; Electronic - House; Jazz' AS genre, 'Dark ' || printf('%.0f%%', id * 3 % 97) || '; Happy R&B/Soul ' || printf('%.0f%%', id * 4 % 97) AS comment, "
    "'Rock---Alternative Rock: ' || printf('%.2f%%', id * 3 % 97) || ', Electronic---House: ' || printf('%.2f%%', id * 4 % 97) || ', Jazz: ' || printf('%.2f%%', id * 5 % 97) AS genre_confidence "
    "FROM (SELECT id::DOUBLE AS id FROM catalogue)"))
def tag_values(spark, sf):
    rows = catalogue(spark, sf).withColumn("g", _pairs(_SCORED["label"], 3)).withColumn("m", _pairs(_SCORED["mood"], 5))
    values = tags.tag_values("g", "m", moods_in_tag=2)
    return rows.select("id", *[values[c].alias(c) for c in ("genre", "comment", "genre_confidence")])


@query("P23_genre_styles", with_catalogue(
    "SELECT id, p || ' - ' || c AS parent_child, c || ' - ' || p AS child_parent, c AS child_only FROM "
    "(SELECT id, split_part(top_genre, ' - ', 1) AS p, split_part(top_genre, ' - ', 2) AS c FROM catalogue)"))
def genre_styles(spark, sf):
    raw = F.replace("top_genre", F.lit(" - "), F.lit(" --- "))
    return catalogue(spark, sf).select("id", *[tags.genre_tag(raw, s).alias(s) for s in ("parent_child", "child_parent", "child_only")])


@query("P24_first_genre", with_catalogue(
    "SELECT id, CASE WHEN id % 6 = 0 THEN 'Unclassified' ELSE upper(name[1]) || lower(split_part(name, ' ', 1))[2:] || ' ' || upper(split_part(name, ' ', 2)[1]) || lower(split_part(name, ' ', 2))[2:] || '-X' END AS genre FROM catalogue"))
def first_genre(spark, sf):
    raw = F.when(F.col("id") % 6 == 0, F.lit(" /x")).otherwise(F.concat("name", F.lit("-x / b, c")))
    return catalogue(spark, sf).select("id", tags.first_genre(raw).alias("genre"))


_HEADS = ("Dark", "Energetic", "Happy", "Sad", "Fun")
_H = ", ".join(f"({i}, '{n}')" for i, n in enumerate(_HEADS))
_SCORES = f"SELECT id, i, label, (id * (i * 7 + 11) % 101) / 1e3 AS value FROM catalogue, (VALUES {_H}) h(i, label)"


def scored(spark, sf):
    return catalogue(spark, sf).withColumn("scores", F.array(*[
        F.struct(F.lit(n).alias("label"), ((F.col("id") * (i * 7 + 11) % 101) / 1000.0).alias("value")) for i, n in enumerate(_HEADS)]))


_TOP = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, i) AS r FROM ({_SCORES})"


@query("T9_select_labels", with_catalogue(
    f"SELECT id, string_agg(label, ',' ORDER BY r) FILTER (WHERE r <= 3 AND (value >= 0.08e0 OR r = 1)) AS chosen FROM ({_TOP}) GROUP BY id"))
def select_labels(spark, sf):
    chosen = moods.select_labels("scores", 0.08, 3)
    return scored(spark, sf).select("id", F.array_join(F.transform(chosen, lambda p: p["label"]), ",").alias("chosen"))


@query("T10_select_moods", with_catalogue(
    f"SELECT id, coalesce(string_agg(label, ',' ORDER BY r) FILTER (WHERE r <= 3 AND value >= 0.08e0), '') AS chosen FROM ({_TOP}) GROUP BY id"))
def select_moods(spark, sf):
    chosen = moods.select_labels("scores", 0.08, 3, fallback=False)
    return scored(spark, sf).select("id", F.array_join(F.transform(chosen, lambda p: p["label"]), ",").alias("chosen"))


def valence_sql(floor="0e0"):
    dark = f"coalesce(sum(value) FILTER (WHERE label IN ('Dark', 'Sad') AND value > {floor}), 0e0) / 8"
    bright = f"coalesce(sum(value) FILTER (WHERE label IN ('Happy', 'Fun') AND value > {floor}), 0e0) / 13"
    return f"SELECT id, {bright} AS b, {dark} AS d FROM ({_SCORES}) GROUP BY id"


@query("M11_valence_of_scores", with_catalogue(
    f"SELECT id, round(CASE WHEN b + d > 0 THEN (b - d) / (b + d) END, 6) AS valence, round(b + d, 6) AS evidence FROM ({valence_sql('0e0')})"))
def valence_of_scores(spark, sf):
    return scored(spark, sf).select("id", F.round(moods.valence_of("scores"), 6).alias("valence"),
                                    F.round(moods.evidence("scores"), 6).alias("evidence"))


@query("M13_mood_numbers", with_catalogue(
    f"SELECT v.id, round_even(round(CASE WHEN b + d > 0 THEN (b - d) / (b + d) END, 8), 4) AS valence, round_even(round(b + d, 8), 3) AS mood_evidence, c AS mood_conf FROM ({valence_sql()}) v JOIN "
    f"(SELECT id, string_agg(label || ':' || printf('%.3f', value), '; ' ORDER BY r) FILTER (WHERE r <= 8 AND (value >= 0.02e0 OR (r = 1))) AS c FROM ({_TOP}) GROUP BY id) t ON t.id = v.id"))
def mood_numbers(spark, sf):
    return scored(spark, sf).select("id", *[v.alias(k) for k, v in moods.mood_numbers("scores").items()])


@query("F12_faint_only", with_catalogue(
    f"SELECT f.id FROM ({valence_sql('0.05e0')}) f JOIN ({valence_sql()}) v ON v.id = f.id WHERE f.b + f.d = 0 AND v.b + v.d > 0"))
def faint_only(spark, sf):
    return scored(spark, sf).filter(moods.faint_only("scores")).select("id")


@query("M17_positive_class", with_catalogue("SELECT id, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS wanted FROM catalogue"))
def positive_class(spark, sf):
    classes = (F.when(F.col("id") % 3 == 0, F.array(F.lit("not_danceable"), F.lit("danceable")))
               .when(F.col("id") % 3 == 1, F.array(F.lit("aggressive"), F.lit("Non_aggressive")))
               .otherwise(F.array(F.lit("a"), F.lit("b"))))
    return catalogue(spark, sf).select("id", moods.positive_class(classes).alias("wanted"))


_PALETTE = ("#e0503b", "#3d9be0", "#3fbf7f", "#f2a33c", "#a06fd6", "#e06fa8")


@query("T12_genre_colours", with_catalogue(
    "SELECT id, coalesce(c, '#9aa4b0') AS colour FROM catalogue LEFT JOIN (SELECT top_genre AS g, ["
    + ", ".join(f"'{c}'" for c in _PALETTE) + "][row_number() OVER (ORDER BY count(*) DESC, min(id))] AS c FROM catalogue GROUP BY 1) ON g = top_genre"))
def genre_colours(spark, sf):
    return tag_counts.top_colours(catalogue(spark, sf), "top_genre", _PALETTE, "id", "#9aa4b0").select("id", "colour")
