"""Names, paths and search over whole texts."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters
from . import query
from .stand_ins import MANIFEST, catalogue, manifest, table, with_catalogue

_WORDS = "trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"
_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1')"


@query("X1_folded_text", "SELECT doc_id, md5(replace(lower(strip_accents(text)), 'ß', 'ss')) AS folded FROM documents")
def folded_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.folded("text")).alias("folded"))


@query("X2_normalized_name", f"SELECT doc_id, {_WORDS.format(f'lower(strip_accents({_STEM}))')} AS name FROM ({MANIFEST})")
def normalized_name(spark, sf):
    return manifest(spark, sf).select("doc_id", text.normalized_name("path").alias("name"))


_BARE = _WORDS.format(f"regexp_replace(lower(strip_accents({_STEM})), '[(\\[][^)\\]]*[)\\]]', ' ', 'g')")
SONG_KEY = (f"coalesce(nullif(trim(regexp_replace(regexp_replace({_BARE}, '^[0-9]{{1,3}} ', ''), ' [0-9]{{1,4}}$', '')), ''), "
            f"{_WORDS.format(f'lower(strip_accents({_STEM}))')})")


@query("X3_song_key", with_catalogue(f"SELECT id, {SONG_KEY} AS song FROM catalogue"))
def song_key(spark, sf):
    return catalogue(spark, sf).select("id", text.song_key("path").alias("song"))


@query("X4_composed_text", "SELECT doc_id, md5(nfc_normalize(text)) AS composed FROM documents")
def composed_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.composed("text")).alias("composed"))


@query("X5_absolute_path", "SELECT page_id, '/home/' || rtrim(regexp_extract(url, '^https?://(.*)$', 1), '/') AS path FROM pages")
def absolute_path(spark, sf):
    rest = F.regexp_extract("url", "^https?://(.*)$", 1)
    messy = F.concat(F.lit("./x/../"), F.regexp_replace(rest, "/", "//"), F.lit("/./"))
    return table(spark, sf, "pages").select("page_id", text.absolute_path(messy, "/home").alias("path"))


@query("F13_under_root", f"SELECT doc_id, path FROM ({MANIFEST}) WHERE path = '/root/src1' OR starts_with(path, '/root/src1/')")
def under_root(spark, sf):
    return manifest(spark, sf).filter(text.under("path", "/root/src1/")).select("doc_id", "path")


@query("F4_all_words", "SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'ene') AND contains(lower(strip_accents(text)), 'the')")
def all_words(spark, sf):
    rows = table(spark, sf, "documents").withColumn("folder", F.lit(None).cast("string"))
    return filters.matching_rows(rows, ["Éne", "THE"], "text", "folder").select("doc_id")


@query("F4_all_words_collated", "SELECT item_id FROM benchmark WHERE contains(lower(strip_accents(text)), 'ene') AND contains(lower(strip_accents(text)), 'the')")
def all_words_collated(spark, sf):
    return table(spark, sf, "benchmark").filter(text.has_all_words_collated("text", ["éne", "THE"])).select("item_id")


@query("F5_quick_search", with_catalogue("SELECT id, name FROM catalogue WHERE contains(lower(name), 'ring') ORDER BY id LIMIT 30"))
def quick_search(spark, sf):
    return filters.quick_search(catalogue(spark, sf), " Ring ", "id", 30).select("id", "name")


_LOUD = "'Live Set ' || CASE WHEN id % 5 = 0 THEN 'Non-Stop Megamix' WHEN id % 5 = 1 THEN 'mega mixer' ELSE 'year mix' END || CASE WHEN id % 7 = 0 THEN ' vs A vs B' ELSE ' vs A' END"


@query("F9_mix_words", with_catalogue(
    "SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(n), '\\b(?:mega mix|megamix|live set|non-stop|year mix)\\b'))), ',') AS words, "
    f"id % 7 = 0 AS mashup FROM (SELECT id, {_LOUD} AS n FROM catalogue)"))
def mix_words(spark, sf):
    rows = catalogue(spark, sf).select("id", F.expr(_LOUD).alias("n"))
    return rows.select("id", F.array_join(text.matching_words("n"), ",").alias("words"), text.looks_like_mashup("n").alias("mashup"))


_F8 = (f"SELECT id, n, duration, CAST(duration * 10 AS BIGINT) AS size, duration BETWEEN 120 AND 420 AS l, true AS w, id % 7 = 0 AS v "
       f"FROM (SELECT *, {_LOUD} AS n FROM catalogue)")


@query("F8_mix_reasons", with_catalogue(
    "SELECT id, CASE WHEN l THEN '2–7 min|' ELSE '' END || 'name: ' || CASE WHEN id % 5 = 0 THEN 'live set, megamix, non-stop' "
    "WHEN id % 5 = 1 THEN 'live set' ELSE 'live set, year mix' END || CASE WHEN v THEN '|two “vs”' ELSE '' END AS reasons "
    f"FROM ({_F8}) WHERE l"))
def mix_reasons(spark, sf):
    rows = catalogue(spark, sf).withColumn("n", F.expr(_LOUD))
    found = filters.mix_reasons(rows, 2, 7, "both", name="n", seconds="duration")
    return found.filter("kept").select("id", F.array_join("reasons", "|").alias("reasons"))


@query("F8_mix_summary", with_catalogue(
    f"SELECT count_if(l) AS by_length, count(*) AS by_name, count(*) AS kept, CAST(sum(size) AS BIGINT) AS bytes, count_if(duration <= 60) AS short FROM ({_F8})"))
def mix_summary(spark, sf):
    rows = catalogue(spark, sf).withColumn("n", F.expr(_LOUD)).withColumn("size", (F.col("duration") * 10).cast("long"))
    return filters.mix_summary(filters.mix_reasons(rows, 2, 7, "either", name="n", seconds="duration"), seconds="duration")
