"""Row filters over the catalogue."""

from pyspark.sql import functions as F

from ..functions.columns import labels
from ..operators import filters
from . import query
from .stand_ins import catalogue, with_catalogue


def _listed(spark, sf):
    return catalogue(spark, sf).withColumn("genre_list", labels("genres")).withColumn("mood_list", labels("moods"))


@query("F1_library_filter", with_catalogue(
    "SELECT id FROM catalogue WHERE split_part(genres, '; ', 1) IN ('SMALL - ring', 'LARGE - widget', 'PROMO - ring') "
    "AND list_has_any(string_split(moods, '; '), ['Dark', 'Sad', 'Party']) AND (bpm IS NULL OR bpm BETWEEN 80 AND 150) "
    "AND (danceability IS NULL OR danceability BETWEEN 0.1 AND 0.9)"))
def library_filter(spark, sf):
    wanted = filters.Wanted(genres=["SMALL - ring", "LARGE - widget", "PROMO - ring"], genre_depth=1, moods=["Dark", "Sad", "Party"],
                            bpm=(80, 150), groove=(0.1, 0.9))
    return filters.filter_rows(_listed(spark, sf), wanted).select("id")


@query("F2_chapter_ranges", with_catalogue(
    "SELECT 'bpm' AS measure, round(quantile_cont(bpm, 0.7), 6) AS low, round(quantile_cont(bpm, 1.0), 6) AS high FROM catalogue UNION ALL "
    "SELECT 'groove', round(quantile_cont(danceability, 0.0), 6), round(quantile_cont(danceability, 0.9), 6) FROM catalogue UNION ALL "
    "SELECT 'energy', 0.85e0, 1e0 UNION ALL SELECT 'valence', 0.75e0, 1e0"))
def chapter_ranges(spark, sf):
    found = filters.chapter_ranges(catalogue(spark, sf), "Climax")
    return found.select("measure", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("F3_span", with_catalogue("SELECT min(bpm) AS low, max(bpm) AS high FROM catalogue"))
def span(spark, sf):
    return filters.span(catalogue(spark, sf), "bpm", 60.0, 200.0)


@query("F6_playable", with_catalogue("SELECT id FROM catalogue WHERE duration = 0 OR duration >= 60"))
def playable(spark, sf):
    return filters.playable(catalogue(spark, sf)).select("id")


@query("F7_longer_than", with_catalogue("SELECT id, duration FROM catalogue WHERE duration > 300"))
def longer_than(spark, sf):
    return filters.longer_than(catalogue(spark, sf), 5, "duration").select("id", "duration")


@query("F7_lasting_between", with_catalogue("SELECT id, duration FROM catalogue WHERE duration > 120 AND duration <= 300"))
def lasting_between(spark, sf):
    return filters.lasting_between(catalogue(spark, sf), 2, 5, "duration").select("id", "duration")


@query("F11_absent_family", with_catalogue("SELECT id FROM catalogue WHERE energy_density IS NULL"))
def absent_family(spark, sf):
    rows = catalogue(spark, sf).withColumn("has_energy", F.col("energy_density").isNotNull())
    return filters.absent_family(rows, "has_energy").select("id")


@query("F11_absent_marker", with_catalogue("SELECT id FROM catalogue WHERE valence IS NULL"))
def absent_marker(spark, sf):
    return filters.absent_marker(catalogue(spark, sf), "valence").select("id")


@query("T18_table_sort", with_catalogue(
    "SELECT id, row_number() OVER (ORDER BY bpm NULLS LAST, id) AS place FROM catalogue"))
def table_sort(spark, sf):
    from ..plans.ordered import indexed
    number = F.col("bpm").cast("string").try_cast("double")
    sorted_rows = indexed(catalogue(spark, sf), [number.asc_nulls_last(), F.col("id")], "place")
    return sorted_rows.select("id", (F.col("place") + 1).alias("place"))
