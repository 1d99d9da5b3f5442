"""Synchronisation, sources and sinks over the documents seen as files."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_uri_path
from ..operators import sync
from ..plans.session import checkpoint_dir
from ..sources import catalogue_files, file_tree, playlist_files
from . import query
from .playlists import numbered
from .stand_ins import CATALOGUE, MANIFEST, POSITIONS, catalogue, manifest, table, with_catalogue

# The stored catalogue: most files, some with another size, some since gone.
_STORED = f"""SELECT CASE WHEN doc_id % 10 = 1 THEN path || '.old' ELSE path END AS path, doc_id, CASE WHEN doc_id % 10 = 2 THEN size + 1 ELSE size END AS size, mtime, lang AS folder
 FROM ({MANIFEST}) WHERE doc_id % 10 <> 3"""


def stored(spark, sf):
    files = manifest(spark, sf)
    path = F.when(F.col("doc_id") % 10 == 1, F.concat("path", F.lit(".old"))).otherwise(F.col("path"))
    size = F.when(F.col("doc_id") % 10 == 2, F.col("size") + 1).otherwise(F.col("size"))
    return files.filter(F.col("doc_id") % 10 != 3).select(path.alias("path"), "doc_id", size.alias("size"), "mtime", F.col("lang").alias("folder"))


@query("J3_pending", f"SELECT doc_id FROM ({MANIFEST}) WHERE doc_id % 10 IN (1, 2, 3)")
def pending(spark, sf):
    return sync.pending(manifest(spark, sf), stored(spark, sf)).select("doc_id")


@query("J4_vanished", f"SELECT path FROM ({_STORED}) WHERE doc_id % 10 = 1 AND starts_with(path, '/root/src1/')")
def vanished(spark, sf):
    return sync.vanished(stored(spark, sf), manifest(spark, sf), "/root/src1").select("path")


@query("J5_pruned", f"SELECT path FROM ({_STORED}) WHERE NOT (doc_id % 10 = 1 AND starts_with(path, '/root/'))")
def pruned(spark, sf):
    return sync.pruned(stored(spark, sf), manifest(spark, sf), "/root").select("path")


@query("J6_relocated", f"""SELECT s.path AS path, s.moved, f.path IS NULL AND s.moved AS not_found, CASE WHEN s.moved AND f.size = s.size THEN f.mtime ELSE s.mtime END AS mtime FROM (
 SELECT CASE WHEN moved THEN '/root/src2' || substr(path, 11) ELSE path END AS path, moved, size, mtime FROM (SELECT *, path = '/root/src1' OR starts_with(path, '/root/src1/') AS moved FROM ({_STORED}))) s
 LEFT JOIN (SELECT path, size, mtime + 7 AS mtime FROM ({MANIFEST})) f ON f.path = s.path""")
def relocated(spark, sf):
    files = manifest(spark, sf).select("path", "size", (F.col("mtime") + 7).alias("mtime"))
    return sync.relocated(stored(spark, sf), files, "/root/src1", "/root/src2/").select("path", "moved", "not_found", "mtime")


@query("J6_relocation_summary", f"SELECT count(*) AS moved, count(*) FILTER (WHERE '/elsewhere' || substr(path, 11) NOT IN (SELECT path FROM ({MANIFEST}))) AS not_found FROM ({_STORED}) WHERE starts_with(path, '/root/src1/')")
def relocation_summary(spark, sf):
    return sync.relocation_summary(sync.relocated(stored(spark, sf), manifest(spark, sf), "/root/src1", "/elsewhere"))


@query("J7_work_queue", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def work_queue(spark, sf):
    return sync.work_queue(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("J17_already_done", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def already_done(spark, sf):
    return sync.already_done(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("J8_cache_hits", f"SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (1, 2, 3) AND doc_id % 4 <> 0 THEN 'v' || doc_id END AS data FROM ({MANIFEST})")
def cache_hits(spark, sf):
    cache = stored(spark, sf).select("path", "mtime", "size", F.when(F.col("doc_id") % 4 == 0, 7).otherwise(8).alias("version"),
                                     F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("data"))
    return sync.cached(manifest(spark, sf), cache, 8).select("doc_id", "data")


@query("U5_log_summary", "SELECT count(DISTINCT user_id) AS done, count(*) - count(DISTINCT user_id) AS duplicate_lines FROM events")
def log_summary(spark, sf):
    log = table(spark, sf, "events").select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("path"))
    return sync.log_summary(log)


@query("U5_marked_once", "SELECT DISTINCT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def marked_once(spark, sf):
    return sync.marked(table(spark, sf, "labels").select(F.col("doc_id").alias("path")), table(spark, sf, "documents").select(F.col("doc_id").alias("path")))


@query("S1_latest_rows", "SELECT user_id AS path, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_rows(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.struct("ts", "event_id").alias("seq"), "event_id", "value")
    return sync.latest(rows).select("path", "event_id", "value")


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S1_stored_lines", with_catalogue("SELECT path || '#' || id AS path, bpm, energy_pulse FROM catalogue WHERE id % 7 <> 0"))
def stored_lines(spark, sf):
    """Rows written twice, the older one with another tempo, some with an error, plus a line cut short."""
    rows = catalogue(spark, sf).withColumn("path", F.concat("path", F.lit("#"), F.col("id").cast("string")))
    said = rows.select((F.col("id") * 2 + 1).alias("seq"), "path", "bpm", "energy_pulse", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"),
                       F.when(F.col("id") % 7 == 0, F.lit("too short")).alias("error"))
    older = said.withColumn("seq", F.col("seq") - 1).withColumn("bpm", F.lit(1.0)).filter(F.col("error").isNull())
    lines = said.unionByName(older).select(F.to_json(F.struct("*")).alias("value"))
    torn = lines.select(F.substring("value", 1, 30).alias("value"))
    path = _scratch(spark, "rows")
    lines.unionByName(torn).write.text(path)
    return catalogue_files.read_rows(spark, path).select("path", "bpm", "energy_pulse")


@query("S2_appended_rows", with_catalogue("SELECT id FROM catalogue WHERE id % 7 <> 0 AND id % 5 <> 0"))
def appended_rows(spark, sf):
    rows = catalogue(spark, sf).select("id", F.when(F.col("id") % 7 == 0, F.lit("x")).alias("error"), F.when(F.col("id") % 5 != 0, F.array("x", "y")).alias("embedding"))
    path = _scratch(spark, "appended")
    catalogue_files.append_rows(rows, path)
    return spark.read.parquet(path).select("id")


@query("S3_rewritten_rows", with_catalogue("SELECT path, bpm, id * 2 AS doubled FROM catalogue"))
def rewritten_rows(spark, sf):
    rows = catalogue(spark, sf)
    path = _scratch(spark, "rewritten")
    catalogue_files.rewritten(sync.with_fields(rows, rows.select("id", (F.col("id") * 2).alias("doubled")), "id"), path)
    return spark.read.parquet(path).select("path", "bpm", "doubled")


@query("S4_manifest_of_a_tree", f"SELECT regexp_extract(path, '([^/]*)$', 1) AS file, md5(text) AS content FROM (SELECT DISTINCT '/x/' || source || '.txt' AS path, 'of ' || source AS text FROM documents)")
def manifest_of_a_tree(spark, sf):
    """One small file per source, written to the shared folder, listed without reading and then read."""
    root = _scratch(spark, "tree")
    names = table(spark, sf, "documents").select("source").distinct()
    names.select("source", F.concat(F.lit("of "), "source").alias("value")).repartition("source").write.partitionBy("source").text(root)
    listed = catalogue_files.manifest(spark, root).filter(F.col("path").endswith(".txt"))
    found = listed.withColumn("source", F.regexp_extract("path", "source=([^/]+)/", 1)).join(catalogue_files.with_content(spark, root, listed), "path")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\\s+$", "")
    return found.select(F.concat("source", F.lit(".txt")).alias("file"), F.explode(F.split(text, "\n")).alias("line")).select(
        "file", F.md5(F.encode("line", "UTF-8")).alias("content"))


def _hidden_tree(spark, sf):
    """A line per document, in files under folders whose names Spark's own listing passes over."""
    root = _scratch(spark, "hidden")
    lines = table(spark, sf, "documents").select(F.col("source").alias("_source"), "doc_id", F.concat_ws(" ", "doc_id", "lang", F.md5("text")).alias("value"))
    lines.repartition("_source").sortWithinPartitions("_source", "doc_id").select("_source", "value").write.partitionBy("_source").text(root)
    files = catalogue_files.manifest(spark, root).filter(F.col("path").endswith(".txt"))
    return files.withColumn("source", F.regexp_extract("path", "_source=([^/]+)/", 1))


_LINES = "SELECT source, doc_id, concat_ws(' ', doc_id, lang, md5(text)) AS line FROM documents"


@query("S4_hidden_names", f"SELECT source, count(DISTINCT source) AS files, sum(length(line) + 1) AS size FROM ({_LINES}) GROUP BY source")
def hidden_names(spark, sf):
    return _hidden_tree(spark, sf).groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


@query("S9_lines_with_offsets", f"SELECT source, line, sum(length(line) + 1) OVER (PARTITION BY source ORDER BY doc_id) - length(line) - 1 AS \"offset\" FROM ({_LINES})")
def lines_with_offsets(spark, sf):
    """Files cut every 4,096 bytes, so that most lines cross a cut or stand beside one."""
    files = _hidden_tree(spark, sf)
    return file_tree.read_lines(files, 4_096).join(files.select("path", "source"), "path").select("source", "line", "offset")


@query("S5_analysed_extensions", f"SELECT doc_id FROM ({MANIFEST}) WHERE lower(path) LIKE '%.mp3' OR lower(path) LIKE '%.flac'")
def analysed_extensions(spark, sf):
    return catalogue_files.with_extensions(manifest(spark, sf), catalogue_files.ANALYSED).select("doc_id")


@query("S6_taggable", f"SELECT doc_id FROM ({MANIFEST}) WHERE (lower(path) LIKE '%.mp3' OR lower(path) LIKE '%.flac' OR lower(path) LIKE '%.m4a') AND path NOT LIKE '%/._%'")
def taggable(spark, sf):
    return catalogue_files.taggable(manifest(spark, sf)).select("doc_id")


@query("S7_report_csv", with_catalogue("SELECT path, top_genre, duration FROM catalogue"))
def report_csv(spark, sf):
    path = _scratch(spark, "report")
    catalogue_files.write_report(catalogue(spark, sf), path, "csv", ["path", "top_genre", "duration"])
    return spark.read.schema("path string, top_genre string, duration double").option("header", True).csv(path)


@query("S7_report_json", with_catalogue("SELECT path, split_part(genres, '; ', 1) AS first FROM catalogue"))
def report_json(spark, sf):
    path = _scratch(spark, "report")
    catalogue_files.write_report(catalogue(spark, sf).select("path", F.split("genres", "; ").alias("genres")), path, "json")
    return spark.read.schema("path string, genres array<string>").json(path).select("path", F.element_at("genres", 1).alias("first"))


@query("S9_playlist_lines", f"""SELECT playlist, row_number() OVER (PARTITION BY playlist ORDER BY pos) - 1 AS pos, path FROM ({POSITIONS}) p JOIN ({CATALOGUE}) c ON c.id = p.track""")
def playlist_lines(spark, sf):
    rows = numbered(spark, sf).rows.join(catalogue(spark, sf).withColumnRenamed("id", "track"), "track").withColumn("artist", F.lit("A"))
    lines = playlist_files.m3u8_lines(rows)
    plain = F.col("line").startswith("/") & (F.col("line_no") % 4 == 1)
    uri = F.concat(F.lit("file://localhost"), F.regexp_replace(F.regexp_replace("line", " ", "%20"), "#", "%23"))
    return playlist_files.parse_m3u8(lines.withColumn("line", F.when(plain, uri).otherwise(F.col("line"))), ["line_no"])


@query("S9_page_addresses", "SELECT page_id, '/' || regexp_replace(regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1), '', '') AS path FROM pages")
def page_addresses(spark, sf):
    uri = F.regexp_replace("url", "^https?:", "file:")
    return table(spark, sf, "pages").select("page_id", file_uri_path(uri).alias("path"))


@query("S11_shelf_files", """SELECT CAST(o_orderpriority AS VARCHAR) AS playlist, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos,
 '/o/' || CAST(o_orderkey AS VARCHAR) AS path FROM orders""")
def shelf_files(spark, sf):
    """Five playlists of orders, written as files and read back by their folder."""
    orders = table(spark, sf, "orders")
    from ..plans.ordered import positions
    seq = positions(orders.select(F.col("o_orderpriority").alias("playlist"), F.col("o_orderkey")), ["playlist"], ["o_orderkey"])
    rows = seq.rows.select("playlist", "pos", F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit("n").alias("name"),
                           F.lit("").alias("artist"), F.lit(1.0).alias("duration"))
    folder = _scratch(spark, "shelf")
    playlist_files.write_m3u8(rows, folder)
    return playlist_files.read_shelf(spark, folder)


_JOURNAL = "SELECT event_id, event_type, CAST(user_id AS BIGINT) AS user_id FROM events"


@query("S12_journal_facts", f"SELECT e.event_id, e.event_type AS kind, c.bpm, c.camelot FROM ({_JOURNAL}) e LEFT JOIN ({CATALOGUE}) c ON c.id = e.user_id")
def journal_facts(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("id"))
    return catalogue_files.with_facts(events, catalogue(spark, sf).select("id", "bpm", "camelot"), "id").select("event_id", "kind", "bpm", "camelot")


@query("S13_journal_read", "SELECT event_id, event_type AS kind, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def journal_read(spark, sf):
    """The journal written as lines, each followed by a torn copy, then read."""
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"), "event_id", "props")
    path = _scratch(spark, "journal")
    catalogue_files.append_journal(events, path)
    torn = spark.read.text(path).select(F.substring("value", 1, 25).alias("value"))
    schema = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("props", T.StringType())])
    lines = catalogue_files.journal_lines(spark.read.text(path).unionByName(torn), schema)
    return lines.select("event_id", "kind", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("S14_path_list", with_catalogue("SELECT row_number() OVER (ORDER BY path) + 2 AS line_no, path AS line FROM catalogue UNION ALL SELECT 0, '# All of it' UNION ALL "
                                       "SELECT 1, '# ' || count(*) || ' tracks' FROM catalogue UNION ALL SELECT 2, ''"))
def path_list(spark, sf):
    return playlist_files.path_list(catalogue(spark, sf), "All of it")


_LEVELS = "SELECT id, path, name, CASE WHEN id % 6 = 0 THEN NULL ELSE id % 10 + 1 END AS level FROM catalogue"


@query("S15_sample_read_back", with_catalogue(f"SELECT path, level FROM ({_LEVELS})"))
def sample_read_back(spark, sf):
    rows = catalogue(spark, sf).select("path", F.when(F.col("id") % 6 != 0, F.col("id") % 10 + 1).alias("level"))
    path = _scratch(spark, "sample")
    catalogue_files.write_report(rows, path)
    return catalogue_files.read_sample(spark, path, "path string, level bigint")


@query("S16_ramp_playlist", with_catalogue(f"SELECT row_number() OVER (ORDER BY level NULLS LAST, path) AS line_no, '#EXTINF:-1,' || coalesce(CAST(level AS VARCHAR), '?') || ' · ' || name AS info, path FROM ({_LEVELS})"))
def ramp_playlist(spark, sf):
    rows = catalogue(spark, sf).select("path", F.col("name").alias("file"), F.when(F.col("id") % 6 != 0, F.col("id") % 10 + 1).alias("level"))
    return playlist_files.ramp_lines(rows)


@query("S17_sidecar_analyses", "SELECT p_partkey AS path, 1 AS seq, 4 AS sections, 2e1 + p_partkey % 7 AS second FROM part")
def sidecar_analyses(spark, sf):
    """One nested record per part, an older one without sections beside it, read back."""
    from .segments import nested
    whole = nested(spark, sf).select(F.col("track").alias("path"), F.lit(1).cast("long").alias("seq"), "sections")
    path = _scratch(spark, "sidecars")
    catalogue_files.write_sidecars(whole, path)
    catalogue_files.write_sidecars(whole.withColumn("seq", F.lit(0).cast("long")).withColumn("sections", F.slice("sections", 1, 0)), path)
    return catalogue_files.read_sidecars(spark, path, whole.schema).select(
        "path", "seq", F.size("sections").alias("sections"), F.element_at("sections", 2)["start"].alias("second"))


@query("ST5_backfilled", with_catalogue("SELECT id, coalesce(valence, bpm / 1e3) AS valence FROM catalogue"))
def backfilled(spark, sf):
    rows = catalogue(spark, sf)
    out = sync.backfilled(rows, F.col("valence").isNull(), lambda df: df.withColumn("valence", F.col("bpm") / 1e3), ["valence"], "id")
    return out.select("id", "valence")


@query("UF2_caller_keys", with_catalogue("SELECT folder AS voice, count(*) AS copies, min(id) AS first FROM catalogue GROUP BY folder"))
def caller_keys(spark, sf):
    key = F.col("folder")  # any expression of the caller's
    return catalogue(spark, sf).groupBy(key.alias("voice")).agg(F.count("*").alias("copies"), F.min("id").alias("first"))


@query("UF3_attempted_rows", with_catalogue("SELECT id, CASE WHEN bpm IS NOT NULL THEN round(60 / bpm, 6) END AS beat, CASE WHEN bpm IS NULL THEN 'ValueError: no tempo' END AS error FROM catalogue"))
def attempted_rows(spark, sf):
    def beat(row):
        if row["bpm"] is None or row["bpm"] != row["bpm"]:
            raise ValueError("no tempo")
        return {"beat": 60.0 / row["bpm"]}

    return sync.attempted(catalogue(spark, sf), beat, "beat double", ["id", "bpm"]).select("id", F.round("beat", 6).alias("beat"), "error")


@query("UF4_other_hash", f"SELECT doc_id, sha256(text) AS md5 FROM ({MANIFEST}) WHERE size IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) > 1)")
def other_hash(spark, sf):
    from ..operators.duplicates import with_hash
    return with_hash(manifest(spark, sf), F.sha2("text", 256)).select("doc_id", "md5")


@query("ST4_first_errors", with_catalogue("SELECT id, 'no tempo' AS error FROM catalogue WHERE bpm IS NULL ORDER BY id LIMIT 100"))
def first_errors(spark, sf):
    rows = catalogue(spark, sf).withColumn("error", F.when(F.col("bpm").isNull(), F.lit("no tempo")))
    return sync.first_errors(rows, "id").select("id", "error")


@query("ST4_error_counts", with_catalogue("SELECT count(*) AS done, count(*) FILTER (bpm IS NULL) AS failed FROM catalogue"))
def error_counts(spark, sf):
    """All errors of a job, beside the first hundred that are told one by one."""
    return sync.job_summary(catalogue(spark, sf).withColumn("error", F.when(F.col("bpm").isNull(), F.lit("no tempo"))))


@query("V3_projection")
def projection(spark, sf):
    from ..operators.projection import project
    from .stand_ins import tracks
    return project(tracks(spark, sf), 8).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
