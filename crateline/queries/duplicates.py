"""Duplicate hunt on the documents seen as files."""

from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..operators import duplicates as dup
from . import query
from .stand_ins import MANIFEST, catalogue, manifest, table, with_catalogue
from .text import SONG_KEY

_F = f"(SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)$', 1) AS file FROM ({MANIFEST}))"
_SIZES = "SELECT size FROM documents_f GROUP BY size HAVING count(*) > 1"
_QUALITY = ("(CASE WHEN regexp_matches(regexp_replace(file, '(.)\\.[^.]+$', '\\1'), '(\\(\\d+\\)$|\\bcopy\\b|\\bcopia\\b|\\bconflicted\\b)', 'i') THEN 1 ELSE 0 END, "
            "len(file) - len(replace(file, '_', '')), len(list_filter(string_split(path, '/'), lambda p: p <> '')), path)")
_WITH = f"""WITH documents_f AS {_F}, hashed AS (SELECT *, md5(text) AS md5, {_QUALITY} AS q FROM documents_f WHERE size IN ({_SIZES})),
 same AS (SELECT h.* FROM hashed h JOIN (SELECT size, md5, min(path) AS probe FROM hashed GROUP BY size, md5 HAVING count(*) > 1) USING (size, md5)),
 probes AS (SELECT size, md5, min(path) AS probe FROM same GROUP BY size, md5),
 good AS (SELECT s.* FROM same s JOIN probes p USING (size, md5) WHERE p.probe NOT LIKE '%.txt')"""


def _hashed(spark, sf):
    return dup.with_hash(manifest(spark, sf), F.md5("text"))


def _probes(same):
    # The probe of a set is its first path; text files stand for unreadable ones.
    return same.select("probe").distinct().select(
        F.col("probe").alias("path"), F.when(F.col("probe").endswith(".txt"), F.lit("no audio header")).alias("reason"))


def _sound(spark, sf):
    same = dup.identical(_hashed(spark, sf))
    return dup.sound(same, _probes(same))


@query("DD1_hash_candidates", f"{_WITH} SELECT doc_id, size, md5 FROM hashed")
def hash_candidates(spark, sf):
    return _hashed(spark, sf).select("doc_id", "size", "md5")


@query("DD2_identical_sets", f"{_WITH} SELECT size, md5, count(*) AS copies FROM same GROUP BY size, md5")
def identical_sets(spark, sf):
    return dup.identical(_hashed(spark, sf)).groupBy("size", "md5").agg(F.count("*").alias("copies"))


@query("DD3_broken_sets", f"{_WITH} SELECT doc_id, 'no audio header' AS reason FROM same s JOIN probes p USING (size, md5) WHERE p.probe LIKE '%.txt'")
def broken_sets(spark, sf):
    same = dup.identical(_hashed(spark, sf))
    return dup.broken(same, _probes(same)).select("doc_id", "reason")


_A = "SELECT g.*, k.keep, k.copies FROM good g JOIN (SELECT size, md5, folder, arg_min(path, q) AS keep, count(*) AS copies FROM good GROUP BY ALL HAVING count(*) > 1) k USING (size, md5, folder)"
_REPS = "SELECT size, md5, folder, arg_min(path, q) AS path, min(q) AS q FROM good GROUP BY ALL"
_B = f"SELECT r.*, k.keep, k.copies FROM ({_REPS}) r JOIN (SELECT size, md5, arg_min(path, q) AS keep, count(*) AS copies FROM ({_REPS}) GROUP BY ALL HAVING count(*) > 1) k USING (size, md5)"


@query("DD4_same_folder", f"{_WITH} SELECT path, keep, copies FROM ({_A})")
def same_folder(spark, sf):
    return dup.same_folder(_sound(spark, sf)).select("path", "keep", "copies")


@query("DD5_other_folder", f"{_WITH} SELECT path, keep, copies FROM ({_B})")
def other_folder(spark, sf):
    return dup.other_folder(_sound(spark, sf)).select("path", "keep", "copies")


def _similar_files(spark, sf):
    """The manifest with short names, so that many files share a reduced name."""
    files = manifest(spark, sf)
    short = F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/Track "), (F.col("doc_id") % 61).cast("string"),
                     F.when(F.col("doc_id") % 5 == 0, F.lit(" (1)")).otherwise(F.lit("")), F.lit(".mp3"))
    return files.withColumn("path", short)


_SIM = f"""WITH f1 AS (SELECT doc_id, size, text, regexp_replace(path, '/[^/]*$', '') || '/d' || doc_id || '/Track ' || doc_id % 61 || CASE WHEN doc_id % 5 = 0 THEN ' (1)' ELSE '' END || '.mp3' AS path FROM ({MANIFEST})),
 f2 AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS file, CASE WHEN size IN (SELECT size FROM f1 GROUP BY size HAVING count(*) > 1) THEN md5(text) END AS md5 FROM f1),
 f3 AS (SELECT *, trim(regexp_replace(lower(regexp_replace(file, '(.)\\.[^.]+$', '\\1')), '[^a-z0-9]+', ' ', 'g')) AS name_key, {_QUALITY} AS q FROM f2),
 g AS (SELECT name_key, max(size) AS group_size, count(*) AS copies, arg_min(path, q) AS keep FROM f3 GROUP BY name_key
   HAVING count(*) > 1 AND NOT (count(DISTINCT size) = 1 AND count(md5) = count(*) AND count(DISTINCT md5) = 1)),
 sim AS (SELECT f3.*, g.group_size, g.copies, g.keep FROM f3 JOIN g USING (name_key))"""


def _similar(spark, sf):
    files = _similar_files(spark, sf)
    return dup.similar_name(files, dup.with_hash(files, F.md5("text")))


@query("DD6_similar_name", f"{_SIM} SELECT path, name_key, keep, copies, group_size FROM sim")
def similar_name(spark, sf):
    return _similar(spark, sf).select("path", "name_key", "keep", "copies", "group_size")


@query("DD7_keeper", f"{_SIM} SELECT name_key, keep FROM g")
def keeper(spark, sf):
    return _similar(spark, sf).filter("is_keep").select("name_key", "keep")


def _levels(spark, sf):
    same = _sound(spark, sf)
    files = manifest(spark, sf)
    return dup.all_groups(dup.same_folder(same), dup.other_folder(same), dup.similar_name(files, _hashed(spark, sf)))


_U2 = f"""{_WITH}, named AS (SELECT d.*, h.md5, trim(regexp_replace(lower(regexp_replace(d.file, '(.)\\.[^.]+$', '\\1')), '[^a-z0-9]+', ' ', 'g')) AS name_key, {_QUALITY.replace('file', 'd.file').replace("path, '/'", "d.path, '/'").replace(', path)', ', d.path)')} AS q
  FROM documents_f d LEFT JOIN hashed h ON h.path = d.path),
 c AS (SELECT n.path, k.* FROM named n JOIN (SELECT name_key, max(size) AS size, count(*) AS copies, arg_min(path, q) AS keep FROM named GROUP BY name_key
   HAVING count(*) > 1 AND NOT (count(DISTINCT size) = 1 AND count(md5) = count(*) AND count(DISTINCT md5) = 1)) k USING (name_key)),
 levels AS (SELECT 'DUPLICATE_SAME_FOLDER' AS level, size, md5, keep, path, copies FROM ({_A}) UNION ALL
  SELECT 'DUPLICATE_OTHER_FOLDER', size, md5, keep, path, copies FROM ({_B}) UNION ALL SELECT 'SIMILAR_NAME', size, NULL, keep, path, copies FROM c)"""


@query("U2_all_levels", f"{_U2} SELECT level, size, keep, path, copies FROM levels")
def all_levels(spark, sf):
    return _levels(spark, sf).select("level", "size", "keep", "path", "copies")


@query("U3_extra_copies", f"{_U2} SELECT level, path FROM levels WHERE path <> keep")
def extra_copies(spark, sf):
    return dup.extra_copies(_levels(spark, sf)).select("level", "path")


_HUMAN = ("CASE WHEN size < 1024 THEN printf('%.0f B', size::DOUBLE) ELSE printf('%.1f KB', round_even(size / 1024, 1)) END")


@query("S8_duplicate_report", f"""{_U2} SELECT CASE WHEN level = 'DUPLICATE_SAME_FOLDER' THEN 'DELETE' ELSE 'REVIEW' END AS action, level,
 regexp_replace(keep, '/[^/]*$', '') AS folder, keep, path AS "delete", size AS size_bytes, {_HUMAN} AS size, coalesce(md5, '') AS md5, copies FROM levels WHERE path <> keep""")
def duplicate_report(spark, sf):
    return dup.report_rows(_levels(spark, sf))


@query("A34_wasted_bytes", f"{_U2} SELECT level, keep, max(size) * (max(copies) - 1) AS wasted_bytes FROM levels GROUP BY level, keep")
def wasted_bytes(spark, sf):
    return dup.wasted_bytes(_levels(spark, sf))


@query("J14_against_kept", f"""{_SIM} SELECT b.path AS file_b, b.keep AS file_a, a.size = b.size AS same_size, a.file = b.file AS same_name,
 coalesce(a.size = b.size AND a.md5 = b.md5, false) AS same_hash FROM sim b JOIN f3 a ON a.path = b.keep WHERE b.path <> b.keep""")
def against_kept(spark, sf):
    return dup.against_kept(_similar(spark, sf)).select("file_a", "file_b", "same_size", "same_name", "same_hash")


@query("J14_pair_counts", f"""{_SIM} SELECT a.name_key, count(*) AS pairs, count_if(a.size = b.size) AS same_size, count_if(a.file = b.file) AS same_name,
 count_if(a.size = b.size AND a.md5 = b.md5) AS same_hash FROM sim a JOIN sim b ON a.name_key = b.name_key AND a.q < b.q GROUP BY a.name_key""")
def pair_counts(spark, sf):
    return dup.pair_counts(_similar(spark, sf))


@query("F15_matching_copies", f"{_SIM} SELECT DISTINCT b.path FROM sim a JOIN sim b ON a.name_key = b.name_key AND a.q < b.q WHERE a.size = b.size AND a.file = b.file")
def matching_copies(spark, sf):
    return dup.matching_copies(_similar(spark, sf)).select("path")


@query("A33_files_and_bytes", f"{_SIM} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM sim")
def files_and_bytes(spark, sf):
    return dup.files_and_bytes(dup.against_kept(_similar(spark, sf)))


_PLAN = f"""SELECT path, ord, '/root/src1/_DUPLICATES_TO_DELETE' || CASE WHEN folder = '/root/src1' THEN '' WHEN starts_with(folder, '/root/src1/') THEN substr(folder, 11) ELSE '/' || regexp_extract(folder, '([^/]*)$', 1) END || '/' AS base,
 regexp_replace(file, '(.)\\.[^.]+$', '\\1') AS stem, regexp_extract(file, '.(\\.[^.]+)$', 1) AS suffix FROM (SELECT *, doc_id AS ord FROM (
  SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)$', 1) AS file FROM (SELECT doc_id, '/root/' || source || '/' || lang || '/t' || doc_id % 31 || '.mp3' AS path FROM documents) x) y) z"""


def _chosen(spark, sf):
    path = F.concat(F.lit("/root/"), "source", F.lit("/"), "lang", F.lit("/t"), (F.col("doc_id") % 31).cast("string"), F.lit(".mp3"))
    return table(spark, sf, "documents").select(path.alias("path"), F.col("doc_id").alias("ord"))


@query("DD8_quarantine_plan", f"""SELECT path, ord, base || stem || CASE WHEN n = 0 THEN '' ELSE '__' || n END || suffix AS target FROM (
 SELECT *, row_number() OVER (PARTITION BY base || stem || suffix ORDER BY ord, path) - 1 AS n FROM (SELECT path, min(ord) AS ord, base, stem, suffix FROM ({_PLAN}) GROUP BY ALL))""".replace(
     "SELECT path, min(ord) AS ord, base, stem, suffix FROM", "SELECT path, min(ord) AS ord, any_value(base) AS base, any_value(stem) AS stem, any_value(suffix) AS suffix FROM").replace("GROUP BY ALL))", "GROUP BY path))"))
def quarantine_plan(spark, sf):
    return dup.quarantine_plan(_chosen(spark, sf), "/root/src1")


# Targets that exist already: of some names the plain one, of some the first suffix, of some the third.
_ELEMENT = "CAST(regexp_extract(name, '/t([0-9]+)[.]', 1) AS INT)"
_EXISTING = (("", f"{_ELEMENT} < 10"), ("__1", f"{_ELEMENT} BETWEEN 5 AND 15"), ("__3", f"{_ELEMENT} < 20"))


@query("DD8_quarantine_beside_existing", f"""WITH wanted AS (SELECT path, min(ord) AS ord, any_value(base || stem) AS head, any_value(suffix) AS suffix FROM ({_PLAN}) GROUP BY path),
 asked AS (SELECT *, row_number() OVER (PARTITION BY head, suffix ORDER BY ord, path) AS nth, count(*) OVER (PARTITION BY head, suffix) AS many FROM wanted),
 heads AS (SELECT DISTINCT head, suffix, many, head || suffix AS name FROM asked),
 taken AS ({" UNION ALL ".join(f"SELECT name, {mark[2:] or 0} AS number FROM heads WHERE {where}" for mark, where in _EXISTING)}),
 open_ AS (SELECT head, suffix, number, row_number() OVER (PARTITION BY head, suffix ORDER BY number) AS nth FROM (SELECT head, suffix, name, unnest(range(many + 4)) AS number FROM heads) n
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.name = n.name AND t.number = n.number))
 SELECT path, ord, head || CASE WHEN number = 0 THEN '' ELSE '__' || number END || suffix AS target FROM asked JOIN open_ USING (head, suffix, nth)""")
def quarantine_beside_existing(spark, sf):
    chosen = _chosen(spark, sf)
    names = dup.quarantine_plan(chosen, "/root/src1").select(F.regexp_replace("target", "__[0-9]+([.][^./]+)$", "$1").alias("name")).distinct()
    there = [names.filter(where).select(F.regexp_replace("name", "([.][^./]+)$", f"{mark}$1").alias("path")) for mark, where in _EXISTING]
    return dup.quarantine_plan(chosen, "/root/src1", there[0].unionByName(there[1]).unionByName(there[2]))


@query("DD9_plan_outcome", f"SELECT count_if(there) AS moved, count_if(NOT there) AS missing FROM (SELECT path, path IN (SELECT path FROM ({MANIFEST})) AS there FROM "
       f"(SELECT path FROM ({MANIFEST}) UNION SELECT path || '.gone' FROM ({MANIFEST})))")
def plan_outcome(spark, sf):
    files = manifest(spark, sf).select("path")
    plan = files.unionByName(files.select(F.concat("path", F.lit(".gone")).alias("path")))
    return dup.plan_outcome(plan, files)


@query("DD12_sidecars", f"SELECT doc_id, doc_id % 3 = 0 AS confirmed FROM {_F} WHERE starts_with(file, '._')")
def sidecars(spark, sf):
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("00051607")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return dup.sidecars(manifest(spark, sf).withColumn("head", head)).select("doc_id", "confirmed")


@query("DD12_sidecar_summary", f"SELECT count_if(doc_id % 3 = 0) AS confirmed, count_if(doc_id % 3 <> 0) AS unverified, CAST(coalesce(sum(CASE WHEN doc_id % 3 = 0 THEN size END), 0) AS BIGINT) AS bytes, "
       f"(SELECT count(*) FROM documents) AS walked FROM {_F} WHERE starts_with(file, '._')")
def sidecar_summary(spark, sf):
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("00051607")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return dup.sidecar_summary(manifest(spark, sf).withColumn("head", head))


@query("DD13_integrity_summary", f"""SELECT outcome, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT CASE WHEN doc_id % 8 = 0 THEN 'missing' WHEN doc_id % 8 = 1 THEN 'empty file'
 WHEN path LIKE '%.txt' THEN 'no audio header' ELSE 'ok' END AS outcome, CASE WHEN doc_id % 8 = 0 THEN 0 WHEN doc_id % 8 = 1 THEN 0 ELSE size END AS size FROM ({MANIFEST})) GROUP BY outcome""")
def integrity_summary(spark, sf):
    asked = manifest(spark, sf)
    files = asked.filter(F.col("doc_id") % 8 != 0).withColumn("size", F.when(F.col("doc_id") % 8 == 1, 0).otherwise(F.col("size")))
    probes = files.filter(F.col("path").endswith(".txt")).select("path", F.lit("no audio header").alias("reason"))
    return dup.integrity_summary(dup.integrity(asked, files, probes))


@query("W15_song_doubles", with_catalogue(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY folder, {SONG_KEY} ORDER BY id) AS r FROM catalogue) WHERE r > 1"))
def song_doubles(spark, sf):
    from ..functions.text import song_key
    from ..operators.playlists import doubles
    rows = catalogue(spark, sf).withColumn("song", song_key("path"))
    return doubles(rows.withColumnRenamed("folder", "playlist"), "song", pos="id").select("id")


_FORMAT = "CASE WHEN starts_with(file, '._') THEN 'AppleDouble (._ macOS)' WHEN e = '.mp3' THEN 'MP3' WHEN e = '.flac' THEN 'FLAC' WHEN e = '.m4a' THEN 'M4A' ELSE 'OTHER' END"
_EXT = "lower(regexp_extract(file, '.(\\.[^./ ]+)$', 1))"
_FILES = f"(SELECT *, {_FORMAT} AS fmt, CASE WHEN e = '' THEN '(no extension)' ELSE e END AS ext FROM (SELECT *, {_EXT} AS e FROM {_F}))"


@query("P11_format_of", f"SELECT doc_id, fmt, ext FROM {_FILES}")
def format_of(spark, sf):
    return manifest(spark, sf).select("doc_id", fmt.format_of("path").alias("fmt"), fmt.extension_of("path").alias("ext"))


@query("P12_human_size", f"""SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1048576 THEN printf('%.1f KB', round_even(b / 1024, 1)) WHEN b < 1073741824 THEN printf('%.1f MB', round_even(b / 1048576, 1))
 ELSE printf('%.1f GB', round_even(b / 1073741824, 1)) END AS told FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars::DOUBLE WHEN 1 THEN n_chars * 1000e0 ELSE n_chars * 1000000e0 END AS b FROM documents)""")
def human_size(spark, sf):
    rows = table(spark, sf, "documents")
    size = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).when(F.col("doc_id") % 3 == 1, F.col("n_chars") * 1000).otherwise(F.col("n_chars") * 1000000)
    return rows.select("doc_id", fmt.human_size(size).alias("told"))


@query("P33_not_junk", f"SELECT doc_id, CASE WHEN e = '.xml' THEN 'library' END AS reason FROM (SELECT *, {_EXT} AS e FROM {_F})")
def not_junk(spark, sf):
    return manifest(spark, sf).select("doc_id", fmt.not_junk_reason("path").alias("reason"))


@query("F17_audio_only", f"SELECT doc_id FROM {_FILES} WHERE fmt NOT IN ('OTHER', 'AppleDouble (._ macOS)')")
def audio_only(spark, sf):
    return manifest(spark, sf).filter(fmt.is_audio(fmt.format_of("path"))).select("doc_id")


@query("A7_counts_and_sizes", f"""SELECT 'fmt' AS kind, fmt AS value, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM {_FILES} GROUP BY fmt UNION ALL
 SELECT 'ext', ext, count(*), CAST(sum(size) AS BIGINT) FROM {_FILES} GROUP BY ext UNION ALL SELECT 'total', NULL, count(*), CAST(sum(size) AS BIGINT) FROM {_FILES}""")
def counts_and_sizes(spark, sf):
    return dup.counts_by(manifest(spark, sf), ("fmt", fmt.format_of("path")), ("ext", fmt.extension_of("path")))


@query("T11_largest_of_extension", f"SELECT file, folder, {_HUMAN} AS size, strftime(make_timestamp(CAST(mtime * 1000000 AS BIGINT)), '%Y-%m-%d') AS modified, path, size AS bytes FROM {_FILES} WHERE ext = '.flac'")
def largest_of_extension(spark, sf):
    return dup.largest_of_extension(manifest(spark, sf), fmt.extension_of("path"), ".flac")


@query("A37_longest_duration", with_catalogue("SELECT max(duration) / 60 AS longest_minutes, count_if(duration <= 0) AS unknown FROM catalogue"))
def longest_duration(spark, sf):
    return dup.longest(catalogue(spark, sf), "duration")


@query("P19_short_file_verdict", with_catalogue("""SELECT id, CASE WHEN id % 10 = 0 THEN 'unreadable' WHEN energy_pulse >= 0.5 AND id % 4 <> 0 AND id % 6 <> 1 THEN 'cut off'
 WHEN energy_pulse >= 0.5 THEN 'ends sharp, untagged' ELSE 'finished' END AS verdict FROM catalogue"""))
def short_file_verdict(spark, sf):
    rows = catalogue(spark, sf).withColumns({
        "artist": F.when(F.col("id") % 4 != 0, F.col("name")), "title": F.when(F.col("id") % 6 == 1, F.lit("")).otherwise(F.col("name")),
        "error": F.when(F.col("id") % 10 == 0, F.lit("no decode"))})
    return rows.select("id", fmt.short_file_verdict("energy_pulse", "artist", "title", "error").alias("verdict"))
