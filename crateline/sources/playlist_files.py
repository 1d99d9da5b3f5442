"""Playlist files: one M3U8 text per playlist."""

from __future__ import annotations

import re
from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_uri_path
from ..plans.ordered import positions
from .file_tree import plain, read_lines, tree


#: Lines of one written file at most.
FILE_LINES = 100_000


def m3u8_lines(entries: DataFrame, playlist: str = "playlist", pos: str = "pos") -> DataFrame:
    """The lines of every playlist, numbered; the header has the lowest number."""
    title = F.when(F.coalesce("artist", F.lit("")) != "", F.concat("artist", F.lit(" - "), "name")).otherwise(F.col("name"))
    seconds = F.bround(F.coalesce("duration", F.lit(0.0)).cast("double"), 0).cast("long").cast("string")
    info = F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), title)
    lines = entries.select(playlist, F.explode(F.array(
        F.struct((F.col(pos) * 2).alias("line_no"), info.alias("line")),
        F.struct((F.col(pos) * 2 + 1).alias("line_no"), F.col("path").alias("line")))).alias("l")).select(playlist, "l.*")
    header = entries.select(playlist).distinct().select(playlist, F.lit(-1).cast("long").alias("line_no"), F.lit("#EXTM3U").alias("line"))
    return header.unionByName(lines)


def write_m3u8(entries: DataFrame, folder: str, playlist: str = "playlist", pos: str = "pos") -> None:
    """A folder per playlist; a long playlist is cut into files of bounded length whose names keep the order."""
    lines = m3u8_lines(entries, playlist, pos).repartitionByRange(playlist, "line_no").sortWithinPartitions(playlist, "line_no")
    lines.select(playlist, "line").write.mode("overwrite").option("maxRecordsPerFile", FILE_LINES).partitionBy(playlist).text(folder)


def parse_m3u8(lines: DataFrame, order: Seq[Column | str], playlist: str = "playlist", line: str = "line") -> DataFrame:
    """(playlist, pos, path) from lines in file order; blanks and comments dropped, file addresses decoded."""
    text = F.trim(line)
    kept = lines.withColumn("_text", text).filter((F.col("_text") != "") & ~F.col("_text").startswith("#"))
    path = F.when(F.col("_text").startswith("file://"), file_uri_path("_text")).otherwise(F.col("_text"))
    return positions(kept.withColumn("path", path), [playlist], order).rows.select(playlist, "pos", "path")


def matching(pattern: str) -> tuple[str, str]:
    """The folder to list and the regular expression of the paths that a pattern (or all files of a folder) means."""
    pattern = plain(pattern)
    if not re.search("[*?]", pattern):
        pattern += "/*"
    root = re.split("[*?]", pattern)[0].rsplit("/", 1)[0]
    parts = {"*": "[^/]*", "?": "[^/]"}
    names = "/".join(("(?!\\.)" if n[:1] in parts else "") + "".join(parts.get(c, re.escape(c)) for c in n) for n in pattern.split("/"))
    return root or "/", f"^{names}$"


def read_m3u8(spark: SparkSession, pattern: str) -> DataFrame:
    """Playlists named by their file stem, files of a folder or of a pattern with ``*`` and ``?``. One file is one playlist, as people keep them."""
    root, paths = matching(pattern)
    lines = read_lines(tree(spark, root).filter(F.col("path").rlike(paths))).filter("reason IS NULL")
    playlist = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), "\\.[^.]+$", "")
    return parse_m3u8(lines.select(playlist.alias("playlist"), "path", "offset", "line").withColumnRenamed("path", "file"), ["file", "offset"])


def read_shelf(spark: SparkSession, folder: str) -> DataFrame:
    """Playlists as ``write_m3u8`` leaves them: one folder each, lines in the order of files and lines."""
    files = tree(spark, folder).filter(F.col("path").rlike("/playlist=[^/]*/part-[^/]*$"))
    lines = read_lines(files).filter("reason IS NULL").withColumnRenamed("path", "file")
    named = F.url_decode(F.replace(F.regexp_extract("file", "/playlist=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    return parse_m3u8(lines.select(F.nullif(named, F.lit("__HIVE_DEFAULT_PARTITION__")).alias("playlist"), "file", "offset", "line"), ["file", "offset"])


def shelf_names(entries: DataFrame, playlist: str = "playlist") -> DataFrame:
    return entries.select(playlist).distinct().orderBy(F.lower(playlist), playlist)


def path_list(paths: DataFrame, header: str, path: str = "path") -> DataFrame:
    """A plain list under a ``#`` header with the count; ``line_no`` gives the order."""
    from ..plans.ordered import indexed
    body = indexed(paths.select(path), [path], "_at").select((F.col("_at") + 3).alias("line_no"), F.col(path).alias("line"))
    if not header:
        return body
    count = paths.agg(F.count("*").alias("n"))
    top = count.select(F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(f"# {header}").alias("line")),
        F.struct(F.lit(1).cast("long").alias("line_no"), F.concat(F.lit("# "), F.col("n").cast("string"), F.lit(" tracks")).alias("line")),
        F.struct(F.lit(2).cast("long").alias("line_no"), F.lit("").alias("line")))).alias("l")).select("l.*")
    return top.unionByName(body)


def ramp_lines(table: DataFrame, level: str = "level") -> DataFrame:
    """From the lowest to the highest level, unmeasured rows last with a question mark."""
    from ..plans.ordered import indexed
    told = F.coalesce(F.col(level).cast("string"), F.lit("?"))
    placed = indexed(table.select(level, "file", "path"), [F.col(level).asc_nulls_last(), F.col("path")], "_at")
    return placed.select((F.col("_at") + 1).alias("line_no"), F.concat(
        F.lit("#EXTINF:-1,"), told, F.lit(" · "), "file").alias("info"), "path")
