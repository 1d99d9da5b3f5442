"""Duplicate files at three levels, near duplicates, and plans to set them aside.

Groups are never collected: members stay rows, the file to keep is a minimum, and pair
views compare every member with the kept one.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import human_size
from ..functions.text import base_name, is_composed, normalized_name, parent, stem, suffix, under
from ..plans.cells import first_twins
from ..plans.ordered import positions

SAME_FOLDER = "DUPLICATE_SAME_FOLDER"
OTHER_FOLDER = "DUPLICATE_OTHER_FOLDER"
SIMILAR_NAME = "SIMILAR_NAME"
QUARANTINE = "_DUPLICATES_TO_DELETE"
# Fixed patterns: names made by copying, names read in the wrong encoding.
COPY_MARKS = r"(?i)(\(\d+\)$|\bcopy\b|\bcopia\b|\bconflicted\b)"
MOJIBAKE = "[ÃÂ]\\S|�"


def name_quality(path: str = "path") -> Column:
    """Order of files worth keeping: the smallest is the cleanest name."""
    name = base_name(path)
    return F.struct(
        F.rlike(stem(path), F.lit(COPY_MARKS)).cast("int").alias("copied"),
        F.rlike(name, F.lit(MOJIBAKE)).cast("int").alias("garbled"),
        (~is_composed(name)).cast("int").alias("decomposed"),
        F.regexp_count(name, F.lit("_")).alias("underscores"),
        F.size(F.filter(F.split(F.col(path), "/"), lambda p: p != "")).alias("depth"),
        F.col(path).alias("path"))


def hash_candidates(files: DataFrame) -> DataFrame:
    """Only files whose size occurs more than once can be copies of another."""
    repeated = files.groupBy("size").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("size")
    return files.join(repeated, "size", "left_semi")


def with_hash(files: DataFrame, digest: Column) -> DataFrame:
    """Hash the repeated sizes; ``digest`` is any hash expression over the content."""
    return hash_candidates(files).withColumn("md5", digest)


def identical(hashed: DataFrame) -> DataFrame:
    """Members of sets of the same size and hash, two or more of them."""
    sets = hashed.filter(F.col("md5").isNotNull()).groupBy("size", "md5").agg(
        F.count("*").alias("copies"), F.min("path").alias("probe"))
    return hashed.join(sets.filter(F.col("copies") > 1), ["size", "md5"])


def broken(same: DataFrame, probes: DataFrame) -> DataFrame:
    """Identical but unreadable sets: (path, reason) probes of one member each decide."""
    bad = probes.filter(F.col("reason").isNotNull()).select(F.col("path").alias("probe"), "reason")
    return same.join(bad, "probe")


def sound(same: DataFrame, probes: DataFrame) -> DataFrame:
    bad = probes.filter(F.col("reason").isNotNull()).select(F.col("path").alias("probe"))
    return same.join(bad, "probe", "left_anti")


def _groups(rows: DataFrame, by: Seq[str], level: str) -> DataFrame:
    """Each member with the kept path of its group; the kept one itself is marked."""
    best = rows.groupBy(*by).agg(F.min("_quality").alias("_keep"), F.count("*").alias("copies"))
    joined = rows.drop("copies").join(best.filter(F.col("copies") > 1), list(by))
    return joined.withColumn("keep", F.col("_keep.path")).withColumn("is_keep", F.col("path") == F.col("keep")).withColumn(
        "level", F.lit(level)).drop("_keep")


def _judged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("folder", parent("path")).withColumn("_quality", name_quality())


def same_folder(same: DataFrame) -> DataFrame:
    return _groups(_judged(same), ["size", "md5", "folder"], SAME_FOLDER).drop("_quality")


def other_folder(same: DataFrame) -> DataFrame:
    """One representative per folder, then the best of them across folders."""
    judged = _judged(same)
    chosen = judged.groupBy("size", "md5", "folder").agg(F.min("_quality").alias("_quality")).withColumn(
        "path", F.col("_quality.path"))
    return _groups(chosen, ["size", "md5"], OTHER_FOLDER).drop("_quality")


def similar_name(files: DataFrame, hashed: DataFrame) -> DataFrame:
    """Same reduced name, unless all of the group are byte copies of one another."""
    rows = files.join(hashed.select("path", "md5"), "path", "left").withColumn("name_key", normalized_name("path"))
    rows = rows.filter(F.col("name_key") != "")
    kinds = rows.groupBy("name_key").agg(
        F.count("*").alias("_n"), F.min("size").alias("_s0"), F.max("size").alias("_s1"), F.min("md5").alias("_m0"),
        F.max("md5").alias("_m1"), F.count("md5").alias("_hashed"))
    copies = (F.col("_s0") == F.col("_s1")) & (F.col("_m0") == F.col("_m1")) & (F.col("_hashed") == F.col("_n"))
    kept = kinds.filter((F.col("_n") > 1) & ~F.coalesce(copies, F.lit(False))).select(
        "name_key", F.col("_s1").alias("group_size"))
    return _groups(_judged(rows.join(kept, "name_key")), ["name_key"], SIMILAR_NAME).drop("_quality")


def all_groups(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """The three levels in one table; the third shows its group's largest size and no hash."""
    third = c.withColumn("size", F.col("group_size")).withColumn("md5", F.lit(None).cast("string"))
    columns = ["level", "size", "md5", "keep", "path", "is_keep", "copies"]
    return a.select(columns).unionByName(b.select(columns)).unionByName(third.select(columns))


def extra_copies(groups: DataFrame) -> DataFrame:
    return groups.filter(~F.col("is_keep"))


def wasted_bytes(groups: DataFrame) -> DataFrame:
    """Bytes freed by keeping one file per group."""
    return groups.groupBy("level", "keep").agg(
        (F.max("size") * (F.max("copies") - 1)).alias("wasted_bytes"))


def report_rows(groups: DataFrame) -> DataFrame:
    """One line per extra copy; only copies inside one folder may be deleted."""
    action = F.when(F.col("level") == SAME_FOLDER, F.lit("DELETE")).otherwise(F.lit("REVIEW"))
    return extra_copies(groups).select(
        action.alias("action"), "level", parent("keep").alias("folder"), "keep", F.col("path").alias("delete"),
        F.col("size").alias("size_bytes"), human_size("size").alias("size"), F.coalesce("md5", F.lit("")).alias("md5"), "copies")


def against_kept(similar: DataFrame) -> DataFrame:
    """Every similar-name file beside the kept one, with equality flags."""
    kept = similar.filter("is_keep").select(
        "name_key", F.col("path").alias("file_a"), F.col("size").alias("size_a"), F.col("md5").alias("md5_a"))
    others = similar.filter(~F.col("is_keep")).select(
        "name_key", F.col("path").alias("file_b"), F.col("size").alias("size_b"), F.col("md5").alias("md5_b"))
    same_size = F.col("size_a") == F.col("size_b")
    return others.join(kept, "name_key").withColumns({
        "same_size": same_size, "same_name": base_name("file_a") == base_name("file_b"),
        "same_hash": F.coalesce(same_size & (F.col("md5_a") == F.col("md5_b")), F.lit(False))})


def pair_counts(similar: DataFrame) -> DataFrame:
    """How many of a group's pairs agree in size, name and content, counted without forming the pairs."""
    rows = similar.withColumn("_name", base_name("path"))
    pairs = lambda n: n * (n - 1) / 2
    out = rows.groupBy("name_key").agg(pairs(F.count("*")).cast("long").alias("pairs"))
    for label, keys in (("same_size", ["size"]), ("same_name", ["_name"]), ("same_hash", ["size", "md5"])):
        known = rows.filter(F.col("md5").isNotNull()) if label == "same_hash" else rows
        counted = known.groupBy("name_key", *keys).agg(pairs(F.count("*")).alias("_p"))
        total = counted.groupBy("name_key").agg(F.sum("_p").cast("long").alias(label))
        out = out.join(total, "name_key", "left")
    return out.na.fill(0, ["same_size", "same_name", "same_hash"])


def matching_copies(similar: DataFrame) -> DataFrame:
    """Files with an equal size and an equal name earlier in the keeping order of their group."""
    rows = similar.withColumn("_name", base_name("path")).withColumn("_quality", name_quality())
    keys = ["name_key", "size", "_name"]
    firsts = rows.groupBy(*keys).agg(F.min("_quality").alias("_first"))
    return rows.join(firsts, keys).filter(F.col("_quality") != F.col("_first")).select("name_key", "path", "size")


def files_and_bytes(pairs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Distinct files on both sides of pair rows, each with its own size."""
    both = pairs.select(F.col("file_a").alias("path"), F.col("size_a").alias("size")).unionByName(
        pairs.select(F.col("file_b").alias("path"), F.col("size_b").alias("size")))
    if only is not None:
        both = both.join(only.select("path").distinct(), "path", "left_semi")
    each = both.groupBy("path").agg(F.min("size").alias("size"))
    return each.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def quarantine_plan(chosen: DataFrame, root: str, existing: DataFrame | None = None, dirname: str = QUARANTINE,
                    order: str = "ord") -> DataFrame:
    """Where each chosen file goes: the folder tree mirrored, equal targets told apart by ``__n``.

    ``chosen`` is (path, ord). Every wanted target takes the lowest free suffixes in order of
    arrival; names that exist on disk, or that another file wants as it stands, are not free.
    """
    root = root.rstrip("/")
    home = f"{root}/{dirname}"
    first = chosen.filter(~under("path", home)).groupBy("path").agg(F.min(order).alias(order))
    folder = parent("path")
    inside = F.when(folder == root, F.lit("")).when(under(folder, root), F.concat(F.lit("/"), F.substring(folder, len(root) + 2, 1 << 30))).otherwise(
        F.concat(F.lit("/"), base_name(folder)))
    wanted = first.withColumn("_base", F.concat(F.lit(home), inside, F.lit("/"))).withColumn("_stem", stem("path")).withColumn(
        "_suffix", suffix("path")).withColumn("_target", F.concat("_base", "_stem", "_suffix"))
    numbered = positions(wanted, ["_target"], [order, "path"], "_nth").rows
    spelled = lambda n: F.when(n == 0, F.col("_target")).otherwise(F.concat("_base", "_stem", F.lit("__"), n.cast("string"), "_suffix"))
    taken = wanted.select(F.col("_target").alias("_name"))
    if existing is not None:
        taken = taken.unionByName(existing.select(F.col("path").alias("_name")))
    blocked = taken.distinct().withColumn("_key", F.regexp_replace("_name", "__[0-9]+(\\.[^./]+)?$", "$1")).withColumn(
        "_number", F.regexp_extract("_name", "__([0-9]+)(?:\\.[^./]+)?$", 1).try_cast("long"))
    numbers = blocked.filter(F.col("_number").isNotNull()).select(F.col("_key").alias("_target"), "_number")
    if existing is not None:
        there = existing.select(F.col("path").alias("_target"), F.lit(0).cast("long").alias("_number"))
        numbers = numbers.unionByName(there)
    # The n-th free number is n plus the holes in front of it: hole i of a target, counted from 0,
    # has (its number - i) free numbers before it.
    holes = positions(numbers.distinct(), ["_target"], ["_number"], "_i").rows.select(
        "_target", (F.col("_number") - F.col("_i")).alias("_at"), F.lit(1).alias("_hole"), F.lit(None).cast("string").alias("path"))
    asked = numbered.select("_target", F.col("_nth").alias("_at"), F.lit(0).alias("_hole"), "path")
    both = positions(asked.unionByName(holes), ["_target"], ["_at", F.desc("_hole"), "path"], "_o").running_sum("_hole", "_skip")
    given = both.rows.filter(F.col("_hole") == 0).select("_target", "path", (F.col("_at") + F.col("_skip")).alias("_number"))
    placed = numbered.join(given, ["_target", "path"])
    return placed.select("path", spelled(F.col("_number")).alias("target"), order)


def plan_outcome(plan: DataFrame, files: DataFrame) -> DataFrame:
    """What a dry run would move, and what is no longer there."""
    there = files.select("path").distinct().withColumn("_there", F.lit(1))
    return plan.join(there, "path", "left").agg(
        F.count("_there").alias("moved"), (F.count("*") - F.count("_there")).alias("missing"))


def losers(entries: DataFrame, least: float, song: str = "song", playlist: str = "playlist", pos: str = "pos") -> DataFrame:
    """Later rows of the same song, and later rows that sound like an earlier one."""
    firsts = entries.groupBy(playlist, song).agg(F.min(pos).alias("_first"))
    named = entries.join(firsts, [playlist, song]).filter(F.col(pos) > F.col("_first")).select(
        F.col(playlist).cast("long").alias(playlist), F.col(pos).cast("long").alias(pos))
    twins = first_twins(entries, least, by=playlist, order=pos, ignore=song).select(
        F.col("grp").alias(playlist), F.col("at").alias(pos))
    return named.unionByName(twins).distinct()


def sidecars(files: DataFrame, head: str = "head") -> DataFrame:
    """Files named like a side-car, and whether their first bytes agree."""
    named = files.filter(base_name("path").startswith("._"))
    return named.withColumn("confirmed", F.coalesce(F.hex(F.substring(head, 1, 4)) == "00051607", F.lit(False)))


def sidecar_summary(files: DataFrame, head: str = "head") -> DataFrame:
    found = sidecars(files, head)
    walked = files.agg(F.count("*")).scalar()
    return found.agg(F.count_if("confirmed").alias("confirmed"), F.count_if(~F.col("confirmed")).alias("unverified"),
                     F.coalesce(F.sum(F.when(F.col("confirmed"), F.col("size"))), F.lit(0)).alias("bytes")).withColumn("walked", walked)


def integrity(asked: DataFrame, files: DataFrame, probes: DataFrame) -> DataFrame:
    """Outcome of every asked path: missing, a reason, or fine. An empty file is bad."""
    joined = asked.select("path").join(files.select("path", "size").withColumn("_there", F.lit(1)), "path", "left").join(
        probes.select("path", "reason"), "path", "left")
    outcome = (F.when(F.col("_there").isNull(), F.lit("missing")).when(F.col("size") == 0, F.lit("empty file"))
               .otherwise(F.coalesce("reason", F.lit("ok"))))
    return joined.select("path", "size", outcome.alias("outcome"))


def integrity_summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("outcome").agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def counts_by(files: DataFrame, *keys: tuple[str, Column]) -> DataFrame:
    """Counts and sizes by each key and in total, in one pass; ``kind`` says which key a line is about."""
    named = files.withColumns({name: value for name, value in keys})
    names = [name for name, _ in keys]
    grouped = named.groupingSets([[F.col(n)] for n in names] + [[]], *names).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), *[F.grouping(n).alias(f"_g_{n}") for n in names])
    kind, value = F.lit("total"), F.lit(None).cast("string")
    for name in names:
        kind = F.when(F.col(f"_g_{name}") == 0, F.lit(name)).otherwise(kind)
        value = F.when(F.col(f"_g_{name}") == 0, F.col(name)).otherwise(value)
    return grouped.select(kind.alias("kind"), value.alias("value"), "files", "bytes")


def longest(durations: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Longest known duration in minutes; unknown ones are counted apart."""
    known = F.when(F.col(seconds) > 0, F.col(seconds))
    return durations.agg(F.coalesce(F.max(known) / 60, F.lit(0.0)).alias("longest_minutes"),
                         F.count_if(known.isNull()).alias("unknown"))


def largest_of_extension(files: DataFrame, extension: Column, wanted: str) -> DataFrame:
    modified = F.when(F.col("mtime") > 0, F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd")).otherwise(F.lit("—"))
    return files.filter(extension == wanted).orderBy(F.desc("size"), "path").select(
        base_name("path").alias("file"), parent("path").alias("folder"), human_size("size").alias("size"),
        modified.alias("modified"), "path", F.col("size").alias("bytes"))
