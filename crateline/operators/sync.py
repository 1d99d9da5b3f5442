"""Keeping a catalogue in step with the files: what is new, gone, moved or done."""

from __future__ import annotations

from collections.abc import Callable, Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parent, under


def latest(df: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """Last write per key, by a map-side maximum rather than a window per key."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def pending(manifest: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Files never analysed, or whose time or size changed since."""
    known = catalogue.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.lit(True).alias("_known"))
    changed = ~(F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size")))
    return manifest.join(known, "path", "left").filter(F.col("_known").isNull() | changed).select(*manifest.columns)


def vanished(catalogue: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Rows under the root whose file is no longer there; other roots are not looked at."""
    return catalogue.filter(under("path", root)).join(manifest.select("path"), "path", "left_anti")


def removed(catalogue: DataFrame, doomed: DataFrame) -> DataFrame:
    return catalogue.join(doomed.select("path").distinct(), "path", "left_anti")


def pruned(catalogue: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Catalogue without the vanished rows; refused when nothing at all is found under the root."""
    if manifest.filter(under("path", root)).isEmpty():
        raise ValueError(f"nothing is reachable under {root}: every row would look vanished")
    return removed(catalogue, vanished(catalogue, manifest, root))


def relocated(catalogue: DataFrame, manifest: DataFrame, old: str, new: str) -> DataFrame:
    """Paths under ``old`` moved to ``new``; the new time is taken only when the size agrees.

    ``moved`` and ``not_found`` tell what happened to a row.
    """
    old, new = old.rstrip("/"), new.rstrip("/")
    moved = under("path", old)
    path = F.when(moved, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path"))
    there = manifest.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_there"))
    rows = catalogue.withColumn("moved", moved).withColumn("path", path).join(there, "path", "left")
    same = F.col("moved") & F.col("_there") & (F.col("size") == F.col("_size"))
    out = rows.withColumn("mtime", F.when(same, F.col("_mtime")).otherwise(F.col("mtime"))).withColumn(
        "not_found", F.col("moved") & F.col("_there").isNull())
    if "folder" in catalogue.columns:
        out = out.withColumn("folder", F.when(F.col("moved"), parent("path")).otherwise(F.col("folder")))
    return out.drop("_size", "_mtime", "_there")


def relocation_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("moved").alias("moved"), F.count_if("not_found").alias("not_found"))


def work_queue(candidates: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def already_done(candidates: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    return candidates.join(done.select(key), key, "left_semi")


def log_summary(log: DataFrame, entry: str = "path") -> DataFrame:
    """Distinct entries of a processed log and how many lines repeat one."""
    text = F.trim(entry)
    counted = log.filter(text != "").groupBy(text.alias("e")).agg(F.count("*").alias("n"))
    return counted.agg(F.count("*").alias("done"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_lines"))


def marked(log: DataFrame, entries: DataFrame, entry: str = "path") -> DataFrame:
    """Entries to append so that marking twice changes nothing."""
    return entries.select(entry).distinct().join(log.select(entry).distinct(), entry, "left_anti")


def cached(manifest: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Stored data of every file whose time, size and schema version still agree, NULL elsewhere."""
    kept = cache.filter(F.col("version") == version).select(
        "path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), "data")
    fresh = F.col("mtime").eqNullSafe(F.col("_mtime")) & F.col("size").eqNullSafe(F.col("_size"))
    return manifest.join(kept, "path", "left").withColumn("data", F.when(fresh, F.col("data"))).drop("_mtime", "_size")


def appendable(profiles: DataFrame) -> DataFrame:
    """Analysed rows worth storing: no error and a vector."""
    return profiles.filter(F.col("error").isNull() & F.col("embedding").isNotNull())


def with_fields(rows: DataFrame, added: DataFrame, key: str = "path") -> DataFrame:
    """Rows with the added fields; refused when the added table repeats a key, as rows would multiply."""
    repeated = added.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    if not repeated.isEmpty():
        raise ValueError("the added fields carry a key twice")
    fresh = [c for c in added.columns if c != key]
    old = [c for c in rows.columns if c not in fresh]
    return rows.select(*old).join(added, key, "left")


def backfilled(rows: DataFrame, missing: Column, compute: Callable[[DataFrame], DataFrame], fields: Seq[str], key: str = "path") -> DataFrame:
    """Compute fields for the rows that lack them and leave the others as they are."""
    fresh = compute(rows.filter(missing)).select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_fresh"))
    joined = rows.join(fresh, key, "left")
    picked = {f: F.when(F.col("_fresh"), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(picked).select(*rows.columns)


def first_errors(results: DataFrame, order: str = "seq", keep: int = 100) -> DataFrame:
    """The first errors as a list to read; all of them stay counted elsewhere."""
    return results.filter(F.col("error").isNotNull()).orderBy(order).limit(keep)


def job_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("done"), F.count("error").alias("failed"))


def attempted(df: DataFrame, work: Callable, outputs: str, columns: Seq[str] | None = None) -> DataFrame:
    """Run ``work(row dict) -> dict`` over the rows; a failing row carries its error instead of stopping the job."""
    import pandas as pd
    columns = list(columns or df.columns)
    names = [part.strip().split()[0] for part in outputs.split(",")]
    keep = df.select(*columns)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep.schema)

    def run(batches):
        for frame in batches:
            found = []
            for record in frame.to_dict("records"):
                try:
                    done = work(record)
                    found.append({**{n: done.get(n) for n in names}, "error": None})
                except Exception as error:  # noqa: BLE001 - carried as data
                    found.append({**{n: None for n in names}, "error": f"{type(error).__name__}: {error}"})
            extra = pd.DataFrame(found, columns=[*names, "error"], index=frame.index)
            yield pd.concat([frame, extra], axis=1)

    return keep.mapInPandas(run, f"{fields}, {outputs}, error string")
