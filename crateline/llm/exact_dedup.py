"""Exact dedup: a tree-merge of sorted digest runs.

Every input partition makes one sorted run of (digest, smallest id, number of rows). Runs are
then exchanged in rounds, as in a recursive-halving reduction: partition numbers are written as
digits, and in round r the rows of a run go to the partners that differ from it in digit r only,
each partner taking the digests whose own digit r is its own. Every round a partition merges the
runs it got from its ``fan`` partners and keeps one row per digest, so a text held by a third of
all rows is at most ``fan`` rows for any merge. After the last round a partition holds one range
of digests, merged over the whole input.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, store, table
from .registry import query

_RUN = "slot int, digest binary, check long, n_bytes long, keep_id long, n_rows long"
_KEYS = ["digest", "check", "n_bytes"]
_NULLS_LAST = 2**63 - 1


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _merged(batches):
    """Sorted rows to one row per slot and key: smallest id, rows added up; equal keys may span batches."""
    keys, left = ["slot", *_KEYS], None
    for batch in batches:
        part = pa.Table.from_arrays(batch.columns, names=batch.schema.names)  # all columns nullable, as after merging
        part = pa.concat_tables([left, part]) if left is not None else part
        part = part.group_by(keys, use_threads=False).aggregate([("keep_id", "min"), ("n_rows", "sum")]).rename_columns([*keys, "keep_id", "n_rows"])
        # The last key may go on in the next batch.
        left = part.slice(part.num_rows - 1)
        yield from part.slice(0, part.num_rows - 1).to_batches()
    if left is not None:
        yield from left.to_batches()


def tree_merge(runs: DataFrame, fan: int = 8, rounds: int = 2) -> DataFrame:
    """Merge (digest, check, n_bytes, keep_id, n_rows) rows to one row per (digest, check, n_bytes).

    ``fan ** rounds`` partitions take part. The digest is verified by a second hash and by the
    length: rows that agree in the digest alone stay apart.
    """
    parts = fan**rounds
    own = F.pmod(F.spark_partition_id(), F.lit(parts)).cast("int")
    level = runs.select(own.alias("slot"), *_KEYS, "keep_id", "n_rows").sortWithinPartitions("slot", *_KEYS).mapInArrow(_merged, _RUN)
    bits = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(parts))
    for step in range(rounds):
        size = fan**step
        mine, its = F.floor(F.col("slot") / size) % fan, F.floor(bits / size) % fan
        level = level.withColumn("slot", (F.col("slot") + (its - mine) * size).cast("int")).repartitionById(parts, F.col("slot"))
        level = level.sortWithinPartitions("slot", *_KEYS).mapInArrow(_merged, _RUN)
    return level.drop("slot")


def exact_dedup(docs: DataFrame, fan: int = 8, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's place among the rows of equal normalised text.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row. The row with
    the smallest id stays. Rules for odd input: null text is empty text; a null id is larger than
    all others; of rows that repeat the smallest id with the same text one stays, and which one
    does not show in these columns; an empty table gives no rows.
    """
    text = normalised(F.col("text"))
    rows = columns_of(docs, id_col, text_col).select(
        "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows, _ = store(rows, "digests")
    runs = rows.select(*_KEYS, F.coalesce("doc_id", F.lit(_NULLS_LAST)).alias("keep_id"), F.lit(1).cast("long").alias("n_rows"))
    groups = tree_merge(runs, fan, rounds).filter("n_rows > 1").withColumnRenamed("n_rows", "group_size")
    joined = rows.join(groups, _KEYS, "left").withColumns({
        "keep_id": F.coalesce(F.nullif("keep_id", F.lit(_NULLS_LAST)), "doc_id"), "group_size": F.coalesce("group_size", F.lit(1))})
    # Only rows that carry the kept id can be repeats of it: a narrow window over those alone.
    first = joined.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    order = Window.partitionBy("doc_id", *_KEYS).orderBy("check")
    marked = first.withColumn("kept", F.row_number().over(order) == 1)
    others = joined.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    return marked.unionByName(others).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)"""


@query("op4_exact_dedup", SQL)
def op4_exact_dedup(spark, folder):
    return exact_dedup(table(spark, folder, "documents"))
