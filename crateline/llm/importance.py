"""Target-distribution importance resampling: hashed features scored from an array, the best keys by median of medians.

Documents and targets are bags of hashed word runs. A bucket's gain is the logarithm of its share in the
targets over its share in the documents; a document's weight is the mean gain of its features,
looked up in one array. With a Gumbel variate of the document's id added to each weight, the
highest scores are a sample without replacement. The cutoff key is found by weighted median of
medians: each round takes the median of every group of keys, weighs it by the group's size, and
one count tells on which side of the weighted median the cutoff lies.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_step, code_tokens, columns_of, discard, store, table
from .registry import query

#: Words are what these bytes leave together, A-Z lower-cased.
_TO_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Keys of one group, whose median one task takes; and the remaining keys that are sorted at once.
GROUP, FINISH = 1 << 20, 4096


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def _features(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the runs of 1 to ``longest`` words of all texts in order, runs of each text, words of each text."""
    words = [words_of(t) for t in texts]
    runs = words if longest == 1 else [[b" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)] for w in words]
    tokens, at, sizes = code_tokens(runs)
    return np.fromiter((zlib.crc32(t) % buckets for t in tokens), np.int64, len(tokens))[at], sizes, np.fromiter(map(len, words), np.int64, len(words))


def bucket_counts(texts: DataFrame, longest: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all rows; ``buckets`` numbers reach the driver."""
    def count(step):
        told, _, _ = _features(step.column(0).to_pylist(), longest, buckets)
        n = np.bincount(told, minlength=buckets)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])
    counted = arrow_step(texts.select(F.col(text_col).alias("text")), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets, np.int64)
    for row in counted.collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the source."""
    n = len(source)
    ratio = (target + 1.0) * float(int(source.sum()) + n) / ((source + 1.0) * float(int(target.sum()) + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(1000 g) of the id's Gumbel variate; a missing id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, n_words, weight, score`` of every row."""
    def score(step):
        ids, texts = step.column(0), step.column(1).to_pylist()
        told, sizes, n_words = _features(texts, longest, len(gain))
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(gain[told])])
        weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
        drawn = np.fromiter((gumbel(i, seed) for i in ids.to_pylist()), np.int64, len(texts))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (sizes, n_words, weight, weight + drawn))], ["doc_id", "n_features", "n_words", "weight", "score"])
    rows = columns_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_step(rows, score, "doc_id long, n_features long, n_words long, weight long, score long")


# Selection. A key is (-score, id, features, row): ascending keys are descending scores, and no two keys are equal.


def _keys(df: DataFrame) -> DataFrame:
    return df.select((-F.col("score")).alias("k0"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.col("n_features").alias("k2"), F.col("row").alias("k3"))


def _upto(key: tuple[int, ...], names: tuple[str, ...] = ("k0", "k1", "k2", "k3")) -> Column:
    """The keys up to and including ``key``."""
    held = F.lit(True)
    for name, value in reversed(list(zip(names, key, strict=True))):
        held = (F.col(name) < value) | ((F.col(name) == value) & held)
    return held


def _medians(keys: DataFrame, group: int) -> list[tuple[tuple[int, ...], int]]:
    """The lower median of each group of at most ``group`` keys of a task, and the group's size."""
    def run(batches):
        waiting, size = [], 0

        def made():
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            at = np.lexsort(columns[::-1])[(size - 1) // 2]
            return pa.RecordBatch.from_arrays([*(pa.array([int(c[at])], pa.int64()) for c in columns), pa.array([size], pa.int64())], ["k0", "k1", "k2", "k3", "n"])
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                if size and size + part.num_rows > group:
                    yield made()
                    waiting, size = [], 0
                waiting.append([np.asarray(c) for c in part.columns])
                size += part.num_rows
        if size:
            yield made()
    # One row for a task or ``group`` keys.
    return [(tuple(r)[:4], r["n"]) for r in keys.mapInArrow(run, "k0 long, k1 long, k2 long, k3 long, n long").collect()]


def cutoff(keys: DataFrame, rank: int, group: int = GROUP, finish: int = FINISH) -> tuple[int, ...]:
    """The key of which exactly ``rank`` keys (1 or more, no more than there are) are not greater.

    A round discards a quarter of the remaining keys at least, for half of the groups by weight have
    half of their keys on either side of the weighted median. The remaining ones are written anew
    when they are half of what was written before, so that all rounds together read a few times
    the keys. The last ``finish`` keys are sorted by the driver.
    """
    spark, left, path = keys.sparkSession, keys, None
    written = n = keys.count()
    while n > finish:
        told = sorted(_medians(left, group))
        half, upto = sum(size for _, size in told) / 2, np.cumsum([size for _, size in told])
        pivot = told[int(np.searchsorted(upto, half))][0]
        lower = left.filter(_upto(pivot)).count()
        left, rank, n = (left.filter(_upto(pivot)), rank, lower) if rank <= lower else (left.filter(~_upto(pivot)), rank - lower, n - lower)
        if n * 2 <= written and n > finish:
            left, fresh = store(left, "keys-left")
            if path:
                discard(spark, path)
            path, written = fresh, n
    found = sorted(tuple(r) for r in left.collect())[rank - 1]
    if path:
        discard(spark, path)
    return found


def resample(docs: DataFrame, targets: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10000, min_words: int = 20, seed: int = 2024,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", group: int = GROUP, finish: int = FINISH) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``min_words`` words, likelier where they resemble the targets.

    Returns for every row ``doc_id, n_features, weight, score, rank``; rank is 1, 2, 3... from the
    highest score and null where a row is not drawn. Equal scores go by ascending id. Rules for odd
    input: null and empty texts have no features and weight 0, and are never drawn unless
    ``min_words`` is 0; a null id counts as empty text in the hash and comes before all others; each row that
    repeats an id is a document of its own, and of equal scores the one of fewer features comes first; with no targets all
    buckets have none; an empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(targets, longest, buckets, target_text))
    rows, _ = store(scored(docs, gain, longest, seed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = rows.filter(F.col("n_words") >= min_words)
    wanted = percent * able.count() // 100
    out = ("doc_id", "n_features", "weight", "score")
    if not wanted:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    key = cutoff(_keys(able), wanted, group, finish)
    names = ("_k0", "_k1", "_k2", "_k3")
    keyed = rows.withColumns(dict(zip(names, (-F.col("score"), F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("n_features"), F.col("row")), strict=True)))
    drawn = (F.col("n_words") >= min_words) & _upto(key, names)
    ranked = _ranked(keyed.filter(drawn), names)
    return ranked.select(*out, "rank").unionByName(keyed.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def _ranked(winners: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Sort by ranges and number the rows: a range's rows follow those of the ranges before it."""
    placed, _ = store(winners.orderBy(*order).withColumn("_part", F.spark_partition_id()), "winners")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))  # a row for each range
    inside = Window.partitionBy("_part").orderBy(*order)
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.row_number().over(inside))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
 dw AS (SELECT doc_id, unnest(w) AS w FROM d),
 rounds AS (SELECT list(r) AS r8 FROM range(8) t(r)),
 crc AS (SELECT list(list_reduce(list_prepend(i, r8), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i), rounds),
 named AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM b)),
 hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM named, crc),
 s AS (SELECT k, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN hashed USING (w) GROUP BY k),
 total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
 gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g FROM (SELECT DISTINCT k FROM hashed) LEFT JOIN s USING (k) LEFT JOIN t USING (k), total),
 sums AS (SELECT doc_id, sum(g)::BIGINT AS g, count(*) AS n FROM dw JOIN hashed USING (w) JOIN gain USING (k) GROUP BY doc_id),
 weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (doc_id)),
 scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * able // 100 THEN r END AS rank FROM ranked"""


@query("op12_importance", SQL)
def op12_importance(spark, folder):
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
