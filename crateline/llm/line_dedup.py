"""Line dedup: lines that many documents share are dropped everywhere but in one document.

Lines are exploded, normalised and hashed, each once; documents are counted per hash; lines over the
threshold are dropped and the others joined again by position.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_step, columns_of, table
from .registry import query

#: What ``bytes.strip`` takes off.
_BLANKS = " \t\n\x0b\f\r"


def line_key(line: str) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased."""
    return line.encode().strip().lower()


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the lines that at least ``min_docs`` documents share.

    A key of at least ``min_chars`` code points found in ``min_docs`` distinct ids keeps its lines
    only in the largest id holding it. Returns ``doc_id, n_lines, n_dropped, kept_text``, one row
    for each input row. Rules for odd input: a null or empty text is one empty line; rows that
    repeat an id are one document when counting and each keep or lose the same lines; rows with a
    null id are one document of their own, smaller than all others; an empty table gives no rows.
    """
    rows = columns_of(docs, id_col, text_col)
    # 16 bytes stand for a line; counted once per document, then per line: both steps combine before they shuffle.
    held = arrow_step(rows, lambda step: _hashes(step, min_chars), "doc_id long, hash binary").distinct()
    shared = held.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("home")).filter(F.col("n") >= min_docs)
    lost = held.join(shared.select("hash", "home"), "hash").filter(~F.col("doc_id").eqNullSafe(F.col("home")))
    drops = lost.groupBy("doc_id").agg(F.collect_list("hash").alias("drops")).withColumnRenamed("doc_id", "of")
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "drops")
    return arrow_step(joined, lambda step: _rebuild(step, min_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")


def _hashes(step: pa.RecordBatch, min_chars: int) -> pa.RecordBatch:
    """``doc_id, hash`` of the different long keys of each row; whole texts come, as built-in functions took over twice the time for their lines."""
    ids, texts = step.columns
    of, hashes = [], []
    for row, text in enumerate(texts.to_pylist()):
        long = (line for line in (text or "").split("\n") if len(line) >= min_chars and len(line.strip(_BLANKS)) >= min_chars)
        own = {hashlib.md5(line_key(line)).digest() for line in long}
        of += [row] * len(own)
        hashes += own
    return pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), pa.array(hashes, pa.binary())], ["doc_id", "hash"])


def _rebuild(step: pa.RecordBatch, min_chars: int) -> pa.RecordBatch:
    ids, texts, drops = step.columns
    n_lines, n_dropped, kept = [], [], []
    for text, lost in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
        lines = (text or "").split("\n")
        n_lines.append(len(lines))
        if lost:
            lost = set(lost)
            lines = [x for x in lines if len(x) < min_chars or hashlib.md5(line_key(x)).digest() not in lost]
        n_dropped.append(n_lines[-1] - len(lines))
        kept.append("\n".join(lines) if lost else text or "")
    return pa.RecordBatch.from_arrays([ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                                      ["doc_id", "n_lines", "n_dropped", "kept_text"])


SQL = """WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
 keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
 shared AS (SELECT k, max(doc_id) AS home FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
 told AS (SELECT q.doc_id, q.pos, q.line, s.k IS NOT NULL AND q.doc_id <> s.home AS lost FROM keyed q LEFT JOIN shared s ON q.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM told GROUP BY doc_id"""


@query("op1_line_dedup", SQL)
def op1_line_dedup(spark, folder):
    return line_dedup(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
