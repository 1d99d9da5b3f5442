"""WARC: archives that hold each payload once, with revisit records for the others.

Only headers are shuffled by payload digest; the first page of a digest is its response and the
others point to it. Records get fresh headers and are written by Spark's text writer, which works
on any file system and commits whole files only.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table
from .registry import query

_END = "\r\n\r\n"
_PAGE = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, payload binary"


def resolve(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Headers of all pages: ``page_id, url, payload_digest, payload_bytes, record_type, refers_to``.

    Of pages with equal payloads of at least ``min_bytes``, the one with the smallest id is the
    response and the others revisit it; smaller payloads are all responses. Null html is an empty
    payload. A null id is larger than all others. Pages that repeat the smallest id with the same
    payload are all responses. Input: ``page_id, url, html``.
    """
    body = F.coalesce("html", F.lit(""))
    heads = pages.select("page_id", "url", F.sha2(body, 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    # One row per digest leaves each task; headers of a crowded digest meet it in a join that Spark may split.
    first = heads.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = heads.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one WARC/1.1 record per page to gzip files under ``path``."""
    heads = resolve(pages, min_bytes).select(
        F.struct("page_id", "url").alias("key"), "payload_digest", "payload_bytes", "record_type", "refers_to").distinct()
    bodies = pages.select(F.struct("page_id", "url").alias("of"), F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "payload_digest", F.sha2("html", 256))
    rows = bodies.join(heads, F.col("of").eqNullSafe(F.col("key")) & (bodies["payload_digest"] == heads["payload_digest"])).drop(heads["payload_digest"])
    revisit = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.regexp_replace(F.coalesce("of.url", F.lit("")), "[\\r\\n]", "")
    block = F.when(revisit, "").otherwise(F.col("html"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("of.page_id"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("of.url").isNotNull(), line("WARC-Target-URI", target)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    # Files stay small enough for one task to read each whole.
    rows.select(record.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 2000).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``; a response whose payload does not fit its digest stops the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(_records(zlib.decompressobj(31), content.as_buffer()))

    return files.mapInArrow(parse, _PAGE)


def _records(inflate, content):
    """One record after the other, with no more than one record and one piece of the file in memory."""
    held, at, view, step = b"", 0, memoryview(content), 1 << 20

    def more():
        nonlocal held, at
        if at >= len(view):
            return False
        held += inflate.decompress(view[at:at + step])
        at += step
        return True

    while True:
        while b"\r\n\r\n" not in held and more():
            pass
        if not held:
            return
        head, _, held = held.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        parts, have = [held], len(held)
        while have < size + 4 and at < len(view):
            parts.append(inflate.decompress(view[at:at + step]))
            have, at = have + len(parts[-1]), at + step
        held = b"".join(parts)
        payload, held = held[:size], held[size + 4:]
        number = lambda name: int(x) if (x := fields.get(name, b"").removeprefix(b"<urn:page:").removesuffix(b">")) else None  # noqa: B023, E731
        digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
        kind = fields[b"WARC-Type"].decode()
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of record {fields[b'WARC-Record-ID']!r} does not fit its digest")
        url = fields.get(b"WARC-Target-URI")
        yield (number(b"WARC-Record-ID"), kind, number(b"WARC-Refers-To"), digest, int(fields[b"WARC-Payload-Length"]), url and url.decode(),
               payload if kind == "response" else None)


def _batches(records, most: int = 4 << 20):
    names = [x.split()[0] for x in _PAGE.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    rows, size = [], 0
    for row in records:
        rows.append(row)
        size += 200 + len(row[6] or b"")
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


SQL = """WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f"""


@query("op8_warc_revisits", SQL)
def op8_warc_revisits(spark, folder):
    path = new_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
