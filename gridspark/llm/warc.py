"""WARC archives with revisit records in place of repeated payloads.

Originals are found from headers alone (digest and key). Payloads move at most once, in the join that
marks the revisits, and not at all where Spark finds the marks small enough to send to every task. Archives are written by Spark's own text writer, whose separator is the end of a WARC
record, so a lost executor's files are replaced by the commit protocol and any file system Spark
knows will do.

Nulls and odd rows: a null payload is empty; a null key or address leaves out its header line; rows
of one key and one payload are one record written several times, all of one type; an empty table
gives empty archives. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import table
from gridspark.session import materialize, scratch_dir

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 4096
# Fixed values of the WARC/1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, length and the page that holds each payload.

    ``original`` is the smallest page_id with the same payload; it is null for payloads below
    ``min_bytes``, which are always stored. Originals of repeated payloads are found from headers
    alone, first combined on the map side, and joined back by digest.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("digest"),
    )
    heads = rows.where(F.col("payload_bytes") >= min_bytes)
    repeated = (
        heads.groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND original IS NOT NULL")
        .drop("n")
    )
    keyed = materialize(
        heads.select("page_id", "digest").join(materialize(repeated, "warc-digests"), "digest")
        .where("page_id <> original").distinct(),
        "warc-revisits",
    )
    revisits = keyed.select("page_id", F.col("digest").alias("_d"), "original")
    joined = rows.join(
        revisits,
        (rows["page_id"] == revisits["page_id"]) & (rows["digest"] == revisits["_d"]),
        "left",
    )
    return joined.select(rows["page_id"], "url", "payload", "payload_bytes", "digest", "original")


def _line(name: str, value) -> F.Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def record_id(page_id) -> F.Column:
    """A stable urn:uuid of a page."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One complete WARC record per row, without the end mark."""
    page, original = F.col("page_id"), F.col("original")
    revisit = original.isNotNull()
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "_")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\n"),
        _line("WARC-Record-ID", record_id(page)),
        _line("WARC-Target-URI", url),
        F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")).otherwise(F.lit("")),
        F.when(revisit, _line("WARC-Refers-To", record_id(original))).otherwise(F.lit("")),
        _line("Source-Page", page.cast("string")),
        _line("Source-Refers-To", original.cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``pages`` as gzip WARC files with each repeated payload stored once."""
    rows = records(with_originals(pages, min_bytes))
    writer = rows.write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).mode("errorifexists").text(path)


RECORD_SCHEMA = (
    "page_id long, record_type string, refers_to long, record_id string, refers_to_id string, "
    "uri string, digest string, payload_bytes long, payload binary"
)
_FIELDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("record_id", pa.string()),
        ("refers_to_id", pa.string()),
        ("uri", pa.string()),
        ("digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, found by their lengths (payloads may hold anything)."""
    if data[:2] == b"\x1f\x8b":
        plain = b""
        parts = []
        while data[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            parts.append(d.decompress(data))
            data = d.unused_data
        data = plain.join(parts)
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:head_end].decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            head[name.lower()] = value
        begin = head_end + 4
        end = begin + int(head["content-length"])
        http_end = data.index(b"\r\n\r\n", begin, end) + 4
        length = re.search(rb"(?i)\r\ncontent-length: (\d+)", data[begin:http_end])
        page, refers = head.get("source-page"), head.get("source-refers-to")
        yield {
            "page_id": None if page is None else int(page),
            "record_type": head["warc-type"],
            "refers_to": None if refers is None else int(refers),
            "record_id": head.get("warc-record-id"),
            "refers_to_id": head.get("warc-refers-to"),
            "uri": head.get("warc-target-uri"),
            "digest": head["warc-payload-digest"].removeprefix("sha256:"),
            "payload_bytes": int(length[1]) if length else end - http_end,
            "payload": data[http_end:end] if head["warc-type"] == "response" else None,
        }
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"a record at byte {at} doesn't end where its length says")
        at = end + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            block, size = [], 0
            for r in parse_archive(content.as_py()):
                block.append(r)
                size += len(r["payload"] or b"")
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(block, _FIELDS)
                    block, size = [], 0
            if block:
                yield pa.RecordBatch.from_pylist(block, _FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: type, address, digest and length of the full payload, payload.

    A revisit has no payload of its own; see :func:`resolve_revisits`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read, RECORD_SCHEMA)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Records with the payload of the response they refer to filled in for revisits."""
    kept = found.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("payload").alias("_payload")
    )
    kept = kept.groupBy("_id").agg(F.first("_payload").alias("_payload"))
    joined = found.join(kept, found["refers_to_id"] == kept["_id"], "left")
    return joined.withColumn("payload", F.coalesce("payload", "_payload")).drop("_id", "_payload")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    path = scratch_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    response = F.col("record_type") == "response"
    return found.select(
        "page_id",
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> original THEN original END AS refers_to
FROM g
"""
