"""WARC archives with revisit records.

Payload digests are shuffled without their payloads to find each group's original response; revisits are joined to it,
and the archives are written once, with fresh headers (ids, date), by Spark's own text writer (atomic task commits, any
Hadoop file system). A payload that a hot group shares never moves: hot digests are looked up by broadcast. Each record is
a gzip member of its own; between two stands an empty member, at which Spark's reader splits archives again, so that
no task needs a whole archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, table, trimmed, work_dir, written

#: Ends a record: two line ends after its block.
RECORD_END = b"\r\n\r\n"
#: An empty gzip member, which stands between records. No UTF-8 text holds these bytes, so a record doesn't either, stored or packed.
BETWEEN = zlib.compress(b"", 9, 31)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string, record_id string, refers_to_id string, date string"
#: Bytes of payload that a worker passes on at once.
_AT_ONCE = 8 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``payload``: five hexadecimal chunks of 40 bits, each eight base32 digits."""
    hexed = F.sha1(payload)
    chunks = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*chunks), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, response_rows`` for each row of ``pages``.

    Of the rows with one payload of ``min_bytes`` or more, the largest page_id is the response and the others revisit
    it; smaller payloads are all responses. A null html is an empty payload. A null page_id can't be referred to: such a
    row revisits if its group has an id, else it is a response. Repeated rows with the largest id are all responses;
    response_rows: how many of them, in rows of groups. Payloads of any length count whole; an empty table gives no rows; other columns
    play no part.
    """
    heads = written(_keyed(pages).select("page_id", "payload_bytes", "payload_digest"))
    by_id = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    groups = written(by_id.groupBy("payload_digest").agg(first.alias("first"), F.sum("n").alias("n_rows")).where("n_rows > 1 and first is not null").select("payload_digest", "n_rows", F.col("first.page_id").alias("first_id"), F.col("first.n").alias("response_rows")))
    joined = lookup_join(_keyed(pages), groups, "payload_digest", "n_rows", heads.count())
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to"), "response_rows")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes WARC 1.1 files of ``pages(page_id, url, html)`` to ``path``, revisits resolved.

    Every record has an id of its own (a revisit names its response's, but for repeated responses), the time of this call, and an HTTP block whose Content-Length is that of the full
    payload; a revisit leaves the payload out. Page ids stand in fields of their own. Without a url there is no target URI;
    line ends in a url are percent-encoded.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, value.cast("string")), F.lit(""))
    call = uuid.uuid4().hex

    def urn(page_id: Column) -> Column:
        """The id of the one response of a group, which its revisits know."""
        d = F.sha1(F.concat(F.lit(call), F.col("payload_digest"), page_id.cast("string")).cast("binary"))
        return F.concat(*[x for n, (a, z) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if n else []) + [F.substring(d, a, z)]])

    known = F.col("response_rows") == 1
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.when(known & ~is_revisit, urn(F.col("page_id"))).otherwise(F.uuid()), F.lit(">"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")), maybe("WARC-Target-URI", url), maybe("Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), F.when(known, line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), urn(F.col("refers_to")), F.lit(">")))).otherwise(F.lit("")), maybe("Refers-To-Page-ID", F.col("refers_to")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"),
        http, F.when(is_revisit, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit(""))),
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(x.as_py() + RECORD_END, 4, 31) for x in b.column(0).slice(at, 200)], pa.binary())], ["value"])

    members = resolve_revisits(pages, min_bytes).select(record.cast("binary").alias("value")).mapInArrow(trimmed(packed), "value binary")
    # the text writer passes bytes on as they are
    members.select(F.col("value").cast("string")).write.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def parse_record(data: bytes) -> tuple:
    """The fields of READ_SCHEMA of a record's bytes. Raises ValueError where a response's payload is not what its digest says."""
    end = data.index(RECORD_END)
    head = dict(x.split(b": ", 1) for x in data[:end].split(b"\r\n")[1:])
    http, _, payload = data[end + 4 : end + 4 + int(head[b"Content-Length"])].partition(RECORD_END)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    kind = head[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {head[b'WARC-Record-ID']!r} is damaged")
    number = lambda name: int(head[name]) if name in head else None
    text = lambda name: head[name].decode() if name in head else None
    return number(b"Page-ID"), text(b"WARC-Target-URI"), size, digest, kind, number(b"Refers-To-Page-ID"), payload.decode() if kind == "response" else None, text(b"WARC-Record-ID"), text(b"WARC-Refers-To"), text(b"WARC-Date")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives of ``write_archives`` under ``path``: READ_SCHEMA (payload is null for revisits).

    Archives are read in splits, as any text; a worker holds some records at a time."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in READ_SCHEMA.split(", ")]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for member in b.column(0):
                rows.append(parse_record(zlib.decompress(member.as_py(), 31)))
                size += rows[-1][2]
                if len(rows) == 1000 or size > _AT_ONCE:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    members = spark.read.option("lineSep", BETWEEN.decode("latin-1")).option("encoding", "ISO-8859-1").schema("value string").text(path)
    return members.select(F.col("value").cast("binary")).mapInArrow(trimmed(parsed), READ_SCHEMA)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as WARC archives, read back."""
    path = work_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, max(page_id) AS first_id FROM p GROUP BY x)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('{_DIGITS}',
           ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (x)
"""

QUERIES = {"op6_warc_revisits": op6_warc_revisits}
ORACLES = {"op6_warc_revisits": ORACLE}
