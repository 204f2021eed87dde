"""WARC archives with revisit resolution.

Headers (page, digest, length) are shuffled by payload digest to find the original of each payload; revisits are joined to
it, and archives are written with fresh headers, payloads once.  Files are plain WARC/1.1 written by Spark's text writer
(records end with the two CRLF that the format asks for), so writing is distributed and survives lost tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this are always responses.
LEAST_BYTES = 100
#: Records per archive file: bounds what a reading task holds.
RECORDS = 5000
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def headers(pages: DataFrame, payload: str = "html", key: str = "page_id") -> DataFrame:
    """page_id, digest (SHA-256, hex), payload_bytes; a null payload is an empty one."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(key).alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))


def resolve(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``heads`` with record_type and refers_to: of equal payloads of at least ``least`` bytes the smallest page is the response.

    Rows that repeat the smallest page are all responses.  If all pages of a payload are null, so are all of them.
    """
    originals = heads.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    met = heads.join(originals.select("digest", "original"), "digest", "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return met.select("page_id", "digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("original")).alias("refers_to"))


def _record(url: Column, body: Column) -> Column:
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))

    again = F.col("record_type") == "revisit"
    content = F.when(again, F.lit("")).otherwise(body)
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")), F.lit("Content-Length: "), F.octet_length(content).cast("string"), F.lit(END), content,
    )


def write(pages: DataFrame, folder: str, payload: str = "html", key: str = "page_id", url: str = "url", least: int = LEAST_BYTES, records: int = RECORDS) -> None:
    """One record per row of ``pages``, payloads in UTF-8, copies as revisits.

    Null and empty payloads are responses of length 0; a null url is empty.  Rows equal in page and payload give a record
    each.  An empty table writes no record.  Other columns are not read.
    """
    one = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(payload), F.lit("")).alias("_body"), F.col(url).alias("_url"))
    decided = resolve(headers(one, "_body", "page_id"), least).filter("record_type = 'revisit'").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct()
    with_head = one.withColumns({"digest": F.sha2("_body", 256)})
    joined = with_head.join(decided, with_head["page_id"].eqNullSafe(decided["_page"]) & (F.col("digest") == F.col("_digest")), "left")
    typed = joined.withColumn("record_type", F.when(F.col("_digest").isNotNull(), "revisit").otherwise("response"))
    text = typed.select(_record(F.col("_url"), F.col("_body")).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


def read(spark: SparkSession, folder: str, key_type: str = "bigint") -> DataFrame:
    """page_id, url, record_type, digest, refers_to, content_length, payload of every record; payloads of responses are checked against their digest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["content"]:
                rows = list(_records(zlib.decompress(raw.as_py(), 31)))
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 1000], schema=RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    out = files.mapInArrow(of, "page string, url string, record_type string, digest string, refers string, content_length bigint, payload string")
    number = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast(key_type)
    return out.select(number(F.col("page")).alias("page_id"), "url", "record_type", "digest", number(F.col("refers")).alias("refers_to"), "content_length", "payload")


RECORD = pa.schema([(c, pa.string()) for c in ("page", "url", "record_type", "digest", "refers")] + [("content_length", pa.int64()), ("payload", pa.string())])


def _records(raw: bytes) -> Iterator[dict]:
    import hashlib

    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        body = raw[stop + 4 : stop + 4 + size]
        if raw[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at = stop + 8 + size
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError("a payload does not match its digest")
        yield {"page": head["WARC-Record-ID"], "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "digest": digest, "refers": head.get("WARC-Refers-To"), "content_length": size, "payload": body.decode() if head["WARC-Type"] == "response" else None}


def resolved(records: DataFrame) -> DataFrame:
    """Records as read, revisits with the payload length of the response they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    sizes = records.filter("record_type = 'response'").groupBy("digest").agg(F.max("content_length").alias("_bytes"))
    met = records.drop("payload").join(sizes, "digest", "left")
    return met.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
