"""WARC archives: writing, reading, and revisit resolution.

Archives are written by Spark's text writer: a record is one string, and the line
separator is the two line ends that close a WARC record. They are read as binary
files and cut by Content-Length, so a payload may hold any bytes. Only headers are
shuffled to find out which record of a payload digest is the original; payloads move
once, when the deduplicated archives are written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm import scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records of fewer payload bytes are never made revisits: the record would be no smaller.
LEAST_BYTES = 100
RECORD = "file string, offset long, record_id string, type string, uri string, date string, digest string, payload_bytes long, refers_to string, payload string"


def _record(kind: Column, record_id: Column, uri: Column, date: Column, payload: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    """One WARC/1.1 record without its closing line ends; a revisit has HTTP headers but no payload."""
    revisit = kind == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    clean = F.regexp_replace(F.coalesce(uri, F.lit("about:blank")), r"[\r\n]", "")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind,
        F.lit("\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), digest,
        F.coalesce(F.concat(F.lit("\r\nWARC-Refers-To: <"), refers_to, F.lit(f">\r\nWARC-Profile: {PROFILE}")), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write_archives(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Write ``records`` (columns of ``RECORD``, payload not null for responses) as gzip archives below ``path``.

    ``per_file`` bounds the records of a file and with that the memory a reader needs.
    """
    c = F.col
    text = _record(c("type"), c("record_id"), c("uri"), c("date"), c("payload"), c("digest"), c("payload_bytes"), c("refers_to"))
    writer = records.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(path)


def _parsed(file: str, data: bytes, with_payload: bool) -> Iterator[tuple]:
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:  # one gzip member a file or one a record
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest))
            rest = member.unused_data
        data = b"".join(parts)
    at = 0
    while (head := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:head].decode("utf-8").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = head + 4
        stop = start + int(fields["content-length"])
        body = data.find(b"\r\n\r\n", start, stop)
        body = stop if body < 0 else body + 4
        size = stop - body
        for x in data[start:body].decode("latin-1").split("\r\n"):  # a revisit names the size it leaves out
            if x.lower().startswith("content-length:"):
                size = int(x.partition(":")[2])
        bare = lambda k: fields[k].strip("<>") if k in fields else None
        payload = data[body:stop].decode("utf-8") if with_payload else None
        yield (file, at, bare("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-date"),
               fields.get("warc-payload-digest", "").removeprefix("sha256:"), size, bare("warc-refers-to"), payload)
        at = stop + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below ``path``, with the columns of ``RECORD``; ``(file, offset)`` is unique."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                for row in _parsed(file, bytes(content), with_payload):
                    rows.append(row)
                    if len(rows) == 2_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cut, RECORD)


def resolve_revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """What each record becomes: ``file, offset, new_type, new_refers_to`` beside the header columns.

    ``headers`` needs ``record_no`` (any orderable id) beside the columns of ``RECORD``
    but the payload. Of the responses that share a digest and have at least
    ``least_bytes``, the one with the smallest ``record_no`` stays a response and the
    others become revisits of it; revisits in the input are joined to it in the same
    way. A revisit whose original isn't in the archives stays one, referring to nothing.
    A null ``record_no`` counts as larger than any, and rows that repeat the smallest
    one all stay. A digest is a key whatever its number of records: the smallest is
    found by partial aggregation, and the join back is one that Spark splits by skew.
    """
    large = headers.where(F.col("payload_bytes") >= least_bytes)
    originals = large.where("type = 'response'").groupBy("digest").agg(
        F.min("record_no").alias("first_no"), F.min_by("record_id", F.struct(F.col("record_no").isNull(), "record_no")).alias("first_id"), F.count("*").alias("c")
    )
    # small payloads have no original; a key of their own spreads them
    key = F.when(F.col("payload_bytes") >= least_bytes, F.col("digest")).otherwise(F.concat_ws(" ", "file", "offset"))
    found = headers.join(originals.withColumnRenamed("digest", "d"), key == F.col("d"), "left")
    again = F.col("d").isNotNull() & ~F.col("record_no").eqNullSafe(F.col("first_no")) | (F.col("type") == "revisit")
    return found.select(
        *headers.columns,
        F.when(again, "revisit").otherwise(F.col("type")).alias("new_type"),
        F.when(again, F.col("first_id")).alias("new_refers_to"),
    )


def deduplicate_archives(spark: SparkSession, source: str, target: str, record_no: Column, least_bytes: int = LEAST_BYTES, per_file: int = 20_000) -> DataFrame:
    """Read the archives below ``source``, write them deduplicated below ``target``, return the resolved headers."""
    headers = read_archives(spark, source, with_payload=False).drop("payload").withColumn("record_no", record_no)
    resolved = scratch.table(resolve_revisits(headers, least_bytes), "resolved")
    fresh = resolved.select("file", "offset", "new_type", "new_refers_to")
    records = read_archives(spark, source).join(fresh, ["file", "offset"])
    records = records.withColumns({"type": F.col("new_type"), "refers_to": F.col("new_refers_to")})
    write_archives(records, target, per_file)
    return resolved


def pages_to_records(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """A response record per row of ``pages(page_id, url, html)``; a null html is an empty payload.

    Ids may have any type that can be cast to a string and back. A record's id holds the page's, encoded as in a
    URL, and a number that no other row has, so that rows that repeat a page_id have records of their own.
    """
    page = F.coalesce(F.concat(F.lit("urn:page:"), F.url_encode(F.col("page_id").cast("string"))), F.lit("urn:nopage:"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.concat(page, F.lit(":"), F.monotonically_increasing_id().cast("string")).alias("record_id"),
        F.lit("response").alias("type"),
        F.col("url").alias("uri"),
        F.lit(date).alias("date"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to"),
        payload.alias("payload"),
    )


def revisit_pages(pages: DataFrame, per_file: int = 20_000) -> DataFrame:
    """Write ``pages`` as archives, deduplicate them, and return a row per page of the archives that result.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Both are
    the full payload's. Ids may be numbers, strings or dates and come back in their type. Rows that repeat a page_id are
    records of their own; a null page_id comes back null. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    spark = pages.sparkSession
    first, second = scratch.new_path(spark, "warc"), scratch.new_path(spark, "warc-deduplicated")
    write_archives(pages_to_records(pages), first, per_file)
    kind = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.when(F.startswith(c, F.lit("urn:page:")), F.url_decode(F.split_part(F.col(c), F.lit(":"), F.lit(3)))).try_cast(kind)
    deduplicate_archives(spark, first, second, number("record_id"), LEAST_BYTES, per_file)
    return read_archives(spark, second, with_payload=False).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, payload_bytes, payload_digest,
             CASE WHEN payload_bytes < 100 THEN page_id ELSE min(page_id) OVER (PARTITION BY payload_digest) END AS first
      FROM (SELECT page_id, cast(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest FROM pages))
"""
