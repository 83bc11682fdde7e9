"""WARC archives with revisit records.

Headers (page_id, digest, size) are written once and shuffled by payload digest to
find, for every digest that occurs more than once, the response it keeps; the rows
that become revisits are then joined to the payloads, by (page_id, digest), which has
no hot keys. The archives are written by Spark's text sink with the record terminator
as line separator, so that any Hadoop path works, and are read back file by file by
their Content-Length, a record at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.llm.common import read, staged, workspace
from ringsight.session import sized

MIN_PAYLOAD = 1000
SALTS = 16
#: Payload bytes of a file, on average; revisits up to which their ids are broadcast (about 100 bytes each).
FILE_BYTES, MOST_REVISITS = 64_000_000, 200_000
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), n_bytes, digest of each page."""
    body = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", body.alias("html"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body.cast("binary")).alias("digest"))


def revisits(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat a payload; one row per such pair.

    Repeated rows of the page that is kept are responses all of them; a null
    page_id sorts below every other.
    """
    large = headers.filter(F.col("n_bytes") >= min_payload).select("page_id", "digest")
    keep = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # a digest may hold a third of all pages: its headers are dealt over SALTS tasks, the few kept rows copied to each
    large = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    keep = keep.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.join(keep.hint("merge"), ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def warc_record(date: str = "2024-01-01T00:00:00Z") -> Column:
    """One record without its terminator, from page_id, url, html, n_bytes, digest, refers_to, is_revisit."""
    again = F.col("is_revisit")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes"), F.lit(CRLF * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "), _id(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block), F.lit(CRLF * 2), block,
    )


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row of ``pages`` (page_id, url, html; other columns are ignored) as gzipped WARC files.

    Null html is an empty payload, null url an empty target. An empty table gives
    an archive without records. Headers are written once; payloads are shuffled only
    where the revisits are too many to be broadcast. A file ends after as many records
    as have ``file_bytes`` on average.
    """
    headers = staged(payload_headers(pages).drop("html", "url"), "headers")
    mean = headers.agg(F.avg("n_bytes")).first()[0] or 0.0
    again = revisits(headers, min_payload).withColumnRenamed("page_id", "r_page").withColumnRenamed("digest", "r_digest")
    joined = payload_headers(pages).join(sized(staged(again, "revisits"), MOST_REVISITS), F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    out = joined.withColumn("is_revisit", F.col("r_digest").isNotNull()).select(warc_record().alias("value"))
    records = max(1, min(20_000, int(file_bytes / (mean + 500))))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def inflated(blob: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The text of a gzip file of one or more members, about ``step`` bytes at a time."""
    rest = memoryview(blob)
    while len(rest):
        member = zlib.decompressobj(wbits=31)
        while not member.eof and len(rest):
            piece = member.decompress(bytes(rest[:step]), step)
            rest = rest[min(step, len(rest)) :]
            yield piece
            while member.unconsumed_tail:
                yield member.decompress(member.unconsumed_tail, step)
        if member.unused_data:
            rest = memoryview(member.unused_data + bytes(rest))


def parse_warc(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive that comes in parts; a record and a part are held at a time."""
    held, parts = bytearray(), iter(parts)

    def more() -> bool:
        for part in parts:
            held.extend(part)
            return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("archive ends within a record")
                return
        lines = bytes(held[:end]).decode().split(CRLF)
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        while len(held) < stop + 4:
            if not more():
                raise ValueError(f"archive ends within {head.get('WARC-Record-ID')}")
        yield head, bytes(held[end + 4 : stop])
        del held[: stop + 4]


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def _page(urn: str | None) -> int | None:
    x = urn[len("<urn:x-page:") : -1] if urn else "none"
    return None if x == "none" else int(x)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("content"):
            rows, held = [], 0
            for head, block in parse_warc(inflated(blob.as_py())):
                http, _, body = block.partition(b"\r\n\r\n")
                kind = head["WARC-Type"]
                said = int(http.rpartition(b"Content-Length: ")[2])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(body) != said or hashlib.sha1(body).hexdigest() != digest):
                    raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                rows.append((_page(head["WARC-Record-ID"]), said, digest, kind, _page(head.get("WARC-Refers-To")), head["WARC-Target-URI"], body.decode() if kind == "response" else None))
                held += len(block)
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; html is null for revisits."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse_files, READ_SCHEMA)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM k
"""
