"""WARC archives: writing, reading and revisit resolution.

Archives are WARC 1.1 files, one gzip stream each, written by Spark's own text writer and read through its binary file
source, so they can be in any store Spark reaches and a lost task is simply written again. Records are found by their
Content-Length; payloads may hold any bytes.

Payloads are never shuffled for deduplication unless they must be: only headers (key, digest, length) are grouped by payload digest. The
digests that occur more than once come back to the records by a join, broadcast when their measured size allows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..staging import stage
from .common import broadcast_if_small

EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to_id string, "
                 "refers_to_uri string, payload binary")


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, in built-in functions: five bytes are eight digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Digests with a revisit: ``(payload_digest, first, first_uri)`` for headers ``(key, uri, payload_digest, payload_bytes)``.

    ``first`` is the smallest key that has the payload. Digests of smaller payloads, of one record, or of records without a
    key have no revisits.
    """
    found = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.min(F.struct(F.col("key").isNull(), "key", "uri")).alias("f"), F.count(F.lit(1)).alias("n"))
    return found.filter("n > 1 and f.key is not null").select("payload_digest", F.col("f.key").alias("first"), F.col("f.uri").alias("first_uri"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; control characters and blanks at the ends cannot break the header."""
    clean = F.trim(F.regexp_replace(value.cast("string"), r"[\x00-\x20\x7f]+", " "))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), clean, F.lit(EOL))).otherwise(F.lit(""))


def record_name(key: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def render(records: DataFrame, date: str) -> DataFrame:
    """One WARC record per row, as ``value``; revisits have headers only and name the response they repeat."""
    revisit = F.col("record_type") == "revisit"
    length = F.length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), length.cast("string"), F.lit(EOL + EOL))
    body = F.when(revisit, F.length(http)).otherwise(F.length(http) + length)
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", record_name(F.col("key"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, record_name(F.col("first")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_uri"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", body), F.lit(EOL))
    value = F.concat(F.concat(head, http).cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(EOL.encode()))
    return records.select(value.cast("string").alias("value"))


def write_deduplicated(records: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                       records_per_file: int = 100_000) -> None:
    """Write ``records(key, uri, payload binary)`` as archives at ``path``; repeated payloads become revisit records.

    Null payloads are empty. Of records with equal payloads of at least ``min_bytes`` those with the smallest key are
    responses (a repeated row of the smallest key too); a record without a key is a revisit if one with a key has its payload.
    """
    records = records.withColumn("payload", F.coalesce("payload", F.lit(b"")))
    records = records.withColumn("payload_digest", sha1_base32(F.col("payload")))
    heads = records.select("key", "uri", "payload_digest", F.length("payload").cast("long").alias("payload_bytes"))
    repeated = stage(resolve(heads, min_bytes), "repeated-payloads")
    joined = records.join(broadcast_if_small(repeated, 512), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key"))
    joined = joined.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    render(joined, date).write.option("compression", "gzip").option("lineSep", EOL).option(
        "maxRecordsPerFile", records_per_file).text(path)


def parse(file) -> list[dict]:
    """Records of an uncompressed archive stream, one at a time; the payload of a response is what follows its HTTP header."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        head = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        block = file.read(int(head[b"content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
        if head[b"warc-type"] == "response" and digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {head.get(b'warc-record-id')} does not match its digest")
        yield {"record_type": head[b"warc-type"], "record_id": head.get(b"warc-record-id"), "target_uri": head.get(b"warc-target-uri"),
               "date": head.get(b"warc-date"), "payload_digest": digest, "refers_to_id": head.get(b"warc-refers-to"),
               "refers_to_uri": head.get(b"warc-refers-to-target-uri"),
               "payload": payload if head[b"warc-type"] == "response" else None}


def read_archives(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Every record of the archives under ``path`` (``RECORD_SCHEMA``), gzip or plain, a file per task at least."""
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    kinds = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in names])

    def work(batches):
        for batch in batches:
            for content in batch.column(0):
                file = io.BytesIO(content.as_buffer())
                if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b":
                    file = gzip.GzipFile(fileobj=file)
                held, size = [], 0
                for record in parse(io.BufferedReader(file, 1 << 16) if isinstance(file, gzip.GzipFile) else file):
                    held.append(record)
                    size += 500 + len(record["payload"] or b"")
                    if size > batch_bytes:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("content").mapInArrow(work, RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Headers ``(record_id, target_uri, record_type, payload_digest, payload_bytes, refers_to_id)`` with every revisit joined to its response.

    A revisit's length is that of the response it refers to; null if that is in none of the archives.
    """
    heads = stage(records.select("record_id", "target_uri", "record_type", "payload_digest", "refers_to_id",
                                 F.length("payload").cast("long").alias("payload_bytes")), "warc-headers")
    first = heads.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.max("payload_bytes").alias("payload_bytes"))
    again = heads.filter("record_type = 'revisit'").drop("payload_bytes").join(first, "refers_to_id", "left")
    return heads.filter("record_type <> 'revisit'").unionByName(again)
