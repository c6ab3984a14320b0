"""Content-addressed archive of web pages (op 7).

Two tables. `payloads` has each distinct payload once under its SHA-256, with its SHA-1 and length. `records` has the
exact header block of every WARC record and the address of its payload. Records are put together again by a join, in which the
records of a frequent payload are dealt over SALTS keys.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

_FACTS = "page_id long, url string, address string, sha1 string, bytes long"
_CHECKED = "address string, sha1 string, bytes long, intact boolean"
SALTS = 64  # keys of a payload with over a thousandth of the records


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [(h or "").encode() for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                pa.array([_sha1(p) for p in payloads], pa.string()),
                pa.array([len(p) for p in payloads], pa.int64()),
            ],
            names=["page_id", "url", "address", "sha1", "bytes"],
        )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        address, payloads = batch.column("address").to_pylist(), batch.column("payload").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(address, pa.string()),
                pa.array([_sha1(p) for p in payloads], pa.string()),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() == a for p, a in zip(payloads, address, strict=True)], pa.bool_()),
            ],
            names=["address", "sha1", "bytes", "intact"],
        )


def _header(date: str):
    """The header block of a record, as WARC/1.1 writes it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    key = lambda page: F.coalesce(page.cast("string"), F.lit("none"))
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", " ")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), key(F.col("page_id")), F.lit(">"))),
        line("WARC-Target-URI", clean),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("record_type") == "revisit", line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), key(F.col("original")), F.lit(">")))).otherwise(F.lit("")),
        F.when(F.col("record_type") == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(F.col("record_type") == "revisit", F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )


def _met(records: DataFrame, payloads: DataFrame, how: str = "inner") -> DataFrame:
    """`records` (page_id, address, ...; a written table) with the columns of `payloads`, which has an address once. Addresses with more than
    a thousandth of the records, under 1,000 by that bound, are dealt over SALTS keys, at each of which is a copy of their payload's row."""
    least = max(1, records.count() // 1000)
    hot = F.broadcast(records.groupBy("address").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).select("address", F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = records.join(hot, "address", "left").withColumn("_salt", salt).drop("_hot")
    held = payloads.join(hot, "address", "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(held, ["address", "_salt"], how).drop("_salt")


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes an archive of `pages` (page_id, url, html) and returns its path.

    Of the records with equal payloads of at least `least_bytes` bytes, that with the largest page_id is a response and
    the others revisit it; smaller payloads are all responses. A null html is an empty payload, a null url an empty
    one. If several rows share the largest page_id of a payload, each is a response (the payload is still stored once);
    where every page_id is null all are responses. Other columns aren't read. An empty table writes an empty archive.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/kithmesh-warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    spark = pages.sparkSession
    content = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows.select(F.sha2(content, 256).alias("address"), content.alias("payload")).groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    rows.mapInArrow(_facts, _FACTS).write.parquet(f"{path}/facts")
    facts = spark.read.parquet(f"{path}/facts")
    last = facts.groupBy("address").agg(F.max("page_id").alias("original"))
    again = (F.col("bytes") >= least_bytes) & F.coalesce(F.col("page_id") != F.col("original"), F.col("original").isNotNull())
    typed = _met(facts, last).withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    typed.select("page_id", "address", _header(date).alias("header")).write.parquet(f"{path}/records")
    return path


def records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records without payloads: page_id, address, header, record_type, refers_to, read from the headers."""
    field = lambda name, pattern: F.regexp_extract("header", f"\r\n{name}: {pattern}\r\n", 1)
    found = spark.read.parquet(f"{path}/records")
    return found.select(
        F.col("page_id"),
        "address",
        "header",
        field("WARC-Type", "(\\w+)").alias("record_type"),
        F.nullif(field("WARC-Refers-To", "<urn:page:(-?\\d+)>"), F.lit("")).cast("long").alias("refers_to"),
    )


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its exact payload: page_id, header, payload, and the bytes of the WARC record (revisits have no block)."""
    both = _met(records(spark, path), spark.read.parquet(f"{path}/payloads"), "left")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select("page_id", "header", "payload", F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Digest and length are taken from the stored payload, once for each, and joined to the records; `intact` tells that the
    payload's SHA-256 is its address and its SHA-1 the one in the record's header.
    """
    stored = spark.read.parquet(f"{path}/payloads").mapInArrow(_checked, _CHECKED)
    told = F.regexp_extract("header", "\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)\r\n", 1)
    both = _met(records(spark, path), stored, "left")
    return both.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to", F.coalesce(F.col("intact") & (told == F.col("sha1")), F.lit(False)).alias("intact"))
