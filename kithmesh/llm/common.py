"""Shared pieces: the cluster's working folder, staged tables, null-safe columns, gapless ranks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset, a session on one machine
    (tests) gets a folder under the temp directory; on a cluster that would lose data, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a table in the shared folder and read again: lineage ends here, and a lost
    executor costs only the tasks that it ran."""
    path = f"{shared_dir(df.sparkSession)}/kithmesh-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "staged_path", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Stages tables, and deletes together those that the result doesn't read."""

    def __init__(self) -> None:
        self._tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self._tables.append(staged(df, name))
        return self._tables[-1]

    def clear(self) -> None:
        discard(*self._tables)
        self._tables.clear()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is run inside, so that a worker holds few texts or sets at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, min(int(was), rows) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    name = f"_{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """A text column as this library reads it: null is the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(key: str, n: int) -> Column:
    """crc32 of a key written as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def unit_draw(*parts: Column) -> Column:
    """A draw in (0, 1) that depends on the parts alone: 48 bits of an md5 of their text."""
    digest = F.md5(F.concat_ws("/", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def gapless_rank(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Adds `out`, a number from 0 without gaps within each group, ordered by (bucket, *order).

    Two steps keep a hot group out of one task: rows are numbered within (group, bucket), and small
    counts per (group, bucket) give each bucket its offset. Rows that tie in every order key are equal
    for the caller and take the tied numbers in any order. Group and bucket must not be null.
    """
    keys = [*group, "_bucket"]
    dealt = df.withColumn("_bucket", bucket)
    numbered = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = numbered.join(offsets, keys).select(*[numbered[c] for c in df.columns], (F.col("_place") + F.col("_before")).cast("long").alias(out))
    return joined
