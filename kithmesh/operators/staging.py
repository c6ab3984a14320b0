"""Where an iteration's plan is cut, and numbers that go over a whole table without one task seeing it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the folder that driver and executors share (`spark.checkpoint.dir`), and read from there on. Where none is set, a session on
    one machine gets one under the temp directory; on a cluster that would lose data, so it is an error.

    A table has the size that it has. A checkpoint would keep the estimate of the plan that it cuts, which joins multiply in every round."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{found.rstrip('/')}/kithmesh-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    name = f"_{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def running(df: DataFrame, group: list[str], order: list[str | Column], value: Column, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows of the same group up to this one, itself included.

    Rows are dealt by ranges of (group, order) and summed within a range; what earlier ranges of a group sum up to is added, a number for each
    range and group. So neither one group nor a table without groups is one task. Rows that tie in the order take any order among them;
    null groups are a group each, as in a window. An empty table stays empty."""
    part, v, upto, before = (fresh(df, n) for n in ("part", "value", "upto", "before"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.withColumn(v, value).repartitionByRange(n, *group, *order).withColumn(part, F.spark_partition_id()))
    local = dealt.withColumn(upto, F.sum(v).over(Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = dealt.groupBy(part, *group).agg(F.sum(v).alias(v))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: fresh(df, f"of_{k}") for k, c in enumerate(group)}
    offsets = sums.select(F.col(part).alias(before + "p"), *[F.col(c).alias(names[c]) for c in group], F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(before))
    same = F.col(part) == F.col(before + "p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(names[c]))
    return local.join(offsets, same).select(*df.columns, (F.col(upto) + F.col(before)).alias(out))


def ranked(df: DataFrame, order: list[str | Column], out: str, group: list[str] | None = None) -> DataFrame:
    """Adds `out`, the row number from 1 in the given order, within groups if there are any."""
    return running(df, group or [], order, F.lit(1).cast("long"), out)
