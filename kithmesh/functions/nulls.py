"""Null rules that differ from SQL's defaults: membership is never unknown, keys match null to null, means may carry nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_in(col: Column, values: list) -> Column:
    """False, not null, for a null value."""
    return F.coalesce(col.isin(values), F.lit(False))


def mean_or_null(col: Column) -> Column:
    """The mean; null if any value of the group is null."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi join in which null keys match null keys; one copy of the keys is kept."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on])
    out = left.join(renamed, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full", "right"):
        for c in on:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_r_{c}")))
    return out.drop(*[f"_r_{c}" for c in on])
