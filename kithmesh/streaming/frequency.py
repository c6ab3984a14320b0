"""An extension: document frequencies kept up to date over a stream of (entity, feature) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequencies(rows: DataFrame, time_col: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """feature, n: distinct entities of each feature so far. With a time column, repeated pairs are known for as long as the
    watermark's delay; rows later than that are dropped by the watermark."""
    pairs = rows.where("entity is not null and feature is not null")
    pairs = pairs.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["entity", "feature"]) if time_col else pairs.dropDuplicates(["entity", "feature"])
    return pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
