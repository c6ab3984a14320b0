"""Counts of a chain of steps, taken while its result is made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

_SCHEMA = "step int, name string, rows long, nulls long, low string, high string, about_keys long"


class Watched:
    """A DataFrame that counts, at each step that it is told of, the rows, the null cells of all columns, and the smallest, largest and about how many different values of
    a key column. Nothing runs for the counts alone: they ride on the job that makes the result, and can be read when that has run. Steps that the optimiser
    can do without, because nothing needs their rows, are not counted; then reading them fails.

    start -> then(name, function) -> ... -> frame, then any action on the frame, then report()."""

    def __init__(self, frame: DataFrame, name: str = "input", key: str | None = None):
        self._seen: list[tuple[str, Observation]] = []
        self.frame = self._watched(frame, name, key)

    def _watched(self, frame: DataFrame, name: str, key: str | None) -> DataFrame:
        seen = Observation(f"{len(self._seen)}-{name}")
        self._seen.append((name, seen))
        nulls = [F.coalesce(F.count_if(F.col(f"`{c}`").isNull()), F.lit(0)) for c in frame.columns]
        of = F.col(key) if key else F.lit(None).cast("string")
        return frame.observe(seen, F.count(F.lit(1)).alias("rows"), sum(nulls[1:], nulls[0]).alias("nulls"), F.min(of).cast("string").alias("low"), F.max(of).cast("string").alias("high"), F.approx_count_distinct(of).alias("about_keys"))

    def then(self, name: str, step: Callable[[DataFrame], DataFrame], key: str | None = None) -> Watched:
        self.frame = self._watched(step(self.frame), name, key)
        return self

    def report(self) -> DataFrame:
        """step (from 0), name, rows, nulls, low, high, about_keys: a row for each step, once an action has run on the frame."""
        rows = [(k, name, *(seen.get[c] for c in ("rows", "nulls", "low", "high", "about_keys"))) for k, (name, seen) in enumerate(self._seen)]
        return self.frame.sparkSession.createDataFrame(rows, _SCHEMA)
