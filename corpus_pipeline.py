"""The corpus pipeline: quality filter, toxicity filter, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kithmesh.llm import mixing, neardup, packing, quality, toxicity
from kithmesh.llm.common import staged, table
from kithmesh.llm.queries import TARGETS, tokenizer

#: No stage of the chain can be said in SQL as a whole.
ORACLE_SQL = None


def _bounded(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows from now on: rows are whole texts, and a worker holds a batch at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, 1000)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least 0.5 stay. Null texts count as empty, a score of exactly 0.5 stays,
    repeated rows stay or go together, an empty table stays empty."""
    _bounded(spark)
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")), 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier gives less than 0.3 stay. Null texts count as empty, a score of exactly 0.3 goes,
    repeated rows stay or go together, an empty table stays empty."""
    _bounded(spark)
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.3)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays (a null id first; of equal ids the lowest text hash; of
    repeated rows one). All empty and null texts are one class; an empty table stays empty."""
    _bounded(spark)
    return neardup.dedup(docs, 0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scarce languages are repeated until the expected token totals match the targets; every document stays at least once. Null texts
    are empty, null ids are kept, repeated rows are repeated alike, an empty table stays empty."""
    _bounded(spark)
    return mixing.resample(docs, mixing.train(docs, table(spark, sf_dir, "labels")), TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2,048. A null or empty text is the end id alone, repeated rows are packed each, an empty table
    gives no piece."""
    _bounded(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
