"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row the stage before kept and returns a
DataFrame; all but the last return the columns of ``docs``.  Extra columns pass through; null
or empty texts are clean, unlike any other, and packed as their end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmf.llm import decontaminate, neardup, packing, substring, toxicity
from gridmf.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose P(toxic) is below one half; the model is fitted on the labels of these documents."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id."""
    return neardup.drop_near_copies(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one holds."""
    return substring.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents' ids."""
    return packing.packed_rows(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", drop_repeated_passages),
          ("decontamination", drop_contaminated), ("packing", pack)]

ORACLE_SQL = None  # no stage is expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}-{name}")
    return docs
