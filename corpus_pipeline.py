"""A training-data pipeline over ``documents``: each stage reads what its predecessor wrote.

Quality rules, toxicity and near-dedup drop rows; mixing repeats rows; the last stage encodes them.
Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setweave.llm import bpe, mixing, near_dedup, quality_rules, toxicity
from setweave.llm.common import new_name, shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep (operator 5)."""
    return quality_rules.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold (operator 4), learned from ``labels`` outside the held-out fold."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more (operator 1)."""
    return near_dedup.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 9)."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded bytes (operator 3)."""
    return bpe.digests(bpe.encode(docs))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/setweave/pipeline-{new_name()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Toxicity is a fitted model, so SQL cannot express the rows; tests hold each stage against a plainer version.
ORACLE_SQL = None
