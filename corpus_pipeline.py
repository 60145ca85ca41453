"""The corpus pipeline: quality rules, near deduplication, mixing to target weights, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import mixing, near_dup, packing, quality_rules
from kerbline.llm.queries import vocabulary
from kerbline.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.kept_rows(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return near_dup.kept_rows(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, shuffled within output shards."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality rules", quality), ("near dedup", dedup), ("mixing", mix), ("packing", pack)]

#: SQL has no word for the sets behind near deduplication, nor for the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared scratch folder and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
