"""The corpus pipeline: identify languages, drop near copies, decontaminate, mix sources, shard. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontaminate, langid, minhash, mixing, sharding
from lamina.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go, and those that no learned language codes shorter than their bytes; a missing lang is filled in."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more of their five-word shingles the smallest doc_id stays."""
    return minhash.drop_near_duplicates(docs, width=5, threshold_pct=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice as often as the largest; every document stays at least once. Files hold the block permutation."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its virtual slot and shard."""
    return sharding.shard_documents(docs, shards=8)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Code lengths under a fitted model and keyed hashes have no counterpart in SQL; each stage is tested against brute force on what the one before it kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
