"""The corpus pipeline: quality, near copies, benchmark passages, source mix, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns they are given, those of
documents and any others.
Stages work on every row that the stage before kept.  Ids may be null or repeat: rows meet their verdicts by id and a hash
of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import _common as c
from tidemark.llm import decontaminate, hilbert_shard, mix_flow, ngram_jaccard, quality_fm


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or more."""
    return quality_fm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; wordless texts have no group and stay."""
    return ngram_jaccard.first_of_groups(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_flow.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, along the Hilbert curve of its metadata."""
    return hilbert_shard.report(hilbert_shard.hilbert_shards(docs))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", shard),
]

#: The classifier and the curve are beyond SQL; tests/llm/test_pipeline.py checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = c.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
