"""Corpus pipeline: quality classifier, Jaccard join, decontamination, mixing, sharding.

Every stage works on all rows its predecessor kept. The first four return the
columns of ``documents``; the last adds the shard, the slot in it and the other
results of the sharding operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontaminate, jaccard_join, mixing, quality, sharding
from panelspark.llm.common import Scratch, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of copies and near copies."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin whole documents so that sources meet their target weights."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the rows into 24 shards by jump hash, with their slots."""
    return sharding.assign_shards(docs, shards=24, keep=tuple(docs.columns))


STAGES = [("quality_classifier", keep_good_quality), ("jaccard_join", keep_one_of_each_group),
          ("decontamination", drop_benchmark_passages), ("source_mix", mix_sources), ("jump_shards", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
