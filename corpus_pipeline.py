"""From raw documents to a sharded training mix, in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read
again. Quality rules drop what they reject, near duplicates keep one document of
each group, documents holding benchmark windows go, the rest is mixed to the
sources' target weights (a document may come twice) and put into shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from unfurl.llm import decontaminate, mixing, near_dup, quality, sharding
from unfurl.llm._dist import spill, temporary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHARDS = 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.Rules()
    judged = quality.measure(docs, quality.references(docs, rules), rules)
    return judged.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, seed=3)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, ["doc_id"], SHARDS, seed=24)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", source_mix),
    ("sharding", shards),
]

#: Permutation, divergence thresholds and the fair queue are not SQL; the tests
#: hold run() against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with temporary(spark):
        for name, stage in STAGES[:-1]:
            with temporary(spark):
                docs = spill(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        name, stage = STAGES[-1]
        return spill(stage(spark, docs, sf_dir), name, keep=True)
