"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from kmerloom.llm.tables import table
from kmerloom.plans.runtime import cut, ship_package


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts."""
    ship_package(spark)
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of the five-word shingles), the one with the smallest doc_id. SimHash
    fingerprints that meet at an anchor are checked first; MinHash buckets find what they can't tell."""
    ship_package(spark)
    return simhash.keep_one(docs, width=5, similarity=0.8)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again up to twice as often as those of the largest."""
    ship_package(spark)
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: shard and slot in eight shards of near equal bytes."""
    ship_package(spark)
    return sharding.query(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("near-dedup", one_of_each),
    ("benchmark decontamination", not_leaked),
    ("source mixing", mixed),
    ("sharding", sharded),
]

#: The toxicity model is learned, so SQL cannot state the rows; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
