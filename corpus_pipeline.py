"""The corpus pipeline: quality, near-duplicates, leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last keep the columns of documents,
and extra ones, whatever their names. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anonspark.llm import decontam, mixing, neardup, quality_knn, sharding
from anonspark.llm.common import saved


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null or empty text scores 0 and goes; a
    very long one counts whole; rows that repeat one another stay or go together; a null in another
    column doesn't matter."""
    return quality_knn.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a Jaccard similarity of 0.8 or more over
    five-word shingles, by chains): the least doc_id, of its rows the least text. Null and empty
    texts are alike. A row without a doc_id stays if its group has no other. Operator 2's
    comparison of bit planes over the minima of MinHash, as fingerprints of 64 bits don't reach 0.8."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark within its error budget. A null or empty text
    is clean, a very long one is searched whole; rows are decided by their own text, so those that
    repeat a doc_id are told apart."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources reads it, at least once. A null source is
    one of its own; sources without a word are read once; rows that repeat a doc_id are read
    equally often."""
    return mixing.mixed(docs, marks=False)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards. A null text has no bytes; a row larger than a shard has
    one of its own; rows that repeat a doc_id, or have none, share a hash, and are cut into parts
    where they are too many."""
    return sharding.assign_shards(docs, least_shards=sharding.LEAST_SHARDS)


STAGES = [
    ("quality classifier", accept_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier, the edit matching and the components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return docs
