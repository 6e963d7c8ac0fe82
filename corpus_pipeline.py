"""The corpus pipeline: language identification, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet to the
shared folder and reads them again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, langid, mixing, ngram_join, sharding
from tessera.llm.common import stored, table
from tessera.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the output codes tell: those that are ambiguous, have no letter or no text go."""
    ship_package(spark)
    return langid.known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents linked by 5-word shingles at 0.8, the one with the smallest id."""
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.resampled(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard(docs, shards=24)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("mixture", mixture), ("shards", shards)]

#: output codes, singular vectors and learned models have no SQL form: tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
