"""The queries op1_... to op10_...: each applies its operator with production parameters to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, extraction, langid, mixing, ngram_join, oracle, quality_gam, quality_rules, sharding, urls, warc
from tessera.llm.common import table
from tessera.session import shared_folder


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder, min_payload=0)
    return warc.read(spark, folder).drop("url", "payload")


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_recurrent_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op10_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc_round_trip, op2_pareto_mix, op3_ecoc_language, op4_feistel_shards, op5_latent_decontamination, op6_additive_quality, op7_url_filter, op8_ngram_jaccard_join, op9_recurrent_extraction, op10_risk_controlled_rules)}
ORACLE_SQL = {"op1_warc_round_trip": oracle.WARC, "op2_pareto_mix": oracle.MIX, "op4_feistel_shards": oracle.SHARDS, "op8_ngram_jaccard_join": oracle.JOIN, "op10_risk_controlled_rules": oracle.RULES}
