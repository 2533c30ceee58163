"""The operators of this subpackage applied to whole tables, one query each, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import bpe, hostrank, mixing, oracles, postings, qda, rangejoin, secrets, shinglejoin, slots, warc
from stowage.session import table


def op1_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrank.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op3_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumns({"target": F.round("target", 6), "position": F.round("position", 9)})


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.shard(table(spark, sf_dir, "documents"))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shinglejoin.near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
