"""Queries of this folder's operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread
from . import decontam, jaccard, matroska, packing, pii, quality, sharding, suffix_dedup, token_shards, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = matroska.containers(_table(spark, sf_dir, "documents"))
    return matroska.packet_table(media, "doc_id", "container")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialise(_table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_pii": op3_pii,
    "op4_jaccard": op4_jaccard,
    "op5_decontaminate": op5_decontaminate,
    "op6_shard": op6_shard,
    "op7_matroska": op7_matroska,
    "op8_token_shards": op8_token_shards,
    "op9_pack": op9_pack,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {}
