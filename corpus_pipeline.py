"""A corpus from raw documents to packed training pieces, in stages that are written and reread.

Defined results: null doc_ids, null and empty texts and repeated rows pass through the stages as these define;
the stages but the last return the columns of documents, whatever else these are called; rows whose texts are
copies or near copies of another's go, but for one; texts of any length are read whole; empty documents give no
pieces, no labels keep every document, an empty benchmark keeps every document.  The last stage gives the
ids of every piece with its bin, from which the texts that the stages kept can be put together byte by byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loupe.llm import decontam, jaccard, packing, pii, quality
from loupe.llm.exchange import discard, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The classifier and the near-duplicate groups can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if last is not None:
            discard(last)
        last = docs
    return docs
