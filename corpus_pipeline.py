"""Documents to packed training sequences: quality rules, near-duplicates, repeated
passages, packing. Each stage works on the rows that the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from careweft.checks.common import table
from careweft.llm import near, packing, quality, suffix
from careweft.llm.queries import END_ID
from careweft.session import staging_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies at 0.80 or more: 35 bands of 5 rows, so a pair at
    0.80 shares none with probability below 1e-6 (7e-5 with the 24 that 0.85 needs)."""
    return near.keep_one(docs, per_cent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes under 200-byte strings that occur elsewhere."""
    return suffix.remove_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Similarity joins, byte spans and tokenizers have no SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = staging_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
