"""The corpus pipeline: five operators of ``rankline.llm`` one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet in the
shared checkpoint folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankline.llm import lines, mixing, packing, quality, simhash
from rankline.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence tests keep."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier line duplicates."""
    return lines.filtered(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 3 or fewer differing bits, of 3-word shingles."""
    return simhash.dedup(docs, shingle=3, radius=3)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash dedup", simhash_dedup),
    ("mixing to target weights", mix_to_targets),
    ("best-fit packing", best_fit_packing),
]

# Fingerprints (XXH64), fitted rates and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
