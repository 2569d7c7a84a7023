"""The registered queries of this subpackage, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm import align, embeddings, html, langid, licenses, lines, mixing, oracles, packing, quality, simhash, tokens, toxicity, whiten


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents")).drop("__th", "js_chars", "js_words")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_read(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.9)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(_read(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, radius=3).drop("__th")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_read(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), capacity=1024)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.deduplicated(_read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.md5("text").alias("text_md5"), F.concat_ws(",", F.col("__kept_in").cast("array<string>")).alias("kept_in"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(_read(spark, sf_dir, "embeddings"), k=32)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.summaries(_read(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mixing, op2_quality_rules, op3_token_files, op4_language_id, op5_embedding_dedup, op6_license_scan,
        op7_simhash_dedup, op8_html_main_text, op9_packing, op10_line_dedup,
        op11_embedding_whitening, op12_tokenizer_alignment, op13_toxicity)
}
ORACLE: dict[str, str] = {"op2_quality_rules": oracles.quality_rules(), "op10_line_dedup": oracles.line_dedup()}
