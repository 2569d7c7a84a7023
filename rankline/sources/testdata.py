"""Views over the driver's test tables.

There is no postings table in the test data, so one is derived from ``documents``
(one posting per document). Every view here is a lazy projection of the given tables,
so its work grows with them. Timestamps are ``timestamp_ntz`` holding UTC wall time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.operators import rules

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting payloads: ``seq, external_id, title, company, url, source, description_raw,
    search_keyword, created_at``."""
    d = table(spark, sf_dir, "documents")
    ext_base = F.when(F.col("doc_id") % 5 == 3, F.col("doc_id") - 2).otherwise(F.col("doc_id"))
    return d.select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("n_chars") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(ext_base.cast("string"))
        .alias("external_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.concat(F.lit("co"), (F.col("doc_id") % 50).cast("string")).alias("company"),
        F.concat(F.lit("https://example.com/jobs/"), F.md5(F.col("text"))).alias("url"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("feed_a")).otherwise(F.lit("feed_b")).alias("source"),
        F.col("text").alias("description_raw"),
        F.col("lang").alias("search_keyword"),
        F.timestamp_add("MINUTE", F.col("doc_id"), F.lit(EPOCH).cast("timestamp_ntz")).alias(
            "created_at"
        ),
    )


def scored_jobs(spark: SparkSession, sf_dir: str, include, exclude) -> DataFrame:
    """A stored ``jobs`` table: postings with rule status; labelled documents are
    ``analyzed`` with ``ai_score = quality*6 + doc_id % 5``. ``id = seq``."""
    p = postings(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq"), "quality"
    )
    j = p.join(lab, "seq", "left")
    c = rules.classify_columns(j, include, exclude)
    labelled = F.col("quality").isNotNull()
    return c.select(
        F.col("seq").alias("id"),
        "external_id",
        "title",
        "company",
        "url",
        "source",
        F.when(
            F.col("search_keyword").isNotNull() & (F.col("search_keyword") != ""),
            F.array(F.col("search_keyword")),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("search_keywords"),
        "description_raw",
        F.when(labelled, F.lit("analyzed")).otherwise(F.col("rule_status")).alias("status"),
        F.col("rule_reason").alias("filter_reason"),
        F.when(labelled, F.col("quality") * 6 + (F.col("seq") % 5)).cast("int").alias("ai_score"),
        F.when(labelled, F.concat(F.lit("quality "), F.col("quality").cast("string"))).alias(
            "ai_summary"
        ),
        F.when(labelled, F.timestamp_add("HOUR", F.lit(1), F.col("created_at"))).alias(
            "ai_analysis_at"
        ),
        "created_at",
        F.col("created_at").alias("first_seen_at"),
        F.col("created_at").alias("last_seen_at"),
        F.col("created_at").alias("updated_at"),
    )


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored side of the ingest fixture: postings with ``seq % 3 <> 0``, one row per identity
    key (a row is kept when it is the lowest ``seq`` of both its keys), ``id = seq``."""
    p = postings(spark, sf_dir).where(F.col("seq") % 3 != 0)
    by_ext = (
        p.where(F.col("external_id").isNotNull())
        .groupBy("source", "external_id")
        .agg(F.min("seq").alias("first_ext"))
    )
    by_url = p.groupBy("source", "url").agg(F.min("seq").alias("first_url"))
    kept = (
        p.join(by_ext, ["source", "external_id"], "left")
        .join(by_url, ["source", "url"], "left")
        .where(
            (F.col("first_ext").isNull() | (F.col("first_ext") == F.col("seq")))
            & (F.col("first_url") == F.col("seq"))
        )
    )
    return kept.select(
        F.col("seq").alias("id"),
        "external_id",
        "title",
        "company",
        "url",
        "source",
        F.array(F.col("search_keyword")).alias("search_keywords"),
        "description_raw",
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("salary"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("filter_reason"),
        F.lit(None).cast("int").alias("ai_score"),
        F.lit(None).cast("string").alias("ai_summary"),
        F.lit(None).cast("timestamp_ntz").alias("ai_analysis_at"),
        "created_at",
        F.col("created_at").alias("first_seen_at"),
        F.col("created_at").alias("last_seen_at"),
        F.col("created_at").alias("updated_at"),
    )


def incoming_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming side: every posting, title changed where ``seq % 4 = 0``."""
    p = postings(spark, sf_dir)
    return p.select(
        "seq",
        "external_id",
        F.when(F.col("seq") % 4 == 0, F.concat(F.col("title"), F.lit(" (v2)")))
        .otherwise(F.col("title"))
        .alias("title"),
        "company",
        "url",
        "source",
        "description_raw",
        "search_keyword",
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("salary"),
        "created_at",
    )


def scorer_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-like responses, one per posting, in nine shapes chosen by ``seq % 9``: plain
    object, object inside text, numeric string, negative, above 10, boolean score with a
    non-string summary, broken JSON, missing score with a blank summary, and an array
    wrapper with a fractional score. ``n = seq % 13``."""
    p = postings(spark, sf_dir)
    n = (F.col("seq") % 13).cast("string")
    s = F.replace(F.replace(F.col("title"), F.lit("\\"), F.lit("")), F.lit('"'), F.lit(""))
    obj = lambda score: F.concat(F.lit('{"score": '), score, F.lit(', "summary": "'), s, F.lit('"}'))
    k = F.col("seq") % 9
    resp = (
        F.when(k == 0, obj(n))
        .when(k == 1, F.concat(F.lit("Resultado: "), obj(n), F.lit(" fim")))
        .when(k == 2, obj(F.concat(F.lit('"'), n, F.lit('"'))))
        .when(k == 3, obj(F.concat(F.lit("-"), n)))
        .when(k == 4, obj(((F.col("seq") % 13) + 10).cast("string")))
        .when(k == 5, F.concat(F.lit('{"score": true, "summary": '), n, F.lit("}")))
        .when(k == 6, F.concat(F.lit('{"score": '), n, F.lit(', "summary": "'), s, F.lit('"')))
        .when(k == 7, F.concat(F.lit('{"summary": "   ", "other": '), n, F.lit(".75}")))
        .otherwise(F.concat(F.lit("Resposta: ["), obj(F.concat(n, F.lit(".75"))), F.lit("]")))
    )
    return p.select("seq", resp.alias("response"))
