"""Helpers shared by the operators: the shared work folder, tables that cut lineage, joins
with a side of checked size, and connected components over edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.session import ensure_checkpoint_dir

# Rows of a few longs: about 15 MB as a broadcast table.
BROADCAST_ROWS = 150_000
WORD_BREAK = r"[ \t\n\x0B\f\r]+"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared checkpoint folder and reads it back."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder for one table or file set in the folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
               limit: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join that broadcasts ``small`` (a written table) only if it has at most
    ``limit`` rows, and is a shuffle join, whose skewed parts Spark splits, beyond it."""
    few = small.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def row_key(text: str = "text") -> list[Column]:
    """Names a row by id and text, so that rows that repeat an id stay apart."""
    return [F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.xxhash64(F.lit(7), text).alias("__th")]


WHOLE_KEY = ["__id", "__th", "__none"]


def whole_key() -> list[Column]:
    """``row_key`` and whether the row has no id, so that no id is not taken for -1."""
    return [*row_key(), F.isnull("doc_id").alias("__none")]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def without(docs: DataFrame, dropped: DataFrame, **more: Column) -> DataFrame:
    """``docs`` without the rows whose ``whole_key``, and further key columns that are never
    null, are in the written table ``dropped``."""
    return by_key(docs, dropped, "left_anti", **more)


def by_key(docs: DataFrame, rows: DataFrame, how: str, **more: Column) -> DataFrame:
    """``docs`` joined (``left_semi`` or ``left_anti``) with the keys of the written table ``rows``."""
    names = [*WHOLE_KEY, *more]
    own = free_names(docs, *names)
    left = docs.withColumns(dict(zip(own, [*whole_key(), *more.values()])))
    right = rows.select(*[F.col(n).alias(o) for n, o in zip(names, own)]).distinct()
    return small_join(left, right, own, how).select(*own_columns(docs))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (u, v): ``comp`` is the smallest node
    reachable. Large-star and small-star steps, each a grouped minimum joined back, until
    no edge changes; the number of rounds grows with the logarithm of the path lengths."""
    e = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = table(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = table(small.union(low.select("u", "m")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .where("u <> v").distinct(), "edges")
        was, mark = mark, _mark(e)
        if mark == was:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
