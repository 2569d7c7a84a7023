"""Per-fetch operators on feed rows: checkpoint per source (A1), take-while cut at the
checkpoint (F7), first-seen dedupe inside a fetch (W2) and the per-fetch limit (W3).

A fetch is one (source, term) request; its rows carry an ascending ``order_key`` (the
feed's own order). No operator here puts a whole fetch into one task: the cut is a
map-side-combined ``min`` per fetch joined back (AQE broadcasts it when its runtime size
is under the broadcast threshold and keeps a shuffle join otherwise), and the limit is a
``row_number() <= N`` that Spark plans with a partial ``WindowGroupLimit`` before the
shuffle, so each fetch ships at most N rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoints(jobs: DataFrame, source: str = "source", ts: str = "created_at") -> DataFrame:
    """A1: latest event time per source (partial aggregate, one row per source)."""
    return jobs.groupBy(source).agg(F.max(ts).alias("checkpoint"))


def take_while(
    rows: DataFrame,
    fetch_cols: Sequence[str],
    order_key: Column,
    ckpts: DataFrame,
    ts: str = "created_at",
    source: str = "source",
    on: Sequence[str] | None = None,
) -> DataFrame:
    """keep, per fetch in feed order, the rows before the first one whose ``ts`` is at
    or before its source's checkpoint (later newer rows are dropped too). Sources without a
    checkpoint keep everything. ``on``: the columns that checkpoints are kept by, if more
    than the source."""
    by = list(on or [source])
    r = rows.withColumn("__ok", order_key).join(
        ckpts.select(*by, F.col("checkpoint").alias("__ckpt")), by, "left"
    )
    stops = (
        r.where(F.col(ts) <= F.col("__ckpt"))
        .groupBy(*fetch_cols)
        .agg(F.min("__ok").alias("__stop"))
    )
    # null-safe: a fetch without a term is a fetch like any other
    stops = stops.select(*[F.col(c).alias(f"__f{i}") for i, c in enumerate(fetch_cols)], "__stop")
    same = [r[c].eqNullSafe(stops[f"__f{i}"]) for i, c in enumerate(fetch_cols)]
    out = r.join(stops, same, "left").where(
        F.col("__stop").isNull() | (F.col("__ok") < F.col("__stop"))
    )
    return out.drop("__ok", "__ckpt", "__stop", *[f"__f{i}" for i in range(len(fetch_cols))])


def first_seen(rows: DataFrame, fetch_cols: Sequence[str], id_col: str, order_key: Column) -> DataFrame:
    """Drop repeats of an id inside one fetch, keeping its first row in feed order."""
    cols = rows.columns
    keyed = rows.withColumn("__ok", order_key)
    names = [*fetch_cols, id_col]
    # only keys and positions are grouped; wide rows are joined to them, not sorted
    firsts = keyed.groupBy(*names).agg(F.min("__ok").alias("__first"))
    firsts = firsts.select(*[F.col(c).alias(f"__f{i}") for i, c in enumerate(names)], "__first")
    same = [keyed[c].eqNullSafe(firsts[f"__f{i}"]) for i, c in enumerate(names)]
    return keyed.join(firsts, [*same, keyed["__ok"] == firsts["__first"]]).select(*cols)


def fetch_limit(
    rows: DataFrame, fetch_cols: Sequence[str], order_key: Column, n: int, pos_col: str = "pos"
) -> DataFrame:
    """The first ``n`` rows of each fetch, numbered ``pos`` from 1 in feed order."""
    if n < 1:
        raise ValueError("limit must be >= 1")
    w = Window.partitionBy(*fetch_cols).orderBy(order_key)
    return rows.withColumn(pos_col, F.row_number().over(w)).where(F.col(pos_col) <= n)
