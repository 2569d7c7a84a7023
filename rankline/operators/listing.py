"""Listing: status and score filters (F8, F9), ranking order and pages (T1, T2),
filtered totals (A2), preset view totals (A8) and score bands (X10)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankline.operators.rules import STATUSES

MAX_PAGE_SIZE = 100
DEFAULT_PAGE_SIZE = 50


@dataclass(frozen=True)
class JobFilter:
    status: Sequence[str] = field(default_factory=tuple)
    exclude_status: Sequence[str] = field(default_factory=tuple)
    min_score: int | None = None
    max_score: int | None = None


def _check_statuses(values: Sequence[str], name: str) -> list[str]:
    out = []
    for v in values or ():
        if v not in STATUSES:
            raise ValueError(f"Invalid {name} '{v}'. Valid values: {', '.join(STATUSES)}")
        out.append(v)
    return out


def filter_predicate(f: JobFilter) -> Column:
    """F8/F9 as one predicate (any-of / none-of statuses, inclusive score bounds which
    imply ``ai_score IS NOT NULL``). Raises ``ValueError`` like the reference's 422s."""
    st = _check_statuses(f.status, "status")
    ex = _check_statuses(f.exclude_status, "exclude_status")
    for b in (f.min_score, f.max_score):
        if b is not None and not 0 <= b <= 10:
            raise ValueError("score bounds must be between 0 and 10")
    if f.min_score is not None and f.max_score is not None and f.min_score > f.max_score:
        raise ValueError("Invalid score range: min_score cannot be greater than max_score")
    pred = F.lit(True)
    if st:
        pred = pred & F.col("status").isin(st)
    if ex:
        pred = pred & ~F.col("status").isin(ex)
    if f.min_score is not None or f.max_score is not None:
        pred = pred & F.col("ai_score").isNotNull()
    if f.min_score is not None:
        pred = pred & (F.col("ai_score") >= f.min_score)
    if f.max_score is not None:
        pred = pred & (F.col("ai_score") <= f.max_score)
    return pred


def rank_order() -> list[Column]:
    return [F.col("ai_score").desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc()]


def rank_page(
    jobs: DataFrame,
    f: JobFilter = JobFilter(),
    page: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    columns: Sequence[str] = ("id", "title", "status", "ai_score", "created_at"),
) -> DataFrame:
    """One page of the ranked listing with its ``rank`` (1-based over the whole
    filtered listing). Plans to a ``TakeOrderedAndProject`` of ``offset + size`` rows after
    a pruned scan; the rank is numbered on that page only."""
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"size must be between 1 and {MAX_PAGE_SIZE}")
    offset = (page - 1) * size
    cols = list(dict.fromkeys([*columns, "ai_score", "created_at", "id"]))
    rows = jobs.where(filter_predicate(f)).select(*cols).orderBy(*rank_order())
    rows = rows.offset(offset).limit(size) if offset else rows.limit(size)
    w = Window.orderBy(*rank_order())
    return rows.withColumn("rank", F.row_number().over(w) + F.lit(offset)).select(
        "rank", *columns
    )


def keyset_page(jobs: DataFrame, after: tuple | None, f: JobFilter = JobFilter(),
                size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Deep pages without an offset: rows strictly after ``(ai_score, created_at, id)`` of
    the last row seen, in ranking order."""
    d = jobs.where(filter_predicate(f))
    if after is not None:
        s, c, i = after
        # the key's time as a wall-time literal (a Python datetime literal would be an
        # instant, shifted by the session time zone)
        ts = F.lit(c.isoformat(sep=" ") if hasattr(c, "isoformat") else str(c)).cast("timestamp_ntz")
        key_lt = (F.col("created_at") < ts) | (
            (F.col("created_at") == ts) & (F.col("id") < F.lit(i))
        )
        if s is None:
            d = d.where(F.col("ai_score").isNull() & key_lt)
        else:
            d = d.where(
                F.col("ai_score").isNull()
                | (F.col("ai_score") < s)
                | ((F.col("ai_score") == s) & key_lt)
            )
    return d.orderBy(*rank_order()).limit(size)


def filtered_total(jobs: DataFrame, f: JobFilter = JobFilter()) -> int:
    """A2: count of the filtered rows, independent of paging."""
    return filtered_count(jobs, f).collect()[0]["total"]


def filtered_count(jobs: DataFrame, f: JobFilter = JobFilter()) -> DataFrame:
    """A2 as one row ``total``."""
    return jobs.where(filter_predicate(f)).agg(F.count(F.lit(1)).alias("total"))


# The six preset views of the dashboard.
PRESET_VIEWS = {
    "ready": JobFilter(status=("analyzed",), min_score=7),
    "analyze": JobFilter(status=("ready_for_ai",)),
    "adjust": JobFilter(status=("analyzed",), max_score=6),
    "review": JobFilter(status=("pending",)),
    "discarded": JobFilter(status=("discarded",)),
    "all": JobFilter(exclude_status=("discarded",)),
}


def view_totals(jobs: DataFrame) -> DataFrame:
    """Count of every preset view in one pass over ``status, ai_score`` only."""
    aggs = [
        F.count_if(filter_predicate(v)).cast("long").alias(f"{k}_total")
        for k, v in PRESET_VIEWS.items()
    ]
    return jobs.select("status", "ai_score").agg(*aggs)


# Score bands.
BAND_NONE, BAND_HIGH, BAND_MID, BAND_LOW = (
    "Não analisada", "Excelente match", "Bom potencial", "Baixa aderencia",
)


def score_band(score: Column) -> Column:
    """Null -> not analysed; >= 8 excellent; >= 6 good; else low."""
    return (
        F.when(score.isNull(), F.lit(BAND_NONE))
        .when(score >= 8, F.lit(BAND_HIGH))
        .when(score >= 6, F.lit(BAND_MID))
        .otherwise(F.lit(BAND_LOW))
    )
