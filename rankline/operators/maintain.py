"""Table maintenance: duplicate groups (A5), historical dedup (M7 with A6, A7, W1),
relevance cleanup (M4), manual status changes (M5) and the keyword backfill (S8).

All grouping is done with aggregates that combine map-side (``min_by``/``max_by``/
``count``), so a hot duplicate group costs one partial row per task, never one task
holding the whole group. The only list built per group is the distinct keyword list,
whose size is bounded by the number of search terms, not by the group size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankline.operators import rules

# Status priority when merging duplicates.
STATUS_PRIORITY = {"analyzed": 3, "discarded": 2, "ready_for_ai": 1, "pending": 0}

KEY_COLS = ["key_type", "source", "key_value"]


def status_priority(col: Column) -> Column:
    expr = None
    for s, p in STATUS_PRIORITY.items():
        expr = F.when(col == s, F.lit(p)) if expr is None else expr.when(col == s, F.lit(p))
    return expr.otherwise(F.lit(0))


def with_identity_key(jobs: DataFrame) -> DataFrame:
    """Duplicate key: ``('e', source, external_id)`` when the external id is set, else
    ``('u', source, url)`` (SQL uniqueness lets many null external ids coexist)."""
    has_ext = F.col("external_id").isNotNull()
    return jobs.withColumn("key_type", F.when(has_ext, F.lit("e")).otherwise(F.lit("u"))).withColumn(
        "key_value", F.when(has_ext, F.col("external_id")).otherwise(F.col("url"))
    )


def duplicate_groups(jobs: DataFrame) -> DataFrame:
    """A5: ``(key_type, source, key_value, n)`` for keys held by more than one row."""
    k = with_identity_key(jobs.select("source", "external_id", "url"))
    return k.groupBy(*KEY_COLS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


AI_FIELDS = ["status", "filter_reason", "ai_score", "ai_summary", "ai_analysis_at"]


def merge_keywords_by_key(k: DataFrame) -> DataFrame:
    """Per key, the group's keywords in ``(first_seen_at, id, position)`` order, blanks
    dropped, first occurrence kept. Reduced to one row per (key, keyword) before any list
    is built."""
    exploded = k.select(
        *KEY_COLS, "first_seen_at", "id", F.posexplode("search_keywords").alias("pos", "kw")
    ).where(F.col("kw").isNotNull() & (F.col("kw") != ""))
    firsts = exploded.groupBy(*KEY_COLS, "kw").agg(
        F.min(F.struct("first_seen_at", "id", "pos")).alias("o")
    )
    return firsts.groupBy(*KEY_COLS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "kw"))), lambda x: x["kw"]).alias(
            "merged_keywords"
        )
    )


def dedup_merge(jobs: DataFrame) -> DataFrame:
    """M7: one row per identity key. The survivor is the earliest row by
    ``(first_seen_at, id)`` (W1) and keeps its own posting fields; status, reason and AI
    fields come from the best row (A6: highest status priority, ties to the earliest);
    keywords are merged (A7). Singleton rows are returned unchanged."""
    # what the merge does is worked out on narrow rows of repeated keys only; the wide table is
    # joined once, by id, to one action per row of those keys
    k = with_identity_key(jobs).select(*KEY_COLS, "id", "first_seen_at", "search_keywords", *AI_FIELDS)
    repeated = duplicate_groups(jobs).withColumnsRenamed({c: f"__{c}" for c in KEY_COLS})
    k = k.join(repeated.drop("n"), [k[c].eqNullSafe(repeated[f"__{c}"]) for c in KEY_COLS], "left_semi")
    order_first = F.struct("first_seen_at", "id")
    order_best = F.struct((-status_priority(F.col("status"))).alias("p"), "first_seen_at", "id")
    groups = k.groupBy(*KEY_COLS).agg(
        F.count(F.lit(1)).alias("n_merged"),
        F.min(order_first)["id"].alias("__survivor"),
        F.min_by(F.struct(*AI_FIELDS), order_best).alias("__best"),
    )
    merged = merge_keywords_by_key(k).withColumnsRenamed({c: f"__{c}" for c in KEY_COLS})
    same = [groups[c].eqNullSafe(merged[f"__{c}"]) for c in KEY_COLS]
    groups = groups.join(merged, same, "left").drop(*[f"__{c}" for c in KEY_COLS])
    groups = groups.withColumnsRenamed({c: f"__{c}" for c in KEY_COLS})
    keep = F.col("id") == F.col("__survivor")
    actions = k.select(*KEY_COLS, "id").join(groups, [k[c].eqNullSafe(groups[f"__{c}"]) for c in KEY_COLS])
    # only the surviving row carries the merged fields
    actions = actions.select(
        F.col("id").alias("__id"), keep.alias("__keep"), "n_merged",
        F.when(keep, F.col("__best")).alias("__best"),
        F.when(keep, F.coalesce("merged_keywords", F.array().cast("array<string>"))).alias("__keywords"),
    )
    out = jobs.join(actions, F.col("id") == F.col("__id"), "left").where(F.coalesce("__keep", F.lit(True)))
    alone = F.col("__id").isNull()
    cols = []
    for c in jobs.columns:
        if c in AI_FIELDS:
            cols.append(F.when(alone, F.col(c)).otherwise(F.col(f"__best.{c}")).alias(c))
        elif c == "search_keywords":
            cols.append(F.when(alone, F.col(c)).otherwise(F.col("__keywords")).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols, F.coalesce("n_merged", F.lit(1)).alias("n_merged"))


def cleanup_flags(
    jobs: DataFrame, include: Sequence[str], threshold: int = 3
) -> DataFrame:
    """M4 decision per row: non-analysed rows whose distinct casefolded include keywords with
    a whole-word hit number fewer than ``threshold`` are deleted. An empty keyword list
    aborts (it would delete everything)."""
    kws = list(dict.fromkeys(k.casefold() for k in include))
    if not kws:
        raise ValueError("include_keywords is empty: cleanup aborted to avoid mass deletion")
    if threshold < 1:
        raise ValueError("threshold must be >= 1")
    g = rules.gate_columns(jobs, kws, threshold=threshold)
    candidate = F.col("status") != "analyzed"
    return g.withColumn("match_count", F.when(candidate, F.col("match_count"))).withColumn(
        "deleted", candidate & ~F.col("passes")
    ).drop("passes")


def cleanup(jobs: DataFrame, include: Sequence[str], threshold: int = 3) -> DataFrame:
    """M4 + J5: the table without the deleted rows."""
    return cleanup_flags(jobs, include, threshold).where(~F.col("deleted")).drop(
        "deleted", "match_count"
    )


def cleanup_counters(flags: DataFrame) -> DataFrame:
    """Deleted / kept counts of a cleanup (over ``cleanup_flags`` output; analysed rows
    are neither)."""
    cand = F.col("status") != "analyzed"
    return flags.agg(
        F.count_if(F.col("deleted")).alias("deleted"),
        F.count_if(cand & ~F.col("deleted")).alias("kept"),
    )


MANUAL_STATUSES = ("ready_for_ai", "discarded")


def manual_status(jobs: DataFrame, changes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """M5: apply ``changes(id, status)``. Only ``ready_for_ai``/``discarded`` are accepted;
    ``updated_at`` moves, ``filter_reason`` is kept. Returns ``(new_jobs, outcomes)`` where
    outcomes has ``id, requested, outcome`` with outcome ``updated``, ``invalid_status`` or
    ``not_found``. ``changes`` must hold at most one row per id; it is refused otherwise."""
    if changes.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("changes holds several rows for one id")
    req = changes.select("id", F.col("status").alias("requested"))
    known = jobs.select("id", F.lit(True).alias("__known"))
    outcomes = req.join(known, "id", "left").select(
        "id",
        "requested",
        F.when(~F.col("requested").isin(*MANUAL_STATUSES), F.lit("invalid_status"))
        .when(F.col("__known").isNull(), F.lit("not_found"))
        .otherwise(F.lit("updated"))
        .alias("outcome"),
    )
    valid = req.where(F.col("requested").isin(*MANUAL_STATUSES))
    j = jobs.join(valid, "id", "left")
    hit = F.col("requested").isNotNull()
    new_jobs = j.withColumn("status", F.when(hit, F.col("requested")).otherwise(F.col("status"))) \
        .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at"))) \
        .drop("requested").select(*jobs.columns)
    return new_jobs, outcomes


def backfill_keywords(df: DataFrame, col: str = "search_keyword") -> DataFrame:
    """Legacy single keyword -> ``search_keywords`` list (``[kw]`` or ``[]``)."""
    kw = F.col(col)
    return df.withColumn(
        "search_keywords",
        F.when(kw.isNotNull() & (kw != ""), F.array(kw)).otherwise(F.array().cast("array<string>")),
    ).drop(col)


def downgrade_keywords(df: DataFrame) -> DataFrame:
    """S8 inverse: first keyword or null."""
    return df.withColumn("search_keyword", F.get(F.col("search_keywords"), 0)).drop(
        "search_keywords"
    )
