"""Ingest: payload validation (N9, N10, M8), two-key identity match (J1), change detection
(J2), the upsert outcomes (M1-M3) and their statistics (A3, A4, A10).

Payloads of a batch are applied in ``seq`` order, and later ones see earlier effects.
That order only matters where payloads interact. Chains, groups of payloads that can only reach
one row, run natively (joins, lags and column rules); of the rest, identity components that a
task can hold are folded in order, on narrow columns (text rules are computed natively
before, so Python does no text work), and larger ones are settled as sets by ``settle``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from rankline.session import cut_lineage
from rankline.functions import text as TX
from rankline.operators import rules, settle

COMPARED = ["title", "company", "url", "description_raw", "location", "salary", "created_at"]
PAYLOAD_COLS = ["seq", "external_id", "title", "company", "url", "source", "description_raw",
                "search_keyword", "location", "salary", "created_at"]
OUTCOMES = ["inserted", "updated", "skipped", "discarded", "failed"]
GATE_THRESHOLD = 3
LARGEST = 20_000  # payloads and rows of a component that one task folds
LOOKUP = 250_000  # payloads whose key hashes or row ids (8 bytes each) are broadcast
# Length limits enforced by the store (strings over them fail the payload alone).
MAX_LEN = {"external_id": 255, "title": 255, "company": 255, "location": 255, "salary": 255,
           "source": 50}


# ------------------------------------------------------------------ N9/N10/M8
def validate(payloads: DataFrame) -> DataFrame:
    """Strip every string, lower-case ``source``, blank optional strings to null and
    ``description_raw`` to ``""``; adds ``error`` (null when valid)."""
    d = payloads
    for c in ["external_id", "title", "company", "url", "source", "description_raw",
              "search_keyword", "location", "salary"]:
        d = d.withColumn(c, TX.py_strip(F.col(c)))
    d = d.withColumn("source", F.lower("source"))
    d = d.withColumn("description_raw", F.coalesce("description_raw", F.lit("")))
    for c in ["external_id", "search_keyword"]:
        d = d.withColumn(c, F.when(F.col(c) != "", F.col(c)))
    err = None
    for c in ["title", "company", "url", "source"]:
        cond = F.col(c).isNull() | (F.col(c) == "")
        e = F.lit(f"{c} cannot be empty")
        err = F.when(cond, e) if err is None else err.when(cond, e)
    for c, n in MAX_LEN.items():
        err = err.when(F.length(c) > n, F.lit(f"{c} longer than {n}"))
    return d.withColumn("error", err)


# ------------------------------------------------------------------ J1
def rows_of(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored rows with the ``ids`` (distinct, column ``id``). At most ``LOOKUP`` ids are
    broadcast, so the stored rows are scanned but not shuffled; more are joined by a shuffle."""
    ids = cut_lineage(ids)
    few = ids.limit(LOOKUP + 1).count() <= LOOKUP
    return stored.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _holders(stored: DataFrame, keys: Sequence[str], wanted: DataFrame, few: bool) -> DataFrame:
    """Key columns and id of the stored rows that may hold one of the ``wanted`` keys: for few
    payloads only those with the hash of one of them (8 bytes a payload are broadcast), so no
    stored row is shuffled but the ones found."""
    rows = stored.where(F.col(keys[-1]).isNotNull()).select(*keys, "id")
    if not few:
        return rows
    hashes = wanted.where(F.col(keys[-1]).isNotNull()).select(F.xxhash64(*keys).alias("__h")).distinct()
    return rows.withColumn("__h", F.xxhash64(*keys)).join(F.broadcast(hashes), "__h", "left_semi").drop("__h")


def identity_match(stored: DataFrame, payloads: DataFrame) -> DataFrame:
    """``seq, e_id, u_id, matched_id, match_kind``. By ``(source, external_id)`` when
    the id is set, else (or when not found) by ``(source, url)``. Works on key columns only;
    stored keys are unique, so each payload matches at most one row per key. Payloads without
    an id are not joined by it, so they do not pile into one partition."""
    p = cut_lineage(payloads.select("seq", "source", "external_id", "url"))
    few = p.limit(LOOKUP + 1).count() <= LOOKUP
    st_e = _holders(stored, ["source", "external_id"], p, few).withColumnRenamed("id", "e_id")
    st_u = _holders(stored, ["source", "url"], p, few).withColumnRenamed("id", "u_id")
    named = p.where(F.col("external_id").isNotNull()).join(st_e, ["source", "external_id"], "left")
    m = named.unionByName(p.where(F.col("external_id").isNull()).withColumn("e_id", F.lit(None).cast("long")))
    m = m.join(st_u, ["source", "url"], "left")
    return m.select(
        "seq", "source", "external_id", "url", "e_id", "u_id",
        F.coalesce("e_id", "u_id").alias("matched_id"),
        F.when(F.col("e_id").isNotNull(), F.lit("external_id"))
        .when(F.col("u_id").isNotNull(), F.lit("url"))
        .alias("match_kind"),
    )


def left_by(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; rows without a key are spread by their ``seq`` instead of meeting
    in the one task of the null key."""
    none = F.col(key).isNull()
    df = df.withColumns({"__at": F.coalesce(F.col(key), F.col("seq")), "__none": none})
    other = other.withColumnRenamed(key, "__at").withColumn("__none", F.lit(False))
    return df.join(other, ["__at", "__none"], "left").drop("__at", "__none")


# ------------------------------------------------------------------ J2
def change_columns(joined: DataFrame, cur: str = "cur") -> DataFrame:
    """J2 on a payload row joined with its stored row (struct ``cur``): ``changed_fields``
    (compared fields that differ, null-safe, in field order), ``keyword_new`` and
    ``changed``. Timestamps are UTC on both sides."""
    diffs = [F.when(~F.col(c).eqNullSafe(F.col(f"{cur}.{c}")), F.lit(c)) for c in COMPARED]
    kw = F.col("search_keyword")
    kw_new = kw.isNotNull() & ~F.coalesce(F.array_contains(F.col(f"{cur}.search_keywords"), kw),
                                          F.lit(False))
    d = joined.withColumn("changed_fields", F.filter(F.array(*diffs), lambda x: x.isNotNull()))
    return d.withColumn("keyword_new", kw_new).withColumn(
        "changed", F.col("keyword_new") | (F.size("changed_fields") > 0)
    )


# ------------------------------------------------------------------ chains vs fold
def chain_flags(matches: DataFrame, ext_chains: bool = True) -> DataFrame:
    """Splits payloads into *chains* and the rest.

    A chain is the group of payloads with one ``(source, url)`` whose lookups can only ever
    reach one row: its ``target`` stored row (found by that url, or by every payload's
    external id when no row has the url) or, with no target, the row its first passing
    payload inserts. Conditions: no payload of the group reaches another stored row, every
    payload sharing an external id with the group is in it, and no payload outside the
    group touches the target. ``single`` marks chains of one payload. All from grouped
    counts, so a hot key is one partial row per task."""
    m = matches
    has_ext = F.col("external_id").isNotNull()
    n_e = m.where(has_ext).groupBy("source", "external_id").agg(F.count(F.lit(1)).alias("n_e"))
    n_eg = m.where(has_ext).groupBy("source", "url", "external_id").agg(
        F.count(F.lit(1)).alias("n_eg"))
    touch = (
        m.select(F.col("e_id").alias("sid")).where(F.col("sid").isNotNull())
        .unionByName(
            m.where(F.col("u_id").isNotNull()
                    & (F.col("e_id").isNull() | (F.col("e_id") != F.col("u_id"))))
            .select(F.col("u_id").alias("sid"))
        )
        .groupBy("sid").agg(F.count(F.lit(1)).alias("n_touch"))
    )
    # payloads without an id are not joined by it: they would all meet under one null key
    x = m.where(has_ext).join(n_e, ["source", "external_id"]).join(n_eg, ["source", "url", "external_id"])
    x = x.unionByName(m.where(~has_ext), allowMissingColumns=True)
    g = x.groupBy("source", "url").agg(
        F.count(F.lit(1)).alias("n_g"),
        F.max("u_id").alias("t_u"),
        F.count_if(F.col("e_id").isNotNull()
                   & (F.col("u_id").isNull() | (F.col("e_id") != F.col("u_id")))).alias("n_e_off"),
        F.count_if(F.col("e_id").isNull()).alias("n_e_null"),
        F.min("e_id").alias("e_min"),
        F.max("e_id").alias("e_max"),
        F.count_if(has_ext & (F.col("n_e") != F.col("n_eg"))).alias("n_ext_open"),
    )
    target = F.when(F.col("t_u").isNotNull(), F.col("t_u")).otherwise(F.col("e_min"))
    shape_ok = (F.col("n_ext_open") == 0) & (
        (F.col("t_u").isNotNull() & (F.col("n_e_off") == 0))
        | (F.col("t_u").isNull()
           & ((F.col("n_e_null") == F.col("n_g"))
              | ((F.col("n_e_null") == 0) & (F.col("e_min") == F.col("e_max")))))
    )
    g = g.withColumn("target", target).join(touch, F.col("target") == F.col("sid"), "left")
    chain = shape_ok & (F.col("target").isNull() | (F.col("n_touch") == F.col("n_g")))
    g = g.select("source", "url", F.col("target"), chain.alias("chain"), "n_g")
    out = m.join(g, ["source", "url"]).withColumn(
        "chain_key", F.concat_ws("\u0001", F.lit("u"), "source", "url"))
    out = out.withColumn("single", F.col("chain") & (F.col("n_g") == 1))
    # the second shape counts over the first in four places: one plan of both has 28 stages
    return _ext_chains(cut_lineage(out)) if ext_chains else out


def _ext_chains(f: DataFrame) -> DataFrame:
    """Second chain shape, for payloads left out of url chains: all payloads of one
    ``(source, external_id)`` that reach one row by that id (the stored row holding it, or
    the row the first passing payload inserts), where no payload's url reaches another
    row and no payload outside the group shares a url with it or touches the row. Updates
    may move the row's url, but nobody else ever looks those urls up."""
    rest = f.where(~F.col("chain") & F.col("external_id").isNotNull())
    n_u = f.groupBy("source", "url").agg(F.count(F.lit(1)).alias("n_u"))
    n_ue = rest.groupBy("source", "external_id", "url").agg(F.count(F.lit(1)).alias("n_ue"))
    touch = (
        f.select(F.col("e_id").alias("sid")).where(F.col("sid").isNotNull())
        .unionByName(
            f.where(F.col("u_id").isNotNull()
                    & (F.col("e_id").isNull() | (F.col("e_id") != F.col("u_id"))))
            .select(F.col("u_id").alias("sid"))
        )
        .groupBy("sid").agg(F.count(F.lit(1)).alias("n_touch"))
    )
    x = rest.join(n_u, ["source", "url"]).join(n_ue, ["source", "external_id", "url"])
    g = x.groupBy("source", "external_id").agg(
        F.count(F.lit(1)).alias("n_ge"),
        F.min("e_id").alias("t_e"),
        F.max("e_id").alias("t_e_max"),
        F.count_if(F.col("e_id").isNull()).alias("n_e_null"),
        F.count_if(F.col("n_u") != F.col("n_ue")).alias("n_url_open"),
        F.count_if(F.col("u_id").isNotNull()).alias("n_u_hit"),
        F.min("u_id").alias("u_min"),
        F.max("u_id").alias("u_max"),
    )
    same_target = (F.col("n_e_null") == F.col("n_ge")) | (
        (F.col("n_e_null") == 0) & (F.col("t_e") == F.col("t_e_max")))
    # every url either reaches no stored row or the group's own target
    urls_ok = (F.col("n_u_hit") == 0) | (
        F.col("t_e").isNotNull() & (F.col("u_min") == F.col("t_e")) & (F.col("u_max") == F.col("t_e")))
    g = g.join(touch, F.col("t_e") == F.col("sid"), "left")
    ok = (same_target & urls_ok & (F.col("n_url_open") == 0)
          & (F.col("t_e").isNull() | (F.col("n_touch") == F.col("n_ge"))))
    g = g.where(ok).select("source", "external_id", F.col("t_e").alias("__t"),
                           F.col("n_ge").alias("__n"), F.lit(True).alias("__ext_chain"))
    out = f.where(F.col("external_id").isNotNull()).join(g, ["source", "external_id"], "left")
    out = out.unionByName(f.where(F.col("external_id").isNull()), allowMissingColumns=True)
    is_e = F.coalesce(F.col("__ext_chain"), F.lit(False)) & ~F.col("chain")
    return (
        out.withColumn("target", F.when(is_e, F.col("__t")).otherwise(F.col("target")))
        .withColumn("n_g", F.when(is_e, F.col("__n")).otherwise(F.col("n_g")))
        .withColumn("chain_key", F.when(is_e, F.concat_ws("\u0001", F.lit("e"), "source", "external_id"))
                    .otherwise(F.col("chain_key")))
        .withColumn("chain", F.col("chain") | is_e)
        .drop("__t", "__n", "__ext_chain")
    )


def ordered_prev(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``lag(value)`` within ``keys`` ordered by ``order`` without putting a hot key in one
    task: rows are range-partitioned on ``(keys, order)`` (a hot key spreads over several
    partitions), lagged inside each (partition, key) chunk, and a chunk's first row takes the
    last value of the key's previous chunk (a window over chunks: at most one row per
    partition per key). Adds ``__prev`` and ``__first`` (first row of its key)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # partition ids must not change on recomputation
    r = cut_lineage(df.repartitionByRange(n, *keys, order).withColumn("__pid", F.spark_partition_id()))
    w = Window.partitionBy("__pid", *keys).orderBy(order)
    r = r.withColumn("__lag", F.lag(value).over(w)).withColumn("__rn", F.row_number().over(w))
    chunks = r.groupBy("__pid", *keys).agg(F.max_by(value, order).alias("__last"))
    wc = Window.partitionBy(*keys).orderBy("__pid")
    chunks = chunks.select(
        "__pid", *keys,
        F.lag("__last").over(wc).alias("__chunk_prev"),
        F.lag("__pid").over(wc).isNotNull().alias("__has_prev_chunk"),
    )
    r = r.join(chunks, ["__pid", *keys])
    first_in_chunk = F.col("__rn") == 1
    return r.select(
        *df.columns,
        F.when(first_in_chunk, F.col("__chunk_prev")).otherwise(F.col("__lag")).alias("__prev"),
        (first_in_chunk & ~F.col("__has_prev_chunk")).alias("__first"),
    )


def payload_rules(payloads: DataFrame, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Text rules of each payload, computed once natively: gate (``passes``; include list
    deduped as given, threshold 3) and classification (``rule_status``, ``rule_reason``)."""
    g = rules.gate_columns(payloads, list(dict.fromkeys(include)), threshold=GATE_THRESHOLD)
    return rules.classify_columns(g, include, exclude)


def chain_path(
    stored: DataFrame,
    payloads: DataFrame,
    flags: DataFrame,
    as_of: Column,
    include: Sequence[str],
    exclude: Sequence[str],
    singles_only: bool = False,
) -> DataFrame:
    """M1-M3 for chain payloads, set-based. Within a chain the state before a payload is
    the previous payload's fields (an update writes them, a skip means they were equal), or
    the target row for the first one; a keyword is new at its first occurrence among the
    applied payloads; with no target, payloads before the first one passing the gate are
    discarded and that one inserts. Text rules run only where needed (gate for chains
    without a target, classification for the chain's last writer). Chains of one payload
    (most of them) need no ordering and no grouping: they are computed row by row."""
    chain = flags.where("chain").select("seq", "target", "n_g", "chain_key")
    wide = rows_of(stored, chain.select(F.col("target").alias("id")).where("id is not null").distinct())
    cur = wide.select(F.col("id").alias("target"), F.struct(*stored.columns).alias("cur"))
    c = payloads.join(chain, "seq").withColumn("__f", F.struct(*COMPARED))
    ftype = c.schema["__f"].dataType
    one = (c.where(F.col("n_g") == 1).withColumn("__prev", F.lit(None).cast(ftype))
           .withColumn("__first", F.lit(True)))
    out = _chain_part(one, cur, as_of, include, exclude, single=True)
    if not singles_only:
        many = ordered_prev(c.where(F.col("n_g") > 1), ["chain_key"], "seq", "__f")
        out = out.unionByName(_chain_part(many, cur, as_of, include, exclude, single=False))
    return out


def _chain_part(
    c: DataFrame, cur: DataFrame, as_of: Column, include, exclude, single: bool
) -> DataFrame:
    keys = ["chain_key"]
    c = left_by(c, cur, "target")
    has_t = F.col("target").isNotNull()
    # texts are folded once a row, in a column of their own, and only where a rule asks
    gate = rules.gate_passes(list(dict.fromkeys(include)), GATE_THRESHOLD, text="__text")
    kw = F.col("search_keyword")
    if single:
        c = c.withColumn("__text", F.when(~has_t, rules.content_col()))
        c = c.withColumn("f_seq", F.when(~has_t & gate, F.col("seq"))).drop("__text")
    else:
        firsts = c.where(~has_t).withColumn("__text", rules.content_col()).groupBy(*keys).agg(
            F.min(F.when(gate, F.col("seq"))).alias("f_seq"))
        c = c.join(firsts, keys, "left")
    applied = has_t | (F.col("f_seq").isNotNull() & (F.col("seq") >= F.col("f_seq")))
    if single:
        c = c.withColumn("kw_first", F.when(applied & kw.isNotNull(), F.col("seq")))
    else:
        kwf = c.where(applied & kw.isNotNull()).groupBy(*keys, "search_keyword").agg(
            F.min("seq").alias("kw_first"))
        c = c.join(kwf, [*keys, "search_keyword"], "left")
    in_base = F.coalesce(F.array_contains(F.col("cur.search_keywords"), kw), F.lit(False))
    kw_new = kw.isNotNull() & ~in_base & (F.col("kw_first") == F.col("seq"))
    cur_f = F.struct(*[F.col(f"cur.{x}").alias(x) for x in COMPARED])
    prev = F.when(F.col("__first"), cur_f).otherwise(F.col("__prev"))
    changed = kw_new | ~F.col("__f").eqNullSafe(prev)
    upd_or_skip = F.when(changed, F.lit("updated")).otherwise(F.lit("skipped"))
    outcome = F.when(has_t, upd_or_skip).when(
        F.col("f_seq").isNull() | (F.col("seq") < F.col("f_seq")), F.lit("discarded")
    ).when(F.col("seq") == F.col("f_seq"), F.lit("inserted")).otherwise(upd_or_skip)
    c = c.withColumn("outcome", outcome).withColumn("kw_new", kw_new)

    writer = F.col("outcome").isin("inserted", "updated")
    w = F.struct("seq", "external_id", *COMPARED)
    if single:
        r = c.withColumn("w", F.when(writer, w)).withColumn(
            "f_ext", F.when(F.col("outcome") == "inserted", F.col("external_id"))
        ).withColumn("c0", F.col("cur")).withColumn(
            "new_kws", F.when(F.col("kw_new"), F.array(kw)))
    else:
        c = cut_lineage(c)  # feeds two aggregates and the join below
        fin = c.groupBy(*keys).agg(
            F.max_by(w, F.when(writer, F.col("seq"))).alias("w"),
            F.min_by("external_id", F.when(F.col("outcome") == "inserted", F.col("seq"))).alias("f_ext"),
            F.first("cur", ignorenulls=True).alias("c0"),
        )
        newkw = c.where("kw_new").groupBy(*keys).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "search_keyword"))),
                        lambda x: x["search_keyword"]).alias("new_kws"))
        r = c.join(fin.join(newkw, keys, "left"), keys)
    c_analysed = F.coalesce(F.col("c0.status") == "analyzed", F.lit(False))
    has_w = F.col("w").isNotNull()
    disc = F.col("outcome") == "discarded"
    asked = ~disc & has_w & ~c_analysed
    r = r.withColumn("__text", F.when(asked, rules.content_col("w.title", "w.description_raw")))
    status, reason = rules.classification(include, exclude, text="__text")
    kw_arr = F.when(kw.isNotNull(), F.array(kw)).otherwise(F.array().cast("array<string>"))
    fin_kws = F.concat(F.coalesce(F.col("c0.search_keywords"), F.array().cast("array<string>")),
                       F.coalesce(F.col("new_kws"), F.array().cast("array<string>")))
    cols = [
        F.col("seq"), F.col("outcome"), F.col("target").alias("matched_id"), kw.alias("term"),
        F.when(has_t, F.concat(F.lit("s:"), F.col("target").cast("string")))
        .when(~disc, F.concat(F.lit("p:"), F.col("f_seq").cast("string"))).alias("row_ref"),
    ]
    cols += [
        F.when(disc, F.col(x)).when(has_w, F.col(f"w.{x}")).otherwise(F.col(f"c0.{x}")).alias(x)
        for x in COMPARED
    ]
    cols += [
        F.when(has_t, F.col("cur.external_id")).when(disc, F.col("external_id"))
        .otherwise(F.col("f_ext")).alias("external_id"),
        F.col("source"),
        F.when(disc, kw_arr).otherwise(fin_kws).alias("search_keywords"),
        F.when(disc, F.lit(None).cast("string")).when(has_w & ~c_analysed, status)
        .otherwise(F.col("c0.status")).alias("status"),
        F.when(disc, F.lit(None).cast("string")).when(has_w & ~c_analysed, reason)
        .otherwise(F.col("c0.filter_reason")).alias("filter_reason"),
    ]
    cols += [F.col(f"cur.{x}").alias(x) for x in ["ai_score", "ai_summary", "ai_analysis_at"]]
    cols += [
        F.when(has_t, F.col("cur.first_seen_at")).when(~disc, as_of).alias("first_seen_at"),
        F.when(disc, F.lit(None).cast("timestamp_ntz")).when(has_w, as_of)
        .otherwise(F.col("cur.last_seen_at")).alias("last_seen_at"),
        F.when(disc, F.lit(None).cast("timestamp_ntz")).when(has_w, as_of)
        .otherwise(F.col("cur.updated_at")).alias("updated_at"),
    ]
    return r.select(*cols)


# ------------------------------------------------------------------ components + fold
def components(edges: DataFrame) -> DataFrame:
    """Connected components of a bipartite graph ``edges(node, key)``: returns
    ``node, label`` with ``label`` = least node of its component. Min-label propagation
    through the keys: the least label at a key goes to every node of it and to the node that
    each of them was labelled with (else a region hears of a smaller label one hop a round),
    then each label is replaced by its own label. So the rounds grow with the logarithm of the
    longest path; every round is checkpointed to the shared checkpoint
    folder (lineage stays short and a lost executor recomputes one round). Ends when no
    label changes, whatever the number of rounds."""
    # read twice a round: as many parts as its rows fill, not as the tables behind it had
    edges = cut_lineage(edges.hint("rebalance"))
    lab = cut_lineage(edges.groupBy("node").agg(F.min("node").alias("label")))
    while True:
        at = edges.join(lab, "node")
        key_lab = at.groupBy("key").agg(F.min("label").alias("kl"))
        near = at.join(key_lab, "key").select(F.explode(F.array("node", "label")).alias("node"), "kl")
        near = cut_lineage(near.groupBy("node").agg(F.min("kl").alias("label")))
        far = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut_lineage(near.join(far, "label").select("node", F.least("label", "far").alias("label")))
        changed = new.join(lab.withColumnRenamed("label", "was"), "node").where("label <> was")
        lab = new
        if not changed.limit(1).count():
            return lab


FOLD_SCHEMA = T.StructType([
    T.StructField("comp", T.LongType()),
    T.StructField("seq", T.LongType()),          # payload seq (null for untouched rows)
    T.StructField("outcome", T.StringType()),
    T.StructField("row_key", T.LongType()),      # stored id, or -seq - 1 of the inserting payload
    T.StructField("src_seq", T.LongType()),      # payload whose values the row now holds
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("filter_reason", T.StringType()),
    T.StructField("first_seen_new", T.BooleanType()),
    T.StructField("touched", T.BooleanType()),
    T.StructField("row_ext", T.StringType()),   # external id of the row (kept by updates)
])


def _fold_component(pdf: pd.DataFrame) -> list[dict]:
    """Exact sequential semantics for one component. Rows are stored rows (kind 's') and
    payloads (kind 'p'); compared fields arrive as their text values."""
    comp = int(pdf["comp"].iloc[0])
    rows: dict[int, dict] = {}
    by_e: dict[tuple, int] = {}
    by_u: dict[tuple, int] = {}
    for r in pdf[pdf["kind"] == "s"].itertuples(index=False):
        k = int(r.id)
        rows[k] = dict(source=r.source, ext=r.external_id, url=r.url, fp=list(r.fp),
                       kws=list(r.keywords) if r.keywords is not None else [], status=r.status,
                       reason=r.filter_reason, src=None, new=False, touched=False)
        if r.external_id is not None:
            by_e[(r.source, r.external_id)] = k
        by_u[(r.source, r.url)] = k
    out = []
    pays = pdf[pdf["kind"] == "p"].sort_values("seq")
    for r in pays.itertuples(index=False):
        seq = int(r.seq)
        key = None
        if r.external_id is not None:
            key = by_e.get((r.source, r.external_id))
        if key is None:
            key = by_u.get((r.source, r.url))
        fp = list(r.fp)
        if key is not None:
            row = rows[key]
            kw_new = r.search_keyword is not None and r.search_keyword not in row["kws"]
            changed = kw_new or fp != row["fp"]
            if not changed:
                out.append((comp, seq, "skipped", key))
                continue
            owner = by_u.get((r.source, r.url))
            if owner is not None and owner != key:
                out.append((comp, seq, "failed", key))  # unique (source, url) conflict
                continue
            if (row["source"], row["url"]) in by_u and by_u[(row["source"], row["url"])] == key:
                del by_u[(row["source"], row["url"])]
            row["url"] = r.url
            by_u[(r.source, r.url)] = key
            row["fp"] = fp
            if kw_new:
                row["kws"] = [*row["kws"], r.search_keyword]
            if row["status"] != "analyzed":
                row["status"], row["reason"] = r.rule_status, r.rule_reason
            row["src"] = seq
            row["touched"] = True
            out.append((comp, seq, "updated", key))
        elif bool(r.passes):
            key = -seq - 1
            rows[key] = dict(source=r.source, ext=r.external_id, url=r.url, fp=fp,
                             kws=[r.search_keyword] if r.search_keyword is not None else [],
                             status=r.rule_status, reason=r.rule_reason, src=seq, new=True,
                             touched=True)
            if r.external_id is not None:
                by_e[(r.source, r.external_id)] = key
            by_u[(r.source, r.url)] = key
            out.append((comp, seq, "inserted", key))
        else:
            out.append((comp, seq, "discarded", None))
    recs = [
        dict(comp=comp, seq=s, outcome=o, row_key=k, src_seq=None, keywords=None, status=None,
             filter_reason=None, first_seen_new=None, touched=None, row_ext=None)
        for comp, s, o, k in out
    ]
    for k, row in rows.items():
        recs.append(dict(comp=comp, seq=None, outcome="row", row_key=k, src_seq=row["src"],
                         keywords=row["kws"], status=row["status"], filter_reason=row["reason"],
                         first_seen_new=row["new"], touched=row["touched"], row_ext=row["ext"]))
    return recs


def _fingerprint() -> Column:
    """A 128-bit hash of the compared fields: neither a round nor the fold sees their texts."""
    return settle.hash128([F.col(c) for c in COMPARED])


def folded_empty(spark) -> DataFrame:
    return spark.createDataFrame([], FOLD_SCHEMA)


def fold_path(stored: DataFrame, payloads: DataFrame, flags: DataFrame) -> DataFrame:
    """W4 for the payloads outside chains, as ``FOLD_SCHEMA`` rows. Identity components of at
    most ``LARGEST`` payloads and rows are folded in order, each in one task. Larger ones are
    settled as sets over many tasks; a component of which some payloads still change after
    the last round is folded in order too."""
    multi = flags.where(~F.col("chain")).select("seq", "e_id", "u_id")
    if multi.limit(1).count() == 0:
        return folded_empty(stored.sparkSession)
    p = cut_lineage(payloads.join(multi, "seq").select(
        "seq", "source", "external_id", "url", "e_id", "u_id", F.col("search_keyword").alias("kw"),
        "passes", "rule_status", "rule_reason", _fingerprint().alias("fp")))
    touched = p.select(F.explode(F.array("e_id", "u_id")).alias("id")).where("id is not null").distinct()
    rows = cut_lineage(rows_of(stored, touched).select(
        "id", "source", "external_id", "url", _fingerprint().alias("fp"),
        F.col("search_keywords").alias("keywords"), "status", "filter_reason"))
    label = _labels(p, rows)
    p = p.join(label.where("node % 2 = 1").select(((F.col("node") - 1) / 2).cast("long").alias("seq"), "comp"), "seq")
    rows = rows.join(label.where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("id"), "comp"), "id")
    large = cut_lineage(label.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST).select("comp"))
    if large.isEmpty():
        return cut_lineage(_folded_in_order(p, rows))
    p, rows = cut_lineage(p), cut_lineage(rows)
    g, done = settle.settled(cut_lineage(p.join(large, "comp", "left_semi")), cut_lineage(rows.join(large, "comp", "left_semi")))
    calm = large if done else cut_lineage(large.join(g.where("moved").select("comp").distinct(), "comp", "left_anti"))
    sets = _folded(g.join(calm, "comp", "left_semi"), rows.join(calm, "comp", "left_semi"))
    return cut_lineage(sets.unionByName(_folded_in_order(p.join(calm, "comp", "left_anti"), rows.join(calm, "comp", "left_anti"))))


def _folded(g: DataFrame, rows: DataFrame) -> DataFrame:
    """Settled payloads and the rows they leave, as ``FOLD_SCHEMA``."""
    outs = g.select("seq", "outcome", F.col("row").alias("row_key"))
    fin = settle.final_rows(g, rows).withColumnRenamed("row", "row_key").withColumn("outcome", F.lit("row"))
    both = outs.unionByName(fin, allowMissingColumns=True).withColumn("comp", F.lit(None).cast("long"))
    return both.select(*[F.col(f.name).cast(f.dataType) for f in FOLD_SCHEMA.fields])


def _labels(p: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, comp): payloads as 2 * seq + 1 and stored rows as 2 * id (one id space)."""
    def keys() -> Column:
        return F.explode(F.array(
            F.when(F.col("external_id").isNotNull(), F.concat_ws("\u0001", F.lit("e"), "source", "external_id")),
            F.concat_ws("\u0001", F.lit("u"), "source", "url")))

    edges = p.select((F.col("seq") * 2 + 1).alias("node"), keys().alias("key")).unionByName(rows.select((F.col("id") * 2).alias("node"), keys().alias("key")))
    return components(edges.where(F.col("key").isNotNull())).withColumnRenamed("label", "comp")


def _folded_in_order(p: DataFrame, rows: DataFrame) -> DataFrame:
    """The sequential fold per component. Each component lands whole in one partition, its rows
    contiguous; the fold streams over the partition and runs one component at a time."""
    fp = F.array("fp.a", "fp.b").alias("fp")
    p_rows = p.select("comp", F.lit("p").alias("kind"), "seq", F.lit(None).cast("long").alias("id"), "source", "external_id", "url", fp,
                      F.lit(None).cast("array<string>").alias("keywords"), F.col("kw").alias("search_keyword"), F.lit(None).cast("string").alias("status"),
                      F.lit(None).cast("string").alias("filter_reason"), "passes", "rule_status", "rule_reason")
    s_rows = rows.select("comp", F.lit("s").alias("kind"), "id", "source", "external_id", "url", fp, "keywords", "status", "filter_reason")
    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = p_rows.unionByName(s_rows, allowMissingColumns=True).repartition(n, "comp").sortWithinPartitions("comp")
    return both.mapInPandas(_fold_stream, FOLD_SCHEMA)


def _fold_stream(batches):
    """Groups consecutive rows of a component across Arrow batches and folds each; the parts of
    a component are put together once, when it is complete."""
    cols = [f.name for f in FOLD_SCHEMA.fields]
    parts: list[pd.DataFrame] = []  # of the component whose end is not seen yet
    for pdf in batches:
        done: list[dict] = []
        for comp, group in pdf.groupby("comp", sort=False):
            if parts and parts[0]["comp"].iloc[0] != comp:
                done += _fold_component(pd.concat(parts, ignore_index=True))
                parts = []
            parts.append(group)
        if done:
            yield pd.DataFrame.from_records(done, columns=cols)
    if parts:
        yield pd.DataFrame.from_records(_fold_component(pd.concat(parts, ignore_index=True)), columns=cols)


def fold_results(stored: DataFrame, payloads: DataFrame, folded: DataFrame, as_of: Column) -> DataFrame:
    """Per-payload outcomes of the fold joined with the final state of the row each
    payload touched, in the ``chain_path`` column layout."""
    outs = folded.where(F.col("outcome") != "row").select("seq", "outcome", "row_key")
    fin = folded.where(F.col("outcome") == "row").select(
        "row_key", "src_seq", "keywords", F.col("status").alias("f_status"),
        F.col("filter_reason").alias("f_reason"), "first_seen_new", "touched", "row_ext")
    wide = rows_of(stored, outs.where("row_key >= 0").select(F.col("row_key").alias("id")).distinct())
    cur = wide.select(F.col("id").alias("row_key"), F.struct(*stored.columns).alias("cur"))
    src = payloads.select(F.col("seq").alias("src_seq"), F.struct(*payloads.columns).alias("src"))
    j = left_by(left_by(left_by(outs, fin, "row_key"), cur, "row_key"), src, "src_seq")
    own = payloads.select(F.col("seq"), F.struct(*payloads.columns).alias("own"))
    j = j.join(own, "seq", "left")
    has_src = F.col("src_seq").isNotNull()
    cols = [F.col("seq"), F.col("outcome"),
            F.when(F.col("row_key") >= 0, F.col("row_key")).alias("matched_id"),
            F.col("own.search_keyword").alias("term"),
            F.when(F.col("row_key") >= 0, F.concat(F.lit("s:"), F.col("row_key").cast("string")))
            .when(F.col("row_key") < 0, F.concat(F.lit("p:"), (-F.col("row_key") - 1).cast("string")))
            .alias("row_ref")]
    for c in COMPARED:
        cols.append(
            F.when(F.col("outcome").isin("discarded"), F.col(f"own.{c}"))
            .when(has_src, F.col(f"src.{c}")).otherwise(F.col(f"cur.{c}")).alias(c))
    cols += [
        F.when(F.col("row_key") < 0, F.col("row_ext")).when(F.col("outcome") == "discarded", F.col("own.external_id"))
        .otherwise(F.col("cur.external_id")).alias("external_id"),
        F.col("own.source").alias("source"),
        F.when(F.col("outcome") == "discarded",
               F.when(F.col("own.search_keyword").isNotNull(), F.array("own.search_keyword"))
               .otherwise(F.array().cast("array<string>")))
        .otherwise(F.col("keywords")).alias("search_keywords"),
        F.when(F.col("outcome") == "discarded", F.lit(None).cast("string")).otherwise(F.col("f_status")).alias("status"),
        F.when(F.col("outcome") == "discarded", F.lit(None).cast("string")).otherwise(F.col("f_reason")).alias("filter_reason"),
    ]
    for c in ["ai_score", "ai_summary", "ai_analysis_at"]:
        cols.append(F.col(f"cur.{c}").alias(c))
    new_row = F.coalesce(F.col("first_seen_new"), F.lit(False))
    touched = F.coalesce(F.col("touched"), F.lit(False))
    cols += [
        F.when(new_row | (F.col("outcome") == "discarded"), as_of).otherwise(F.col("cur.first_seen_at")).alias("first_seen_at"),
        F.when(touched | (F.col("outcome") == "discarded"), as_of).otherwise(F.col("cur.last_seen_at")).alias("last_seen_at"),
        F.when(touched | (F.col("outcome") == "discarded"), as_of).otherwise(F.col("cur.updated_at")).alias("updated_at"),
    ]
    return j.select(*cols)


def upsert_outcomes(
    stored: DataFrame,
    payloads: DataFrame,
    include: Sequence[str],
    exclude: Sequence[str],
    as_of: Column,
    fold: bool = True,
) -> DataFrame:
    """Per-payload outcome of a batch (``inserted/updated/skipped/discarded/failed``) with
    the state of the row it produced or touched. Invalid payloads are ``failed`` with
    their ``error``. With ``fold=False`` only single payloads are returned."""
    v = validate(payloads.select(*PAYLOAD_COLS))
    bad = v.where(F.col("error").isNotNull())
    good = v.where(F.col("error").isNull()).drop("error")
    # the narrow identity table feeds several aggregates: computed once
    flags = chain_flags(cut_lineage(identity_match(stored, good)), ext_chains=fold)
    if fold:  # reused by the chain path, the components and the fold
        flags = cut_lineage(flags)
    else:
        flags = flags.withColumn("chain", F.col("single"))
    res = chain_path(stored, good, flags, as_of, include, exclude, singles_only=not fold)
    if fold:
        multi = good.join(flags.where(~F.col("chain")).select("seq"), "seq", "left_semi")
        # the interacting payloads with their text rules: the fold and three joins after it read them
        multi = cut_lineage(payload_rules(multi, include, exclude).select(*multi.columns, "passes", "rule_status", "rule_reason"))
        folded = fold_path(stored, multi, flags)
        res = res.unionByName(fold_results(stored, multi, folded, as_of))
    res = res.withColumn("error", F.lit(None).cast("string"))
    failed = bad.select("seq", F.lit("failed").alias("outcome"), "source",
                        F.col("search_keyword").alias("term"), "error")
    return res.unionByName(failed, allowMissingColumns=True)


def ingest_stats(outcomes: DataFrame, term: str = "term") -> DataFrame:
    """A3/A4: outcome counts per (source, term), per source and in total (rollup), every
    outcome as a column (0 when absent)."""
    g = outcomes.rollup("source", term).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )
    return g.withColumn("total", sum((F.col(o) for o in OUTCOMES), F.lit(0)))


def apply_batch_changes(
    stored: DataFrame,
    payloads: DataFrame,
    include: Sequence[str],
    exclude: Sequence[str],
    as_of: Column,
) -> tuple[DataFrame, DataFrame]:
    """Runs the batch and returns ``(changed_rows, outcomes)``: the final state of every
    row the batch updated or inserted, in the table layout. Inserted rows get new ids,
    unique and increasing in ``seq`` above the current maximum (with gaps, like an
    autoincrement); the id assignment is not deterministic under recomputation, so the new
    rows are checkpointed before use."""
    outcomes = cut_lineage(upsert_outcomes(stored, payloads, include, exclude, as_of))
    final = outcomes.where(F.col("outcome").isin("inserted", "updated") & F.col("row_ref").isNotNull())
    final = final.groupBy("row_ref").agg(
        F.max_by(F.struct(*final.columns), F.col("seq")).alias("r")).select("r.*")
    table_cols = stored.columns
    upd = final.where(F.col("row_ref").startswith("s:")).withColumn("id", F.col("matched_id"))
    new = final.where(F.col("row_ref").startswith("p:"))
    max_id = stored.agg(F.max("id")).collect()[0][0] or 0
    n = max(1, new.sparkSession.sparkContext.defaultParallelism)
    new = cut_lineage(
        new.repartitionByRange(n, "seq").sortWithinPartitions("seq")
        .withColumn("id", F.monotonically_increasing_id() + F.lit(max_id + 1))
    )
    return upd.select(*table_cols).unionByName(new.select(*table_cols)), outcomes


def apply_batch(
    stored: DataFrame,
    payloads: DataFrame,
    include: Sequence[str],
    exclude: Sequence[str],
    as_of: Column,
) -> tuple[DataFrame, DataFrame]:
    """Runs the batch and returns ``(new_table, outcomes)``: untouched stored rows pass
    through, touched rows take their final state, inserted rows are added."""
    changed, outcomes = apply_batch_changes(stored, payloads, include, exclude, as_of)
    keep = stored.join(changed.select("id"), "id", "left_anti")
    return keep.unionByName(changed), outcomes
