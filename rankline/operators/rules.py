"""Keyword rules: classification (F1-F3), relevance gate (F4-F5), title veto (F6) and the
posting x keyword hit table (J4).

Keyword lists come from the rule config (a handful of entries), so they are turned into
literal expressions: each regex is compiled once per task and the whole rule stays in
whole-stage codegen. The casefolded ``title + "\\n" + description`` is computed once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankline.functions import text as T
from rankline.session import cut_lineage

STATUSES = ("pending", "ready_for_ai", "discarded", "analyzed")
EXCLUDED_REASON_PREFIX = "Palavra excluida: "

# Titles with any of these whole words are outside software development.
NON_DEV_KEYWORDS = [
    "contador", "contabil", "contabilidade", "data science", "cientista de dados",
    "data scientist", "data engineering", "engenheiro de dados", "data engineer",
    "analytics engineer", "business intelligence", "bi analyst", "analista bi", "vendedor",
    "vendas", "sales", "sdr", "bdr", "account executive", "designer", "design grafico",
    "marketing", "growth hacker", "growth marketing", "head of growth", "growth manager",
]
VETO_SUMMARY_PREFIX = (
    "Vaga fora de desenvolvimento de software (classificacao local). Keyword(s) detectada(s): "
)


def content_col(title: str = "title", description: str = "description_raw") -> Column:
    """Casefolded ``title + "\\n" + description`` (description null -> "")."""
    return T.casefold(
        F.concat(F.col(title), F.lit("\n"), F.coalesce(F.col(description), F.lit("")))
    )


def classify_columns(
    df: DataFrame,
    include: Sequence[str],
    exclude: Sequence[str],
    title: str = "title",
    description: str = "description_raw",
) -> DataFrame:
    """add ``rule_status`` and ``rule_reason``. Exclusion wins; the reason names the
    keyword as configured."""
    tmp = "__content"
    d = df.withColumn(tmp, content_col(title, description))
    txt = F.col(tmp)
    excluded = T.first_substring_hit(txt, list(exclude))
    included = T.first_substring_hit(txt, list(include))
    d = d.withColumn("__excl", excluded).withColumn("__incl", included)
    return d.withColumn(
        "rule_status",
        F.when(F.col("__excl").isNotNull(), F.lit("discarded"))
        .when(F.col("__incl").isNotNull(), F.lit("ready_for_ai"))
        .otherwise(F.lit("pending")),
    ).withColumn(
        "rule_reason",
        F.when(
            F.col("__excl").isNotNull(), F.concat(F.lit(EXCLUDED_REASON_PREFIX), F.col("__excl"))
        ),
    ).drop(tmp, "__excl", "__incl")


def classification(
    include: Sequence[str], exclude: Sequence[str],
    title: str = "title", description: str = "description_raw", text: str | None = None,
) -> tuple[Column, Column]:
    """F2 as two column expressions ``(status, reason)`` (for use inside lazy branches).
    ``text``: a column that holds ``content_col`` already; without it every keyword folds the
    text anew."""
    txt = F.col(text) if text else content_col(title, description)
    excluded = T.first_substring_hit(txt, list(exclude))
    status = (
        F.when(excluded.isNotNull(), F.lit("discarded"))
        .when(T.first_substring_hit(txt, list(include)).isNotNull(), F.lit("ready_for_ai"))
        .otherwise(F.lit("pending"))
    )
    reason = F.when(excluded.isNotNull(), F.concat(F.lit(EXCLUDED_REASON_PREFIX), excluded))
    return status, reason


def gate_passes(include: Sequence[str], threshold: int = 3,
                title: str = "title", description: str = "description_raw", text: str | None = None) -> Column:
    """F5 as one column expression (true when the include list is empty); ``text`` as in
    ``classification``."""
    kws = list(dict.fromkeys(include))
    if not kws:
        return F.lit(True)
    return T.distinct_word_hits(F.col(text) if text else content_col(title, description), kws) >= F.lit(threshold)


def reclassify(df: DataFrame, include, exclude, as_of: Column) -> DataFrame:
    """apply F2 to stored rows; ``analyzed`` rows keep status and reason, and
    ``updated_at`` moves only when status or reason really changed."""
    c = classify_columns(df, include, exclude)
    keep = F.col("status") == "analyzed"
    new_status = F.when(keep, F.col("status")).otherwise(F.col("rule_status"))
    new_reason = F.when(keep, F.col("filter_reason")).otherwise(F.col("rule_reason"))
    changed = ~(F.col("status").eqNullSafe(new_status)) | ~(
        F.col("filter_reason").eqNullSafe(new_reason)
    )
    return (
        c.withColumn("updated_at", F.when(changed, as_of).otherwise(F.col("updated_at")))
        .withColumn("status", new_status)
        .withColumn("filter_reason", new_reason)
        .drop("rule_status", "rule_reason")
    )


def gate_columns(
    df: DataFrame,
    include: Sequence[str],
    threshold: int = 3,
    dedupe_casefold: bool = False,
    title: str = "title",
    description: str = "description_raw",
) -> DataFrame:
    """``match_count`` = distinct keywords with a whole-word hit; ``passes`` when
    count >= threshold, or always (count 0) when the keyword list is empty.

    Ingest dedupes keywords as given (case-sensitive); cleanup casefolds first."""
    kws = list(include)
    if dedupe_casefold:
        kws = list(dict.fromkeys(k.casefold() for k in kws))
    else:
        kws = list(dict.fromkeys(kws))
    if not kws:
        return df.withColumn("match_count", F.lit(0)).withColumn("passes", F.lit(True))
    txt = content_col(title, description)
    d = df.withColumn("__content", txt)
    return (
        d.withColumn("match_count", T.distinct_word_hits(F.col("__content"), kws))
        .withColumn("passes", F.col("match_count") >= F.lit(threshold))
        .drop("__content")
    )


def title_veto_columns(df: DataFrame, title: str = "title") -> DataFrame:
    """``veto_hits`` = fixed non-dev keywords with a whole-word hit in the casefolded
    title (list order); ``vetoed``; ``veto_summary`` naming them as in the local result."""
    t = T.casefold(F.col(title))
    d = df.withColumn("__t", t).withColumn(
        "veto_hits", T.word_hits_in_order(F.col("__t"), NON_DEV_KEYWORDS)
    )
    quoted = F.array_join(F.transform("veto_hits", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return (
        d.withColumn("vetoed", F.size("veto_hits") > 0)
        .withColumn(
            "veto_summary",
            F.when(F.col("vetoed"), F.concat(F.lit(VETO_SUMMARY_PREFIX), quoted, F.lit("."))),
        )
        .drop("__t")
    )


def keyword_hits(
    df: DataFrame,
    keywords: DataFrame,
    key: str = "seq",
    title: str = "title",
    description: str = "description_raw",
    max_literal_keywords: int = 500,
) -> DataFrame:
    """Which keywords hit which posting, as a table
    ``key, list_name, pos, keyword, substring_hit, word_hit`` (rows with any hit).

    ``keywords`` has ``list_name, pos, keyword``. A few keywords (``max_literal_keywords``, a
    checked bound) become literal expressions: each posting generates its (keyword, hit) rows
    with ``inline`` and keeps the hits, without a join. More keywords find the same hits by
    an equi-join (``hits_by_join``).
    """
    d = df.select(F.col(key), content_col(title, description).alias("__content"))
    kw = keywords.select(
        F.col("list_name").cast("string"), F.col("pos").cast("int"), F.col("keyword").cast("string"),
    )
    if max_literal_keywords and keywords.limit(max_literal_keywords + 1).count() <= max_literal_keywords:
        rows = kw.collect()
        if not rows:
            return d.select(
                F.col(key), F.lit(None).cast("string").alias("list_name"),
                F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("keyword"),
                F.lit(None).cast("boolean").alias("substring_hit"),
                F.lit(None).cast("boolean").alias("word_hit"),
            ).limit(0)
        structs = [
            F.struct(
                F.lit(r.list_name).alias("list_name"),
                F.lit(r.pos).alias("pos"),
                F.lit(r.keyword).alias("keyword"),
                T.has_substring(F.col("__content"), r.keyword).alias("substring_hit"),
                T.has_word(F.col("__content"), r.keyword).alias("word_hit"),
            )
            for r in rows
        ]
        out = d.select(F.col(key), F.inline(F.array(*structs)))
        return out.where(F.col("substring_hit") | F.col("word_hit"))
    return hits_by_join(d, kw, key)


# Keywords whose table is sent to every task, runs that a task remembers, texts
# that it answers at once, and the piece a long run is cut into.
MANY_KEYWORDS, REMEMBERED, AT_ONCE, PIECE = 500_000, 100_000, 500, 256
_RUNS = r"(?U)\w+|\W+"


def _substrings(run: Column, lengths: Sequence[int]) -> Column:
    """Substrings of ``run`` of the given lengths (in characters). Long runs are read in
    overlapping pieces, since a place in a text is found by walking to it."""
    def of(piece: Column) -> Column:
        n = F.length(piece)

        def each(k: int) -> Column:
            found = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(piece, i, F.lit(k)))
            return F.when(n >= k, found).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(*[each(k) for k in lengths]))

    starts = F.sequence(F.lit(0), F.floor((F.length(run) - 1) / PIECE).cast("int"))
    pieces = F.transform(starts, lambda j: F.substring(run, j * PIECE + 1, F.lit(PIECE + max(lengths) - 1)))
    return F.when(F.length(run) <= PIECE, of(run)).otherwise(F.flatten(F.transform(pieces, of)))


def hits_by_join(d: DataFrame, kw: DataFrame, key: str, many: int = MANY_KEYWORDS) -> DataFrame:
    """Exact hits for keyword tables of any size (see ``keyword_hits``). Texts and keywords are
    cut into runs of word and of other characters. A keyword's longest run, its anchor, is a
    substring of a run of every text that holds the keyword, so anchors are looked up among the
    substrings that the text's runs have of their lengths. For a keyword that is one run of
    word characters this is the hit, and the whole run the word hit; other candidates are
    checked against the text. Up to ``many`` anchors are sent to every task, so no text is
    shuffled; more are joined with the different runs of all texts."""
    kf = kw.withColumn("kw_fold", T.casefold(F.col("keyword"))).where("kw_fold <> ''")
    runs = F.regexp_extract_all("kw_fold", F.lit(_RUNS), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r.rlike(r"(?U)^\w").alias("w"), F.length(r).alias("n"), r.alias("r"))))
    kf = kf.withColumn("anchor", longest["r"])
    kf = cut_lineage(kf.withColumn("plain", longest["w"] & (F.col("anchor") == F.col("kw_fold"))))
    held = d.select(key, F.array_distinct(F.regexp_extract_all("__content", F.lit(_RUNS), F.lit(0))).alias("runs"))
    anchors = kf.select("anchor").distinct()
    if anchors.limit(many + 1).count() <= many:
        found = _lookup(held, [r.anchor for r in anchors.collect()], key)
        hit = found.join(F.broadcast(kf), "anchor")
    else:
        lengths = sorted(r.n for r in anchors.select(F.length("anchor").alias("n")).distinct().collect())
        held = held.select(key, F.explode("runs").alias("run"))
        subs = held.select("run").distinct().select("run", F.explode(F.array_distinct(_substrings(F.col("run"), lengths))).alias("anchor"))
        by_run = subs.join(kf, "anchor").withColumn("whole", F.col("run") == F.col("anchor"))
        hit = held.join(by_run, "run").groupBy(key, *kf.columns).agg(F.max("whole").alias("whole"))
    same = [F.col(key), "list_name", "pos", "keyword", F.lit(True).alias("substring_hit")]
    out = hit.where("plain").select(*same, F.col("whole").alias("word_hit"))
    if kf.where(~F.col("plain")).isEmpty():
        return out
    safe = F.regexp_replace("kw_fold", r"([^\w\s])", r"\\$1")
    pattern = F.concat(F.lit("(?U)\\b"), safe, F.lit("\\b"))
    checked = hit.where(~F.col("plain")).join(d, key).where(F.contains(F.col("__content"), F.col("kw_fold")))
    return out.unionByName(checked.select(*same, F.regexp_like(F.col("__content"), pattern).alias("word_hit")))


def _lookup(held: DataFrame, anchors: list[str], key: str) -> DataFrame:
    """``key, anchor, whole`` for the ``anchors`` that are substrings of a row's ``runs``; a task
    looks a run up once while it remembers it."""
    table = held.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        names = pa.array(table.value, pa.string())
        place = {a: i for i, a in enumerate(table.value)}
        lengths = sorted({len(a) for a in place})
        known: dict[str, np.ndarray] = {}

        def places(r: str) -> np.ndarray:
            """Places of the anchors in a run, twice and one more if it is the whole run."""
            n = len(r)
            subs = {r[i : i + k] for k in lengths if k <= n for i in range(n - k + 1)}
            got = np.array([2 * place[s] + (s == r) for s in subs if s in place], dtype=np.int64)
            if len(known) >= REMEMBERED:
                known.clear()
            if n <= PIECE:
                known[r] = got
            return got

        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, AT_ONCE):
                rows = batch.column(1).slice(at, AT_ONCE)
                hits, counts = [], []
                for runs in rows.to_pylist():
                    found = [known[r] if r in known else places(r) for r in runs or ()]
                    both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                    # the whole run sorts behind the part of a run
                    last = np.append(both[1:] // 2 != both[:-1] // 2, True)[: len(both)]
                    hits.append(both[last])
                    counts.append(len(hits[-1]))
                flat = np.concatenate(hits)
                which = pa.array(np.repeat(np.arange(at, at + len(counts)), counts))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(which), names.take(pa.array(flat // 2)), pa.array(flat % 2 == 1)], names=[key, "anchor", "whole"])

    kind = held.schema[key].dataType.simpleString()
    return held.mapInArrow(run, f"`{key}` {kind}, anchor string, whole boolean")
