"""The registered queries: each is a Spark plan over the test tables plus, where SQL can
express it, the DuckDB oracle text. ``__spark_entry__`` exposes both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.operators import listing, rules
from rankline.plans import fixture_sql as S
from rankline.session import cut_lineage
from rankline.sources import testdata as TD

# The rule lists used by the registered queries.
INCLUDE = ["from", "with", "thing", "über", "erin", "pour"]
EXCLUDE = ["token", "%%%"]

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TD.scored_jobs(spark, sf_dir, INCLUDE, EXCLUDE)


# ---------------------------------------------------------------- rules
@register(
    "classify",
    f"""SELECT seq, rule_status AS status, rule_reason AS filter_reason
        FROM (SELECT seq, {S.classify_cols(S.content(), INCLUDE, EXCLUDE)} FROM ({S.POSTINGS}))""",
)
def classify(spark, sf_dir):
    p = TD.postings(spark, sf_dir)
    c = rules.classify_columns(p, INCLUDE, EXCLUDE)
    return c.select("seq", F.col("rule_status").alias("status"),
                    F.col("rule_reason").alias("filter_reason"))


@register(
    "relevance_gate",
    f"""SELECT seq, match_count, match_count >= 3 AS passes
        FROM (SELECT seq, {S.word_count(S.content(), INCLUDE)} AS match_count
              FROM ({S.POSTINGS}))""",
)
def relevance_gate(spark, sf_dir):
    p = TD.postings(spark, sf_dir)
    return rules.gate_columns(p, INCLUDE, threshold=3).select("seq", "match_count", "passes")


def _kw_table_sql() -> str:
    rows = [f"('include', {i}, {S.q(k)})" for i, k in enumerate(INCLUDE)] + [
        f"('exclude', {i}, {S.q(k)})" for i, k in enumerate(EXCLUDE)
    ]
    return "(VALUES " + ", ".join(rows) + ") AS kw(list_name, pos, keyword)"


def _kw_hits_sql() -> str:
    parts = []
    for lst, kws in (("include", INCLUDE), ("exclude", EXCLUDE)):
        for i, k in enumerate(kws):
            parts.append(
                f"SELECT seq, '{lst}' AS list_name, {i} AS pos, {S.q(k)} AS keyword, "
                f"{S.has_sub('t', k)} AS substring_hit, {S.has_word('t', k)} AS word_hit "
                f"FROM (SELECT seq, {S.content()} AS t FROM ({S.POSTINGS}))"
            )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE substring_hit OR word_hit"


@register("keyword_hits", _kw_hits_sql())
def keyword_hits(spark, sf_dir):
    p = TD.postings(spark, sf_dir)
    kw = spark.createDataFrame(
        [("include", i, k) for i, k in enumerate(INCLUDE)]
        + [("exclude", i, k) for i, k in enumerate(EXCLUDE)],
        "list_name string, pos int, keyword string",
    )
    return rules.keyword_hits(p, kw)


def _veto_sql() -> str:
    t = S.fold("title")
    hits = "list_filter([" + ", ".join(
        f"CASE WHEN {S.has_word('t', k)} THEN {S.q(k)} END" for k in rules.NON_DEV_KEYWORDS
    ) + "], lambda x: x IS NOT NULL)"
    return f"""
SELECT seq, array_to_string(veto_hits, '|') AS veto_hits, len(veto_hits) > 0 AS vetoed,
       CASE WHEN len(veto_hits) > 0 THEN {S.q(rules.VETO_SUMMARY_PREFIX)} ||
            array_to_string(list_transform(veto_hits, lambda x: '''' || x || ''''), ', ') || '.'
       END AS veto_summary
FROM (SELECT seq, {hits} AS veto_hits FROM (SELECT seq, {t} AS t FROM ({S.POSTINGS})))
"""


@register("title_veto", _veto_sql())
def title_veto(spark, sf_dir):
    p = TD.postings(spark, sf_dir).select("seq", "title")
    v = rules.title_veto_columns(p)
    return v.select("seq", F.array_join("veto_hits", "|").alias("veto_hits"), "vetoed",
                    "veto_summary")


# ---------------------------------------------------------------- listing
@register(
    "rank_page",
    f"""SELECT rank, id, title, status, ai_score, created_at FROM (
          SELECT row_number() OVER (ORDER BY ai_score DESC NULLS LAST, created_at DESC, id DESC)
                 AS rank, id, title, status, ai_score, created_at
          FROM ({S.scored_jobs(INCLUDE, EXCLUDE)}) WHERE status NOT IN ('discarded'))
        WHERE rank > 50 AND rank <= 100""",
)
def rank_page(spark, sf_dir):
    f = listing.JobFilter(exclude_status=("discarded",))
    return listing.rank_page(jobs(spark, sf_dir), f, page=2, size=50)


def _view_totals_sql() -> str:
    return f"""SELECT
  count_if(status IN ('analyzed') AND ai_score IS NOT NULL AND ai_score >= 7) AS ready_total,
  count_if(status IN ('ready_for_ai')) AS analyze_total,
  count_if(status IN ('analyzed') AND ai_score IS NOT NULL AND ai_score <= 6) AS adjust_total,
  count_if(status IN ('pending')) AS review_total,
  count_if(status IN ('discarded')) AS discarded_total,
  count_if(status NOT IN ('discarded')) AS all_total
FROM ({S.scored_jobs(INCLUDE, EXCLUDE)})"""


@register("view_totals", _view_totals_sql())
def view_totals(spark, sf_dir):
    return listing.view_totals(jobs(spark, sf_dir))


@register(
    "score_band",
    f"""SELECT id, ai_score, CASE WHEN ai_score IS NULL THEN {S.q(listing.BAND_NONE)}
              WHEN ai_score >= 8 THEN {S.q(listing.BAND_HIGH)}
              WHEN ai_score >= 6 THEN {S.q(listing.BAND_MID)}
              ELSE {S.q(listing.BAND_LOW)} END AS band
        FROM ({S.scored_jobs(INCLUDE, EXCLUDE)})""",
)
def score_band(spark, sf_dir):
    j = jobs(spark, sf_dir)
    return j.select("id", "ai_score", listing.score_band(F.col("ai_score")).alias("band"))


# ---------------------------------------------------------------- fetch-shaped operators
from rankline.operators import fetch as FT  # noqa: E402
from rankline.operators import maintain as MT  # noqa: E402

# Per-source checkpoints of the take-while query.
TAKE_WHILE_CHECKPOINTS = [("feed_a", "2024-01-01 00:30:00"), ("feed_b", "2024-01-01 01:00:00")]
FETCH_LIMIT = 100


def _feed_order():
    """Feed order of the fixture fetches: by url, newest seq first on ties."""
    return F.struct(F.col("url"), (-F.col("seq")).alias("nseq"))


@register(
    "checkpoint",
    f"SELECT source, max(created_at) AS checkpoint FROM ({S.STORED}) GROUP BY source",
)
def checkpoint(spark, sf_dir):
    return FT.checkpoints(TD.stored_rows(spark, sf_dir))


def _ckpt_values_sql() -> str:
    vals = ", ".join(f"({S.q(s)}, TIMESTAMP {S.q(t)})" for s, t in TAKE_WHILE_CHECKPOINTS)
    return f"(VALUES {vals}) AS c(source, ckpt)"


@register(
    "take_while",
    f"""WITH r AS (
          SELECT p.*, c.ckpt, row_number() OVER (PARTITION BY p.source, p.search_keyword
                                                 ORDER BY p.url, p.seq DESC) AS pos
          FROM ({S.POSTINGS}) p LEFT JOIN {_ckpt_values_sql()} ON c.source = p.source),
        s AS (SELECT *, min(CASE WHEN created_at <= ckpt THEN pos END)
                        OVER (PARTITION BY source, search_keyword) AS stop FROM r)
        SELECT seq, source, search_keyword, created_at FROM s
        WHERE stop IS NULL OR pos < stop""",
)
def take_while(spark, sf_dir):
    p = TD.postings(spark, sf_dir).select("seq", "source", "search_keyword", "url", "created_at")
    ck = spark.createDataFrame(TAKE_WHILE_CHECKPOINTS, "source string, checkpoint string").select(
        "source", F.col("checkpoint").cast("timestamp_ntz").alias("checkpoint")
    )
    out = FT.take_while(p, ["source", "search_keyword"], _feed_order(), ck)
    return out.select("seq", "source", "search_keyword", "created_at")


@register(
    "fetch_limit",
    f"""WITH d AS (
          SELECT *, row_number() OVER (PARTITION BY source, search_keyword, external_id
                                       ORDER BY url, seq DESC) AS rn
          FROM ({S.POSTINGS}) WHERE external_id IS NOT NULL),
        l AS (SELECT *, row_number() OVER (PARTITION BY source, search_keyword
                                           ORDER BY url, seq DESC) AS pos
              FROM d WHERE rn = 1)
        SELECT seq, source, search_keyword, external_id, pos FROM l WHERE pos <= {FETCH_LIMIT}""",
)
def fetch_limit(spark, sf_dir):
    p = TD.postings(spark, sf_dir).select("seq", "source", "search_keyword", "external_id", "url")
    p = p.where(F.col("external_id").isNotNull())
    fetch = ["source", "search_keyword"]
    d = FT.first_seen(p, fetch, "external_id", _feed_order())
    out = FT.fetch_limit(d, fetch, _feed_order(), FETCH_LIMIT)
    return out.select("seq", "source", "search_keyword", "external_id", "pos")


# ---------------------------------------------------------------- maintenance
@register(
    "dup_groups",
    f"""SELECT 'e' AS key_type, source, external_id AS key_value, count(*) AS n
        FROM ({S.POSTINGS}) WHERE external_id IS NOT NULL
        GROUP BY source, external_id HAVING count(*) > 1
        UNION ALL
        SELECT 'u' AS key_type, source, url AS key_value, count(*) AS n
        FROM ({S.POSTINGS}) WHERE external_id IS NULL
        GROUP BY source, url HAVING count(*) > 1""",
)
def dup_groups(spark, sf_dir):
    return MT.duplicate_groups(TD.postings(spark, sf_dir))


def _dedup_sql() -> str:
    prio = ("CASE status WHEN 'analyzed' THEN 3 WHEN 'discarded' THEN 2 "
            "WHEN 'ready_for_ai' THEN 1 ELSE 0 END")
    return f"""
WITH k AS (
  SELECT *, CASE WHEN external_id IS NOT NULL THEN 'e' ELSE 'u' END AS key_type,
            coalesce(external_id, url) AS key_value
  FROM ({S.scored_jobs(INCLUDE, EXCLUDE)})),
r AS (
  SELECT *,
    row_number() OVER (PARTITION BY key_type, source, key_value ORDER BY first_seen_at, id) AS rn_first,
    row_number() OVER (PARTITION BY key_type, source, key_value
                       ORDER BY {prio} DESC, first_seen_at, id) AS rn_best,
    count(*) OVER (PARTITION BY key_type, source, key_value) AS n_merged
  FROM k),
e AS (
  SELECT key_type, source, key_value, kw, first_seen_at, id, pos,
         row_number() OVER (PARTITION BY key_type, source, key_value, kw
                            ORDER BY first_seen_at, id, pos) AS rn
  FROM (SELECT key_type, source, key_value, first_seen_at, id,
               unnest(search_keywords) AS kw, generate_subscripts(search_keywords, 1) AS pos
        FROM k)),
m AS (
  SELECT key_type, source, key_value,
         string_agg(kw, ',' ORDER BY first_seen_at, id, pos) AS merged
  FROM e WHERE rn = 1 AND kw IS NOT NULL AND kw <> ''
  GROUP BY key_type, source, key_value)
SELECT f.id, f.external_id, f.source, f.url, f.title, md5(f.description_raw) AS description_md5, b.status, b.filter_reason, b.ai_score,
       b.ai_summary, b.ai_analysis_at, f.first_seen_at,
       CASE WHEN f.n_merged > 1 THEN coalesce(m.merged, '')
            ELSE array_to_string(f.search_keywords, ',') END AS search_keywords,
       f.n_merged
FROM (SELECT * FROM r WHERE rn_first = 1) f
JOIN (SELECT * FROM r WHERE rn_best = 1) b USING (key_type, source, key_value)
LEFT JOIN m USING (key_type, source, key_value)
"""


@register("dedup_merge", _dedup_sql())
def dedup_merge(spark, sf_dir):
    d = MT.dedup_merge(jobs(spark, sf_dir))
    return d.select(
        "id", "external_id", "source", "url", "title", F.md5("description_raw").alias("description_md5"),
        "status", "filter_reason", "ai_score", "ai_summary", "ai_analysis_at", "first_seen_at",
        F.array_join("search_keywords", ",").alias("search_keywords"), "n_merged",
    )


CLEANUP_THRESHOLD = 3


@register(
    "cleanup",
    f"""SELECT id, status,
               CASE WHEN status <> 'analyzed' THEN {S.word_count(S.content(), INCLUDE)} END AS match_count,
               status <> 'analyzed' AND {S.word_count(S.content(), INCLUDE)} < {CLEANUP_THRESHOLD}
                 AS deleted
        FROM ({S.scored_jobs(INCLUDE, EXCLUDE)})""",
)
def cleanup(spark, sf_dir):
    f = MT.cleanup_flags(jobs(spark, sf_dir), INCLUDE, CLEANUP_THRESHOLD)
    return f.select("id", "status", "match_count", "deleted")


# Which latest event type asks for which status (purchase asks for a status
# that manual changes refuse; other event types ask for nothing).
EVENT_STATUS = [("signup", "ready_for_ai"), ("error", "discarded"), ("purchase", "analyzed")]


def _event_map(col):
    expr = None
    for ev, st in EVENT_STATUS:
        expr = F.when(col == ev, F.lit(st)) if expr is None else expr.when(col == ev, F.lit(st))
    return expr


def _manual_sql() -> str:
    case = "CASE latest " + " ".join(f"WHEN {S.q(e)} THEN {S.q(s)}" for e, s in EVENT_STATUS) + " END"
    return f"""
WITH ev AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS latest
            FROM events GROUP BY user_id),
req AS (SELECT id, {case} AS requested FROM ev),
j AS ({S.scored_jobs(INCLUDE, EXCLUDE)})
SELECT r.id, r.requested,
       CASE WHEN r.requested NOT IN ('ready_for_ai', 'discarded') THEN 'invalid_status'
            WHEN j.id IS NULL THEN 'not_found' ELSE 'updated' END AS outcome,
       CASE WHEN r.requested IN ('ready_for_ai', 'discarded') THEN r.requested ELSE j.status END
         AS status_after,
       j.filter_reason AS filter_reason_after
FROM req r LEFT JOIN j ON j.id = r.id
WHERE r.requested IS NOT NULL
"""


@register("manual_status", _manual_sql())
def manual_status(spark, sf_dir):
    ev = TD.table(spark, sf_dir, "events")
    latest = ev.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("latest")
    )
    changes = latest.select(F.col("user_id").alias("id"), _event_map(F.col("latest")).alias("status")) \
        .where(F.col("status").isNotNull())
    j = jobs(spark, sf_dir).drop("description_raw")
    new_jobs, outcomes = MT.manual_status(j, changes, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    after = new_jobs.select("id", F.col("status").alias("status_after"),
                            F.col("filter_reason").alias("filter_reason_after"))
    o = outcomes.join(after, "id", "left")
    return o.select("id", "requested", "outcome",
                    F.when(F.col("outcome") == "not_found", F.lit(None).cast("string"))
                    .otherwise(F.col("status_after")).alias("status_after"),
                    "filter_reason_after")


# ---------------------------------------------------------------- scoring
from rankline.operators import scoring as SC  # noqa: E402


@register("response_parse", S.parsed_responses(S.RESPONSES))
def response_parse(spark, sf_dir):
    r = TD.scorer_responses(spark, sf_dir)
    return SC.parse_results(r).select("seq", "score", "summary", "error")


def _rubric_sql() -> str:
    t = "t"
    pts = " + ".join(f"CAST({S.has_sub(t, k)} AS INTEGER)" for k in dict.fromkeys(INCLUDE))
    exc = " + ".join(f"CAST({S.has_sub(t, k)} AS INTEGER)" for k in dict.fromkeys(EXCLUDE))
    veto = " OR ".join(S.has_word("ft", k) for k in rules.NON_DEV_KEYWORDS)
    return f"""
SELECT seq, points, exclude_hits,
       CAST(CASE WHEN vetoed THEN 0 ELSE greatest(0, least(10,
            CASE WHEN points >= 5 THEN 10 WHEN points = 4 THEN 9 WHEN points = 3 THEN 8
                 WHEN points = 2 THEN 6 ELSE 4 END - exclude_hits)) END AS INTEGER) AS score
FROM (SELECT seq, ({pts}) AS points, ({exc}) AS exclude_hits, ({veto}) AS vetoed
      FROM (SELECT seq, {S.content()} AS t, {S.fold('title')} AS ft FROM ({S.POSTINGS})))
"""


@register("rubric_score", _rubric_sql())
def rubric_score(spark, sf_dir):
    p = TD.postings(spark, sf_dir)
    return SC.rubric_score(p, INCLUDE, EXCLUDE).select("seq", "points", "exclude_hits", "score")


_WS = "[ \\t\\n\\r]+"


def _term_sql() -> str:
    f = S.fold
    excl = "[" + ", ".join(S.q(k.casefold()) for k in dict.fromkeys(EXCLUDE)) + "]"
    return f"""
WITH w AS (
  SELECT seq,
         list_filter(regexp_split_to_array(title, '{_WS}'), lambda x: x <> '') AS o0,
         list_filter(regexp_split_to_array(description_raw, '{_WS}'), lambda x: x <> '') AS s0
  FROM ({S.POSTINGS})),
o AS (SELECT seq, list_filter(o0, lambda x, i: list_position(o0, x) = i) AS orig, s0 FROM w),
k AS (SELECT seq, orig, s0, list_transform(orig, lambda x: {f('x')}) AS okeys FROM o),
a AS (SELECT seq, orig,
             list_slice(list_filter(s0, lambda x: NOT list_contains(okeys, {f('x')})
                                               AND NOT list_contains({excl}, {f('x')})),
                        1, 3 * len(orig)) AS added
      FROM k),
e AS (SELECT seq, orig, added, list_concat(orig, added) AS allk FROM a),
g AS (SELECT seq, orig, added, allk, list_transform(allk, lambda y: {f('y')}) AS akeys FROM e)
SELECT seq, len(orig) AS n_original, array_to_string(added, '|') AS added,
       array_to_string(list_filter(allk, lambda x, i: list_position(akeys, akeys[i]) = i), '|')
         AS expanded
FROM g
"""


@register("term_expansion", _term_sql())
def term_expansion(spark, sf_dir):
    p = TD.postings(spark, sf_dir)
    words = lambda c: F.filter(F.split(F.col(c), _WS), lambda x: x != "")
    e = SC.expand_terms(p.select("seq", "title", "description_raw"), words("title"),
                        words("description_raw"), EXCLUDE)
    return e.select(
        "seq", F.size("original").alias("n_original"),
        F.array_join("added", "|").alias("added"), F.array_join("expanded", "|").alias("expanded"),
    )


# ---------------------------------------------------------------- text and feed fields
from rankline.functions import parse as PR  # noqa: E402
from rankline.functions import text as TX  # noqa: E402


def _redact_sql() -> str:
    out = "text"
    for pat, repl in TX.REDACT_RULES:
        out = f"regexp_replace({out}, {S.q(pat)}, {S.q(repl)}, 'g')"
    return f"SELECT doc_id, {out} AS redacted, {out} <> text AS changed FROM documents"


@register("redact", _redact_sql())
def redact(spark, sf_dir):
    d = TD.table(spark, sf_dir, "documents").select("doc_id", "text")
    r = d.withColumn("redacted", TX.redact(F.col("text")))
    return r.select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"))


def _markup_sql() -> str:
    out = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<style\\b.*?</style\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"
    for ent, ch in TX.ENTITIES:
        out = f"replace({out}, {S.q(ent)}, {S.q(ch)})"
    out = f"trim(regexp_replace({out}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
    return (f"SELECT page_id, {out} AS plain_text, "
            f"regexp_matches({S.strip('html')}, {S.q(TX.MARKUP_PATTERN)}) AS is_markup FROM pages")


@register("strip_markup", _markup_sql())
def strip_markup(spark, sf_dir):
    p = TD.table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", TX.strip_markup(F.col("html")).alias("plain_text"),
                    TX.looks_like_markup(F.col("html")).alias("is_markup"))


def _salary_inputs(spark, sf_dir):
    d = TD.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    lo = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, F.lit(0)).otherwise(F.col("n_chars") * 100)
    hi = F.when(i % 3 == 0, F.lit(None)).otherwise(F.col("n_chars") * 130)
    cur = (F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, F.lit("")).when(i % 5 == 2, F.lit("usd"))
           .otherwise(F.lit("brl")))
    typ = F.when(i % 7 == 0, F.lit("uninformed")).when(i % 7 == 1, F.lit(None)).otherwise(F.lit("monthly"))
    js = F.when(i % 11 == 0, F.lit(None)).otherwise(
        F.struct(lo.cast("long").alias("from"), hi.cast("long").alias("to"),
                 cur.cast("string").alias("currency"), typ.cast("string").alias("type")))
    title = F.substring(F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), 1, 80)
    return d.select("doc_id", lo.cast("long").alias("salary_min"), hi.cast("long").alias("salary_max"),
                    js.alias("job_salary"), title.alias("subtitle"), F.col("text").alias("description"))


def _salary_sql() -> str:
    def rng(lo, hi, cur):
        return (f"CASE WHEN coalesce({lo},0) <> 0 AND coalesce({hi},0) <> 0 "
                f"THEN {cur} || ' ' || format('{{:,}}', {lo}) || ' - ' || {cur} || ' ' || format('{{:,}}', {hi}) "
                f"WHEN coalesce({lo},0) <> 0 THEN {cur} || ' ' || format('{{:,}}', {lo}) || '+' "
                f"WHEN coalesce({hi},0) <> 0 THEN {cur} || ' up to ' || format('{{:,}}', {hi}) END")
    rx = f"nullif(regexp_extract(subtitle || ' ' || description, {S.q('(?i)' + PR.SALARY_PATTERN)}, 1), '')"
    cur = "CASE WHEN upper(coalesce(cur, '')) = '' THEN 'BRL' ELSE upper(cur) END"
    return f"""
WITH i AS (
  SELECT doc_id,
         CAST(CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 0 ELSE n_chars * 100 END AS BIGINT) AS lo,
         CAST(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars * 130 END AS BIGINT) AS hi,
         CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 2 THEN 'usd' ELSE 'brl' END AS cur,
         CASE WHEN doc_id % 7 = 0 THEN 'uninformed' WHEN doc_id % 7 = 1 THEN NULL ELSE 'monthly' END AS typ,
         doc_id % 11 = 0 AS no_struct,
         substr(split_part(text, chr(10), 1), 1, 80) AS subtitle, text AS description
  FROM documents)
SELECT doc_id, {rng('lo', 'hi', "'USD'")} AS salary_a,
  CASE WHEN NOT no_struct AND lower(coalesce(typ, '')) = 'uninformed'
            AND coalesce(lo, 0) = 0 AND coalesce(hi, 0) = 0 THEN NULL
       WHEN NOT no_struct AND ({rng('lo', 'hi', cur)}) IS NOT NULL THEN {rng('lo', 'hi', cur)}
       ELSE {rx} END AS salary_b
FROM i
"""


@register("salary_text", _salary_sql())
def salary_text(spark, sf_dir):
    d = _salary_inputs(spark, sf_dir)
    return d.select(
        "doc_id",
        PR.salary_feed_a(F.col("salary_min"), F.col("salary_max")).alias("salary_a"),
        PR.salary_feed_b(F.col("job_salary"), F.col("subtitle"), F.col("description")).alias("salary_b"),
    )


AS_OF = "2025-01-01 00:00:00"


def _ts_inputs(spark, sf_dir):
    e = TD.table(spark, sf_dir, "events").select("event_id", "ts")
    k = F.col("event_id") % 8
    fmt = lambda f: F.date_format(F.col("ts"), f)
    raw = (
        F.when(k == 0, fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(k == 1, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(k == 2, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
        .when(k == 3, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(k == 4, fmt("yyyy-MM-dd"))
        .when(k == 5, F.lit(""))
        .when(k == 6, F.lit("not a date"))
        .otherwise(fmt("yyyy-MM-dd'T'HH:mm"))
    )
    return e.select("event_id", raw.alias("raw"))


def _ts_sql() -> str:
    return f"""
WITH i AS (
  SELECT event_id, CASE event_id % 8
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
    WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
    WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN strftime(ts, '%Y-%m-%d')
    WHEN 5 THEN ''
    WHEN 6 THEN 'not a date'
    ELSE strftime(ts, '%Y-%m-%dT%H:%M') END AS raw
  FROM events),
p AS (SELECT event_id, raw,
             CASE WHEN raw LIKE '%+__:__' OR raw LIKE '%Z'
                  THEN TRY_CAST(raw AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
                  ELSE TRY_CAST(raw AS TIMESTAMP) END AS t FROM i)
SELECT event_id, raw, coalesce(t, TIMESTAMP '{AS_OF}') AS parsed, t IS NULL AS used_default FROM p
"""


@register("timestamp_parse", _ts_sql())
def timestamp_parse(spark, sf_dir):
    i = _ts_inputs(spark, sf_dir)
    tz = spark.conf.get("spark.sql.session.timeZone")
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    parsed = PR.parse_feed_timestamp(F.col("raw"), F.lit(None).cast("timestamp_ntz"), tz)
    return i.select("event_id", "raw", F.coalesce(parsed, as_of).alias("parsed"),
                    parsed.isNull().alias("used_default"))


# ---------------------------------------------------------------- ingest
from rankline.operators import ingest as IG  # noqa: E402

INGEST_AS_OF = "2025-01-01 00:00:00"


@register(
    "identity_match",
    f"""SELECT seq, matched_id,
               CASE WHEN e_id IS NOT NULL THEN 'external_id' WHEN u_id IS NOT NULL THEN 'url' END
                 AS match_kind
        FROM ({S.IDENTITY})""",
)
def identity_match(spark, sf_dir):
    m = IG.identity_match(TD.stored_rows(spark, sf_dir), TD.incoming_batch(spark, sf_dir))
    return m.select("seq", "matched_id", "match_kind")


@register(
    "change_detection",
    f"""SELECT m.seq, m.matched_id, {S.changed_fields('m', 'cur')} AS changed_fields,
               m.search_keyword IS NOT NULL
                 AND NOT coalesce(list_contains(cur.search_keywords, m.search_keyword), false)
                 AS keyword_new
        FROM ({S.IDENTITY}) m JOIN ({S.STORED}) cur ON cur.id = m.matched_id""",
)
def change_detection(spark, sf_dir):
    st = TD.stored_rows(spark, sf_dir)
    inc = TD.incoming_batch(spark, sf_dir)
    m = IG.identity_match(st, inc).select("seq", "matched_id").where(F.col("matched_id").isNotNull())
    cur = st.select(F.col("id").alias("matched_id"), F.struct(*st.columns).alias("cur"))
    j = IG.change_columns(inc.join(m, "seq").join(cur, "matched_id"))
    return j.select("seq", "matched_id", F.array_join("changed_fields", ",").alias("changed_fields"),
                    "keyword_new")


def _stored_snapshot(spark, sf_dir):
    """The stored side as a written table (a snapshot in the shared checkpoint folder),
    as the store would hand it to an upsert."""
    return cut_lineage(TD.stored_rows(spark, sf_dir))


def _landed_batch(spark, sf_dir):
    """The incoming batch as landed files (written to the shared folder), as an upsert
    reads payloads in the pipeline."""
    return cut_lineage(TD.incoming_batch(spark, sf_dir))


def _upsert(spark, sf_dir, fold):
    return IG.upsert_outcomes(
        _stored_snapshot(spark, sf_dir), _landed_batch(spark, sf_dir), INCLUDE, EXCLUDE,
        F.lit(INGEST_AS_OF).cast("timestamp_ntz"), fold=fold,
    )


@register("upsert_single", S.upsert_single(INCLUDE, EXCLUDE))
def upsert_single(spark, sf_dir):
    o = _upsert(spark, sf_dir, fold=False)
    return o.select("seq", "outcome", "matched_id", "source", "term", "title", "status",
                    "filter_reason", F.array_join("search_keywords", ",").alias("search_keywords"))


@register(
    "ingest_stats",
    f"""SELECT source, term,
               count_if(outcome = 'inserted') AS inserted, count_if(outcome = 'updated') AS updated,
               count_if(outcome = 'skipped') AS skipped, count_if(outcome = 'discarded') AS discarded,
               count_if(outcome = 'failed') AS failed, count(*) AS total
        FROM ({S.batch_outcomes(INCLUDE, EXCLUDE)}) GROUP BY ROLLUP (source, term)""",
)
def ingest_stats(spark, sf_dir):
    return IG.ingest_stats(_upsert(spark, sf_dir, fold=True))


@register("upsert_fold", S.batch_outcomes(INCLUDE, EXCLUDE))
def upsert_fold(spark, sf_dir):
    """Whole batch: singles natively, interacting payloads folded per component."""
    o = _upsert(spark, sf_dir, fold=True)
    return o.select("seq", "outcome", "matched_id", "source", "term", "title", "status",
                    "filter_reason", F.array_join("search_keywords", ",").alias("search_keywords"))


# ---------------------------------------------------------------- streaming
import uuid  # noqa: E402

from rankline.session import shared_path  # noqa: E402
from rankline.sources import store as ST  # noqa: E402
from rankline.streaming import ingest_stream as IS  # noqa: E402

STREAM_FILES = 4


def land_postings(spark, sf_dir, landing: str, parts: int = STREAM_FILES) -> None:
    """Lands the postings in ``parts`` folders ``part=k`` by ``seq`` ranges (oldest first), all
    in one job: each task writes the ranges it reads, a file a range, so no range is written
    by one task alone. A table that is one small task lands a file a range, which a trigger
    of one file takes."""
    p = TD.postings(spark, sf_dir).select(
        "seq", "external_id", "title", "company", "url", "source", "description_raw",
        "search_keyword", F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("salary"), "created_at")
    lo, hi = p.agg(F.min("seq"), F.max("seq")).collect()[0]
    step = (hi - lo) // parts + 1
    p.withColumn("part", F.expr(f"(seq - {lo}) div {step}").cast("int")).write.mode("overwrite").partitionBy("part").parquet(landing)


_LANDED = f"SELECT *, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS salary FROM ({S.POSTINGS})"


@register(
    "stream_ingest",
    f"""{S.batch_in_order(f"SELECT * FROM ({S.STORED}) WHERE false", _LANDED, INCLUDE, EXCLUDE)}
        SELECT external_id, source, url, title, status, array_to_string(kws, ',') AS search_keywords
        FROM t WHERE kind = 'row'""",
)
def stream_ingest(spark, sf_dir):
    """Landed files through ``availableNow`` as one cycle, cut at the per-source
    checkpoint, upserted and committed as a version."""
    run = shared_path(spark, "stream_ingest", uuid.uuid4().hex)
    land_postings(spark, sf_dir, f"{run}/landing")
    q, log = IS.start(spark, f"{run}/landing", f"{run}/jobs", f"{run}/_stream", INCLUDE, EXCLUDE,
                      available_now=True)
    q.awaitTermination()
    t = ST.read(spark, f"{run}/jobs")
    return t.select("external_id", "source", "url", "title", "status",
                    F.array_join("search_keywords", ",").alias("search_keywords"))


# ---------------------------------------------------------------- scoring stage around the model
@register(
    "prompt_digest",
    f"""SELECT seq, md5(p) AS prompt_md5, length(p) AS prompt_chars FROM (
          SELECT seq, {S.q(SC.prompt_prefix(INCLUDE, EXCLUDE) + "Titulo da vaga: ")} || title ||
                 {S.q(chr(10) + "Descricao da vaga: ")} || {S.strip("coalesce(description_raw, '')")} ||
                 {S.q(SC.PROMPT_SUFFIX)} AS p
          FROM ({S.POSTINGS}))""",
)
def prompt_digest(spark, sf_dir):
    """L1/L2: the full scoring prompt of every posting (digest and length)."""
    p = TD.postings(spark, sf_dir).withColumn("p", SC.prompt_column(INCLUDE, EXCLUDE))
    return p.select("seq", F.md5("p").alias("prompt_md5"), F.length("p").alias("prompt_chars"))


def _write_back_sql() -> str:
    veto = " OR ".join(S.has_word(S.fold("j.title"), k) for k in rules.NON_DEV_KEYWORDS)
    return f"""
WITH j AS ({S.scored_jobs(INCLUDE, EXCLUDE)}),
r AS ({S.parsed_responses(S.RESPONSES)}),
res AS (
  SELECT j.id,
         CASE WHEN {veto} THEN 0 ELSE r.score END AS score,
         CASE WHEN {veto} THEN 'vetoed' ELSE r.summary END AS summary,
         CASE WHEN {veto} THEN false ELSE r.error END AS error
  FROM j JOIN r ON r.seq = j.id
  WHERE j.status = 'ready_for_ai')
SELECT j.id,
       CASE WHEN res.error = false THEN 'analyzed' ELSE j.status END AS status,
       CASE WHEN res.error = false THEN res.score ELSE j.ai_score END AS ai_score,
       CASE WHEN res.error = false THEN res.summary ELSE j.ai_summary END AS ai_summary
FROM j LEFT JOIN res ON res.id = j.id
"""


@register("score_write_back", _write_back_sql())
def score_write_back(spark, sf_dir):
    """F10 + L3 + L4-L6 + L9/M6: eligible rows, title veto in front, the responses of the
    fixture as the model's answers, written back (failed rows stay ready_for_ai)."""
    j = jobs(spark, sf_dir).drop("description_raw")
    elig = SC.eligible(j).select("id", "title")
    v = rules.title_veto_columns(elig)
    resp = TD.scorer_responses(spark, sf_dir).withColumnRenamed("seq", "id")
    parsed = SC.parse_results(v.where(~F.col("vetoed")).join(resp, "id")).select(
        "id", "score", "summary", "error")
    vetoed = v.where("vetoed").select("id", F.lit(0).alias("score"), F.lit("vetoed").alias("summary"),
                                      F.lit(False).alias("error"))
    out = SC.apply_scores(j, parsed.unionByName(vetoed), F.lit(INGEST_AS_OF).cast("timestamp_ntz"))
    return out.select("id", "status", "ai_score", "ai_summary")


# The key after which the keyset page starts (score, created_at, id).
KEYSET_AFTER = (8, "2024-01-01 05:00:00", 300)


@register(
    "rank_keyset",
    f"""SELECT id, ai_score, created_at FROM ({S.scored_jobs(INCLUDE, EXCLUDE)})
        WHERE status <> 'discarded'
          AND (ai_score IS NULL OR ai_score < {KEYSET_AFTER[0]}
               OR (ai_score = {KEYSET_AFTER[0]}
                   AND (created_at < TIMESTAMP '{KEYSET_AFTER[1]}'
                        OR (created_at = TIMESTAMP '{KEYSET_AFTER[1]}' AND id < {KEYSET_AFTER[2]}))))
        ORDER BY ai_score DESC NULLS LAST, created_at DESC, id DESC LIMIT 50""",
)
def rank_keyset(spark, sf_dir):
    """T1/T2, deep-page form: the 50 rows after a given ranking key (no offset)."""
    import datetime as _dt

    after = (KEYSET_AFTER[0], _dt.datetime.fromisoformat(KEYSET_AFTER[1]), KEYSET_AFTER[2])
    page = listing.keyset_page(jobs(spark, sf_dir), after, listing.JobFilter(exclude_status=("discarded",)), 50)
    return page.select("id", "ai_score", "created_at")


# Plain words (letters a-z, 3 or more) that start a posting's title.
_TITLE_WORD = r"^([a-z]{3,})([^\p{L}\p{N}_]|$)"


def _word_hits_sql() -> str:
    word = f"regexp_extract(lower(title), '{_TITLE_WORD}', 1)"
    edge = "[^\\p{L}\\p{N}_]"
    return f"""WITH p AS (SELECT seq, {S.content()} AS t FROM ({S.POSTINGS})),
        k AS (SELECT {word} AS keyword, min(seq) AS pos FROM ({S.POSTINGS}) GROUP BY 1)
        SELECT seq, 'titles' AS list_name, CAST(pos AS INTEGER) AS pos, keyword, true AS substring_hit,
               regexp_matches(t, '(^|{edge})' || keyword || '($|{edge})') AS word_hit
        FROM p JOIN k ON keyword <> '' AND contains(t, keyword)"""


@register("keyword_word_hits", _word_hits_sql())
def keyword_word_hits(spark, sf_dir):
    """J4 for a large keyword table, substring-only hits included: the first words of all
    titles against all postings."""
    p = TD.postings(spark, sf_dir)
    word = F.regexp_extract(F.lower("title"), _TITLE_WORD, 1)
    kw = p.select(word.alias("keyword"), "seq").where("keyword <> ''").groupBy("keyword").agg(F.min("seq").cast("int").alias("pos"))
    kw = kw.select(F.lit("titles").alias("list_name"), "pos", "keyword")
    return rules.keyword_hits(p, kw, max_literal_keywords=0)
