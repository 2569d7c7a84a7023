"""Registered queries of the feeds, the rule profiles, table maintenance and the scorer stage,
each with its DuckDB oracle. They add to the queries of ``rankline.plans.queries``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.functions import parse as PR
from rankline.operators import listing, rules
from rankline.operators import maintain as MT
from rankline.operators import scoring as SC
from rankline.plans import fixture_sql as S
from rankline.plans.queries import AS_OF, EXCLUDE, INCLUDE, jobs, register
from rankline.sources import config as CF
from rankline.sources import feeds as FD
from rankline.sources import testdata as TD

JOBS_SQL = S.scored_jobs(INCLUDE, EXCLUDE)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# ---------------------------------------------------------------- feeds from JSON texts
# Sizes of the derived fetches, their checkpoint, and the cut of one cycle.
A_FETCH, B_FETCH, B_PAGE = 20, 40, 10
FEED_CHECKPOINT = "2024-01-01 01:27:00"
FEED_LIMIT = 15
BASE_URL = "https://example.org"


def _raw_postings(spark, sf_dir) -> DataFrame:
    """Postings in feed field values, newest first inside a fetch: dates with and without an
    offset, some unreadable; fractional amounts; missing names and addresses."""
    p = TD.postings(spark, sf_dir).withColumn("n", F.length("description_raw"))
    wall = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    date = F.when(F.expr("seq % 7 = 0"), F.lit("soon")).when(F.expr("seq % 3 = 1"), F.concat(wall, F.lit("+02:00"))).otherwise(wall)
    return p.withColumns({
        "date": date,
        "lo": F.expr("CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE n * 100 + (seq % 2) / 2 END").cast("decimal(18,1)"),
        "hi": F.expr("CASE WHEN seq % 3 = 0 THEN NULL ELSE n * 130 END").cast("long"),
        "name": F.expr("CASE WHEN seq % 17 <> 0 THEN company END"),
        "link": F.expr("CASE WHEN seq % 3 <> 0 THEN url END"),
    })


def _joined(rows: DataFrame, by: list[str], element) -> DataFrame:
    """One JSON list body per fetch or page (a fixed number of postings), newest first."""
    made = rows.groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(F.struct("seq", element.alias("j"))))).alias("l"))
    return made.withColumn("body", F.array_join(F.transform("l", lambda x: x["j"]), ", ")).drop("l")


def feed_a_texts(spark, sf_dir) -> DataFrame:
    entry = F.to_json(F.struct(
        F.col("external_id").alias("id"), F.col("title").alias("position"), F.col("name").alias("company"),
        F.col("link").alias("url"), F.expr("CASE WHEN seq % 9 <> 0 THEN url END").alias("apply_url"),
        F.col("description_raw").alias("description"), F.expr("CASE WHEN seq % 6 = 0 THEN '' ELSE search_keyword END").alias("location"),
        F.col("lo").alias("salary_min"), F.col("hi").alias("salary_max"), "date"))
    made = _joined(_raw_postings(spark, sf_dir).withColumn("f", F.expr(f"seq div {A_FETCH}")), ["f"], entry)
    text = F.concat(F.when(F.col("f") % 13 == 0, "no list ").otherwise(""), F.lit('["notice", {"legal": "terms"}, 5, '), "body", F.lit("]"))
    return made.select(F.col("f").cast("string").alias("fetch_id"), text.alias("value"))


def feed_b_texts(spark, sf_dir) -> DataFrame:
    def named(sql: str):
        return F.expr(f"CASE WHEN {sql} IS NOT NULL THEN named_struct('name', {sql}) END")

    row = F.to_json(F.struct(
        F.col("external_id").cast("long").alias("id"), "title", F.col("description_raw").alias("description"),
        F.expr("CASE seq % 6 WHEN 1 THEN '100% Remoto' WHEN 5 THEN 'Remoto' END").alias("subtitle"),
        F.col("date").alias("createdAt"), F.col("link").alias("externalLink"),
        named("CASE WHEN seq % 4 <> 0 THEN name END").alias("company"), F.col("name").alias("companyDisplayName"),
        named("CASE WHEN seq % 4 = 0 THEN company END").alias("city"),
        named("CASE WHEN seq % 8 IN (0, 2) THEN search_keyword END").alias("country"),
        F.when(F.expr("seq % 11 <> 0"), F.struct(F.col("lo").alias("from"), F.col("hi").alias("to"),
                                                 F.expr("CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'usd' ELSE 'brl' END").alias("currency"),
                                                 F.expr("CASE WHEN seq % 2 = 0 THEN 'uninformed' ELSE 'monthly' END").alias("type"))).alias("jobSalary")))
    raw = _raw_postings(spark, sf_dir).withColumn("f", F.expr(f"seq div {B_FETCH}"))
    raw = raw.withColumn("page", F.expr(f"1 + ({B_FETCH - 1} - seq % {B_FETCH}) div {B_PAGE}").cast("int"))
    made = _joined(raw, ["f", "page"], row)
    meta = F.when(F.col("f") % 3 == 0, '{"last_page": 3}').otherwise("null")
    body = F.when(F.expr("f % 3 = 1 AND page = 3"), "").otherwise(F.concat(F.lit('"junk", '), "body"))
    text = F.concat(F.when(F.expr("f % 11 = 0 AND page = 2"), "no object ").otherwise(""), F.lit('{"meta": '), meta, F.lit(', "data": ['), body, F.lit("]}"))
    return made.select(F.col("f").cast("string").alias("fetch_id"), "page", text.alias("value"))


def feed_checkpoint(spark) -> DataFrame:
    rows = [(s, FEED_CHECKPOINT) for s in (FD.FEED_A_SOURCE, FD.FEED_B_SOURCE)]
    return spark.createDataFrame(rows, "source string, c string").select("source", F.col("c").cast("timestamp_ntz").alias("checkpoint"))


_RAW_SQL = f"""
  SELECT *, length(description_raw) AS n,
         CASE WHEN seq % 7 = 0 THEN TIMESTAMP '{AS_OF}' WHEN seq % 3 = 1 THEN created_at - INTERVAL 2 HOUR ELSE created_at END AS dated,
         CASE WHEN seq % 4 < 2 THEN 0 ELSE length(description_raw) * 100 END AS lo,
         CASE WHEN seq % 2 = 1 THEN '.5' ELSE '.0' END AS lo_part,
         CASE WHEN seq % 3 <> 0 THEN length(description_raw) * 130 ELSE 0 END AS hi,
         CASE WHEN seq % 17 <> 0 THEN company END AS name, CASE WHEN seq % 3 <> 0 THEN url END AS link
  FROM ({S.POSTINGS})"""


def _range_sql(cur: str) -> str:
    lo, hi = "format('{:,}', lo) || lo_part", "format('{:,}', hi)"
    return (f"CASE WHEN lo <> 0 AND hi <> 0 THEN {cur} || ' ' || {lo} || ' - ' || {cur} || ' ' || {hi} "
            f"WHEN lo <> 0 THEN {cur} || ' ' || {lo} || '+' WHEN hi <> 0 THEN {cur} || ' up to ' || {hi} END")


def _cut_sql(rows: str, valid: str) -> str:
    """Rows of each fetch above the newest one at or before the checkpoint, the first ones only."""
    return f"""
stops AS (SELECT *, max(CASE WHEN dated <= TIMESTAMP '{FEED_CHECKPOINT}' THEN seq END) OVER (PARTITION BY f) AS stop FROM ({rows})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY seq DESC) AS rank FROM stops WHERE stop IS NULL OR seq > stop)
SELECT CAST(f AS VARCHAR) AS fetch_id, external_id, title, name AS company, address AS url, location, salary,
       md5(description_raw) AS description_md5, dated AS created_at, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= {FEED_LIMIT} AND {valid}"""


FEED_A_SQL = f"""
WITH raw AS ({_RAW_SQL}),
rows_a AS (
  SELECT *, seq // {A_FETCH} AS f, coalesce(link, CASE WHEN seq % 9 <> 0 THEN url END) AS address,
         CASE WHEN seq % 6 <> 0 THEN nullif(search_keyword, '') END AS location, {_range_sql("'USD'")} AS salary
  FROM raw WHERE external_id IS NOT NULL AND title IS NOT NULL AND (seq // {A_FETCH}) % 13 <> 0),
{_cut_sql("SELECT * FROM rows_a WHERE title <> '' AND name IS NOT NULL AND address IS NOT NULL", "true")}"""

_CUR = "CASE seq % 5 WHEN 2 THEN 'USD' WHEN 0 THEN 'BRL' WHEN 1 THEN 'BRL' ELSE 'BRL' END"
_HINT = "coalesce(CASE seq % 6 WHEN 1 THEN '100% Remoto' WHEN 5 THEN 'Remoto' END, '') || ' ' || description_raw"
FEED_B_SQL = f"""
WITH raw AS ({_RAW_SQL}),
pages AS (SELECT *, seq // {B_FETCH} AS f, 1 + ({B_FETCH - 1} - seq % {B_FETCH}) // {B_PAGE} AS page, {_HINT} AS hint FROM raw),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY f, external_id ORDER BY seq DESC) AS copy FROM pages
  WHERE external_id IS NOT NULL AND external_id <> '0' AND title <> ''
    AND (f % 3 <> 0 OR page <= 3) AND (f % 3 <> 1 OR page < 3) AND (f % 11 <> 0 OR page < 2)),
rows_b AS (
  SELECT *, coalesce(link, '{BASE_URL}/job/' || external_id) AS address,
         CASE WHEN seq % 4 = 0 THEN company || CASE WHEN seq % 8 = 0 AND search_keyword <> '' THEN ', ' || search_keyword ELSE '' END
              WHEN seq % 8 = 2 AND search_keyword <> '' THEN search_keyword
              WHEN contains(hint, '100% Remoto') THEN '100% Remoto' WHEN contains(hint, 'Remoto') THEN 'Remoto' END AS location,
         CASE WHEN seq % 11 <> 0 AND seq % 2 = 0 AND lo = 0 AND hi = 0 THEN NULL
              WHEN seq % 11 <> 0 AND (lo <> 0 OR hi <> 0) THEN {_range_sql(_CUR)}
              ELSE nullif(regexp_extract(hint, {S.q('(?i)' + PR.SALARY_PATTERN)}, 1), '') END AS salary
  FROM firsts WHERE copy = 1),
{_cut_sql("SELECT * FROM rows_b", "name IS NOT NULL")}"""


def _payload_columns(rows: DataFrame) -> DataFrame:
    return rows.select("fetch_id", "external_id", "title", "company", "url", "location", "salary",
                       F.md5("description_raw").alias("description_md5"), "created_at", "rank")


def _feed_a_rows(spark, sf_dir) -> DataFrame:
    n = FD.normalize_feed_a(FD.parse_feed_a(feed_a_texts(spark, sf_dir)), F.lit("python"), as_of())
    return FD.cut_feed_a(n, feed_checkpoint(spark), FEED_LIMIT)


def _feed_b_rows(spark, sf_dir) -> DataFrame:
    rows = FD.parse_feed_b(feed_b_texts(spark, sf_dir))
    return FD.cut_feed_b(rows, F.lit("python"), feed_checkpoint(spark), FEED_LIMIT, as_of(), BASE_URL)


@register("feed_a", FEED_A_SQL)
def feed_a(spark, sf_dir):
    """JSON lists with junk elements and broken texts to payloads."""
    return _payload_columns(_feed_a_rows(spark, sf_dir))


@register("feed_b", FEED_B_SQL)
def feed_b(spark, sf_dir):
    """JSON pages to payloads."""
    return _payload_columns(_feed_b_rows(spark, sf_dir))


@register(
    "feed_union",
    f"""SELECT source, count(*) AS n, count(salary) AS n_salary
        FROM (SELECT '{FD.FEED_A_SOURCE}' AS source, salary FROM ({FEED_A_SQL})
              UNION ALL SELECT '{FD.FEED_B_SOURCE}', salary FROM ({FEED_B_SQL})) GROUP BY source""",
)
def feed_union(spark, sf_dir):
    """Payloads of both feeds as one table, counted by feed."""
    both = FD.union_feeds([_feed_a_rows(spark, sf_dir), _feed_b_rows(spark, sf_dir)])
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("salary").alias("n_salary"))


@register(
    "feed_errors",
    f"""SELECT DISTINCT 'a' AS feed, CAST(doc_id // {A_FETCH} AS VARCHAR) AS fetch_id, CAST(NULL AS INTEGER) AS page, 'malformed file' AS error
        FROM documents WHERE (doc_id // {A_FETCH}) % 13 = 0
        UNION ALL
        SELECT DISTINCT 'b', CAST(doc_id // {B_FETCH} AS VARCHAR), 2, 'malformed file' FROM documents
        WHERE (doc_id // {B_FETCH}) % 11 = 0 AND 1 + ({B_FETCH - 1} - doc_id % {B_FETCH}) // {B_PAGE} = 2""",
)
def feed_errors(spark, sf_dir):
    """Landed texts that are no fetch, as rows of their own."""
    a = FD.malformed(feed_a_texts(spark, sf_dir).withColumn("page", F.lit(None).cast("int")), FD.FEED_A_SOURCE)
    b = FD.malformed(feed_b_texts(spark, sf_dir), FD.FEED_B_SOURCE)
    out = a.withColumn("feed", F.lit("a")).unionByName(b.withColumn("feed", F.lit("b")))
    return out.select("feed", "fetch_id", "page", "error")


# The work list of one cycle.
PLAN_SOURCES, PLAN_TERMS = ["feed_a"], ["en", "fr"]


@register(
    "fetch_plan",
    f"""SELECT seq, source, search_keyword AS term FROM ({S.POSTINGS})
        WHERE source = 'feed_a' AND search_keyword IN ('en', 'fr')""",
)
def fetch_plan(spark, sf_dir):
    """The landed rows of every selected source with every term."""
    rows = TD.postings(spark, sf_dir).select("seq", "source", F.col("search_keyword").alias("term"))
    return FD.planned_fetches(rows, FD.fetch_plan(spark, PLAN_SOURCES, PLAN_TERMS)).select("seq", "source", "term")


# ---------------------------------------------------------------- rules and profiles
# The lists that stored rows are classified by anew.
NEW_INCLUDE, NEW_EXCLUDE = ["what", "with"], ["thing"]


@register(
    "reclassify",
    f"""WITH j AS ({JOBS_SQL}), c AS (SELECT *, {S.classify_cols(S.content(), NEW_INCLUDE, NEW_EXCLUDE)} FROM j),
        r AS (SELECT *, CASE WHEN status = 'analyzed' THEN status ELSE rule_status END AS s,
                     CASE WHEN status = 'analyzed' THEN filter_reason ELSE rule_reason END AS why FROM c)
        SELECT id, s AS status, why AS filter_reason,
               CASE WHEN s IS DISTINCT FROM status OR why IS DISTINCT FROM filter_reason THEN TIMESTAMP '{AS_OF}'
                    ELSE updated_at END AS updated_at
        FROM r""",
)
def reclassify(spark, sf_dir):
    """changed rule lists over stored rows."""
    r = rules.reclassify(jobs(spark, sf_dir), NEW_INCLUDE, NEW_EXCLUDE, as_of())
    return r.select("id", "status", "filter_reason", "updated_at")


def _profiles(spark, sf_dir) -> DataFrame:
    """A profile per posting: title words, with blanks and padding, as its lists."""
    p = TD.postings(spark, sf_dir)
    words = F.split("title", " ")
    return p.select(F.col("seq").alias("profile_id"), F.array("search_keyword").alias("search_terms"),
                    F.transform(words, lambda w: F.concat(F.lit(" "), w)).alias("include_keywords"),
                    F.array(F.lit(" "), "company").alias("exclude_keywords"), F.col("created_at").alias("updated_at"))


_PROFILE_SQL = f"""SELECT seq AS profile_id, [search_keyword] AS search_terms,
       list_transform(string_split(title, ' '), lambda w: ' ' || w) AS include_keywords,
       [' ', company] AS exclude_keywords, created_at AS updated_at FROM ({S.POSTINGS})"""


@register(
    "profile_patch",
    f"""SELECT p.profile_id, array_to_string(search_terms, '|') AS search_terms,
               array_to_string(CASE WHEN quality >= 1 THEN ['q' || quality] ELSE include_keywords END, '|') AS include_keywords,
               array_to_string(CASE WHEN quality = 0 THEN [] ELSE exclude_keywords END, '|') AS exclude_keywords,
               CASE WHEN quality IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at
        FROM ({_PROFILE_SQL}) p LEFT JOIN labels l ON l.doc_id = p.profile_id""",
)
def profile_patch(spark, sf_dir):
    """Partial changes of stored profiles."""
    lab = TD.table(spark, sf_dir, "labels")
    changes = lab.select(
        F.col("doc_id").alias("profile_id"), F.lit(None).cast("array<string>").alias("search_terms"),
        F.expr("CASE WHEN quality >= 1 THEN array(concat(' q', quality), ' ') END").alias("include_keywords"),
        F.expr("CASE WHEN quality = 0 THEN array(' ', '') END").alias("exclude_keywords"))
    out = CF.patch(_profiles(spark, sf_dir), changes, as_of())
    return out.select("profile_id", *[F.array_join(c, "|").alias(c) for c in CF.LISTS], "updated_at")


@register(
    "active_profile_rules",
    f"""WITH k AS (SELECT * FROM ({_PROFILE_SQL}) ORDER BY CASE WHEN profile_id = 1 THEN 0 ELSE 1 END, profile_id LIMIT 1),
        w AS (SELECT {S.fold('trim(w)')} AS w FROM (SELECT unnest(include_keywords) AS w FROM k) WHERE trim(w) <> '')
        SELECT seq, CASE WHEN contains({S.content()}, (SELECT {S.fold('exclude_keywords[2]')} FROM k)) THEN 'discarded'
                         WHEN EXISTS (SELECT 1 FROM w WHERE contains({S.content()}, w.w)) THEN 'ready_for_ai'
                         ELSE 'pending' END AS status
        FROM ({S.POSTINGS})""",
)
def active_profile_rules(spark, sf_dir):
    """The active profile of a table (seeded if empty) classifies all postings."""
    stored = CF.seed_if_empty(spark, _profiles(spark, sf_dir), {"include_keywords": ["seed"]}, as_of())
    lists = CF.active_profile(spark, stored, {})
    p = rules.classify_columns(TD.postings(spark, sf_dir), lists["include_keywords"], lists["exclude_keywords"])
    return p.select("seq", F.col("rule_status").alias("status"))


# ---------------------------------------------------------------- maintenance and listing
_KEPT = f"status = 'analyzed' OR {S.word_count(S.content(), INCLUDE)} >= 3"


@register("cleanup_table", f"SELECT id, status, title, md5(description_raw) AS description_md5 FROM ({JOBS_SQL}) WHERE {_KEPT}")
def cleanup_table(spark, sf_dir):
    """The table after the cleanup."""
    t = MT.cleanup(jobs(spark, sf_dir), INCLUDE, 3)
    return t.select("id", "status", "title", F.md5("description_raw").alias("description_md5"))


@register(
    "cleanup_counters",
    f"""SELECT count_if(NOT ({_KEPT})) AS deleted, count_if(status <> 'analyzed' AND ({_KEPT})) AS kept FROM ({JOBS_SQL})""",
)
def cleanup_counters(spark, sf_dir):
    """A9."""
    return MT.cleanup_counters(MT.cleanup_flags(jobs(spark, sf_dir), INCLUDE, 3))


@register(
    "filtered_total",
    f"SELECT count(*) AS total FROM ({JOBS_SQL}) WHERE status IN ('analyzed', 'pending') AND ai_score >= 8",
)
def filtered_total(spark, sf_dir):
    """A2."""
    return listing.filtered_count(jobs(spark, sf_dir), listing.JobFilter(status=("analyzed", "pending"), min_score=8))


@register(
    "keyword_backfill",
    f"""SELECT seq, coalesce(nullif(search_keyword, ''), '') AS search_keywords, nullif(search_keyword, '') AS first_keyword
        FROM (SELECT seq, CASE WHEN seq % 10 = 0 THEN '' WHEN seq % 10 = 1 THEN NULL ELSE search_keyword END AS search_keyword
              FROM ({S.POSTINGS}))""",
)
def keyword_backfill(spark, sf_dir):
    """S8 and its inverse."""
    p = TD.postings(spark, sf_dir).select("seq", F.expr("CASE seq % 10 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE search_keyword END").alias("search_keyword"))
    lists = MT.backfill_keywords(p)
    back = MT.downgrade_keywords(lists.withColumn("all", F.array_join("search_keywords", "|")))
    return back.select("seq", F.col("all").alias("search_keywords"), F.col("search_keyword").alias("first_keyword"))


# ---------------------------------------------------------------- scoring
BATCH = 150


@register("scoring_batch", f"SELECT id FROM ({JOBS_SQL}) WHERE status = 'ready_for_ai' ORDER BY id LIMIT {BATCH}")
def scoring_batch(spark, sf_dir):
    """The rows of one scoring run."""
    return SC.batch_limit(SC.eligible(jobs(spark, sf_dir)), BATCH).select("id")


@register(
    "scoring_targets",
    f"""WITH e AS (SELECT DISTINCT user_id AS id FROM events)
        SELECT e.id, CASE WHEN j.id IS NULL THEN 'not_found' WHEN j.status = 'discarded' THEN 'discarded' ELSE 'eligible' END AS outcome
        FROM e LEFT JOIN ({JOBS_SQL}) j ON j.id = e.id""",
)
def scoring_targets(spark, sf_dir):
    """F10 for requested ids: unknown, discarded or to be scored."""
    ids = TD.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return SC.target_outcomes(jobs(spark, sf_dir), ids)


_SCORED_SQL = f"""
WITH r AS (SELECT id, title, {" OR ".join(S.has_word(S.fold("title"), k) for k in rules.NON_DEV_KEYWORDS)} AS vetoed
           FROM ({JOBS_SQL}) WHERE status = 'ready_for_ai')
SELECT id, vetoed, NOT vetoed AND (id % 7 = 0 OR id % 5 = 0) AS error,
       CAST(CASE WHEN vetoed THEN 0 WHEN id % 7 = 0 OR id % 5 = 0 THEN NULL ELSE id % 11 END AS INTEGER) AS score
FROM r"""


def _scorer():
    def score(rows: pd.DataFrame) -> pd.Series:
        """Answers by id: every seventh row raises, every fifth answer is no JSON."""
        if (rows["id"] % 7 == 0).any():
            raise ValueError("refused")
        return rows["id"].map(lambda i: "no answer" if i % 5 == 0 else f'Result: {{"score": {i % 11}, "summary": "row {i}"}}')

    return score


@register("scorer_stage", _SCORED_SQL)
def scorer_stage(spark, sf_dir):
    """The local veto, then a scorer that fails on single rows."""
    out = SC.run_scorer(SC.eligible(jobs(spark, sf_dir)), _scorer(), INCLUDE, EXCLUDE)
    return out.select("id", "vetoed", "error", "score")


@register("score_counters", f"SELECT count_if(NOT error) AS analyzed, count_if(error) AS failed FROM ({_SCORED_SQL})")
def score_counters(spark, sf_dir):
    """A9 of a scoring run."""
    return SC.score_counters(SC.run_scorer(SC.eligible(jobs(spark, sf_dir)), _scorer(), INCLUDE, EXCLUDE))


LEVEL_INCLUDE = [*INCLUDE, "Pleno"]


@register(
    "prompt_level",
    f"""SELECT seq, md5({S.q(SC.prompt_prefix(LEVEL_INCLUDE, EXCLUDE) + "Titulo da vaga: ")} || title ||
                 {S.q(chr(10) + "Descricao da vaga: ")} || {S.strip("coalesce(description_raw, '')")} ||
                 {S.q(SC.PROMPT_SUFFIX)}) AS prompt_md5
        FROM ({S.POSTINGS})""",
)
def prompt_level(spark, sf_dir):
    """L1, L2: the prompt with the level block."""
    p = TD.postings(spark, sf_dir)
    return p.select("seq", F.md5(SC.prompt_column(LEVEL_INCLUDE, EXCLUDE)).alias("prompt_md5"))


def _level_sql() -> str:
    title = "title || CASE seq % 6 WHEN 0 THEN ' junior' WHEN 1 THEN ' sênior' WHEN 2 THEN ' pleno' WHEN 3 THEN ' Junior / Senior' ELSE '' END"
    text = S.content("title2")
    points = " + ".join(f"CAST({S.has_sub('t', k)} AS INTEGER)" for k in LEVEL_INCLUDE)
    minus = " + ".join(f"CAST({S.has_sub('t', k)} AS INTEGER)" for k in EXCLUDE)
    veto = " OR ".join(S.has_word("ft", k) for k in rules.NON_DEV_KEYWORDS)

    def level(name: str) -> str:
        return "(" + " OR ".join(S.has_word("t", k) for k, v in SC.LEVEL_NORMALIZATION.items() if v == name) + ")"

    low, own, high = (level(x) for x in SC.LEVEL_ORDER)
    return f"""
WITH x AS (SELECT seq, {text} AS t, {S.fold('title2')} AS ft
           FROM (SELECT *, {title} AS title2 FROM ({S.POSTINGS}))),
y AS (SELECT seq, ({points}) AS points, ({minus}) AS minus, {veto} AS vetoed, {low} AS low, {own} AS own, {high} AS high FROM x)
SELECT seq, points, CAST(CASE WHEN vetoed OR (low AND NOT own AND NOT high) THEN 0 ELSE greatest(0, least(10,
         CASE WHEN points >= 5 THEN 10 WHEN points = 4 THEN 9 WHEN points = 3 THEN 8 WHEN points = 2 THEN 6 ELSE 4 END
         - minus - CASE WHEN high AND NOT own AND NOT low THEN 1 ELSE 0 END)) END AS INTEGER) AS score
FROM y"""


@register("rubric_level", _level_sql())
def rubric_level(spark, sf_dir):
    """L10 with a target level: titles that name levels below, at and above it."""
    mark = F.expr("CASE seq % 6 WHEN 0 THEN ' junior' WHEN 1 THEN ' sênior' WHEN 2 THEN ' pleno' WHEN 3 THEN ' Junior / Senior' ELSE '' END")
    p = TD.postings(spark, sf_dir).withColumn("title", F.concat("title", mark))
    return SC.rubric_score(p, LEVEL_INCLUDE, EXCLUDE).select("seq", "points", "score")
