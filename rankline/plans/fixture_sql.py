"""DuckDB SQL builders for the oracle side of the registered queries.

These mirror, in plain SQL over the raw test tables, the views of
``rankline.sources.testdata`` and the rules of ``rankline.operators``. DuckDB differs
from Spark/Python on two points handled here: ``\\b`` is ASCII-only in RE2 (an explicit
letter-class boundary is used) and ``lower`` is not ``casefold`` (``ß`` -> ``ss``).
"""

from __future__ import annotations

import re

POSTINGS = """
SELECT doc_id AS seq,
       CASE WHEN n_chars % 5 = 0 THEN NULL
            ELSE CAST(CASE WHEN doc_id % 5 = 3 THEN doc_id - 2 ELSE doc_id END AS VARCHAR)
       END AS external_id,
       substr(split_part(text, chr(10), 1), 1, 80) AS title,
       concat('co', CAST(doc_id % 50 AS VARCHAR)) AS company,
       concat('https://example.com/jobs/', md5(text)) AS url,
       CASE WHEN doc_id % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END AS source,
       text AS description_raw,
       lang AS search_keyword,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS created_at
FROM documents
"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def fold(expr: str) -> str:
    return f"replace(lower({expr}), 'ß', 'ss')"


def content(title: str = "title", desc: str = "description_raw") -> str:
    return fold(f"{title} || chr(10) || coalesce({desc}, '')")


def has_sub(text: str, kw: str) -> str:
    return f"(strpos({text}, {q(kw.casefold())}) > 0)"


_W = "[\\p{L}\\p{N}_]"
_NW = "[^\\p{L}\\p{N}_]"


def _is_word_char(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def word_re(kw: str) -> str:
    """``\\b kw \\b`` with explicit Unicode classes: before a word character the
    boundary needs a non-word neighbour (or the edge), before a non-word character it
    needs a word neighbour."""
    k = kw.casefold()
    body = re.escape(k).replace("\\ ", " ")
    left = f"(^|{_NW})" if _is_word_char(k[0]) else _W
    right = f"($|{_NW})" if _is_word_char(k[-1]) else _W
    return left + body + right


def has_word(text: str, kw: str) -> str:
    return f"regexp_matches({text}, {q(word_re(kw))})"


def first_sub(text: str, kws) -> str:
    if not kws:
        return "CAST(NULL AS VARCHAR)"
    whens = " ".join(f"WHEN {has_sub(text, k)} THEN {q(k)}" for k in kws)
    return f"(CASE {whens} END)"


def word_count(text: str, kws) -> str:
    uniq = list(dict.fromkeys(kws))
    if not uniq:
        return "0"
    return "(" + " + ".join(f"CAST({has_word(text, k)} AS INTEGER)" for k in uniq) + ")"


def classify_cols(text: str, include, exclude) -> str:
    ex = first_sub(text, exclude)
    inc = first_sub(text, include)
    return (
        f"CASE WHEN {ex} IS NOT NULL THEN 'discarded' WHEN {inc} IS NOT NULL THEN 'ready_for_ai' "
        f"ELSE 'pending' END AS rule_status, "
        f"CASE WHEN {ex} IS NOT NULL THEN 'Palavra excluida: ' || {ex} END AS rule_reason"
    )


def scored_jobs(include, exclude) -> str:
    """Oracle twin of ``testdata.scored_jobs``."""
    return f"""
SELECT p.seq AS id, p.external_id, p.title, p.company, p.url, p.source,
       CASE WHEN p.search_keyword IS NOT NULL AND p.search_keyword <> ''
            THEN [p.search_keyword] ELSE []::VARCHAR[] END AS search_keywords,
       p.description_raw,
       CASE WHEN l.quality IS NOT NULL THEN 'analyzed' ELSE c.rule_status END AS status,
       c.rule_reason AS filter_reason,
       CAST(CASE WHEN l.quality IS NOT NULL THEN l.quality * 6 + p.seq % 5 END AS INTEGER) AS ai_score,
       CASE WHEN l.quality IS NOT NULL THEN 'quality ' || CAST(l.quality AS VARCHAR) END AS ai_summary,
       CASE WHEN l.quality IS NOT NULL THEN p.created_at + INTERVAL 1 HOUR END AS ai_analysis_at,
       p.created_at, p.created_at AS first_seen_at, p.created_at AS last_seen_at,
       p.created_at AS updated_at
FROM ({POSTINGS}) p
LEFT JOIN labels l ON l.doc_id = p.seq
JOIN (SELECT seq, {classify_cols(content(), include, exclude)} FROM ({POSTINGS}) x) c
  ON c.seq = p.seq
"""


STORED = f"""
WITH p AS (SELECT * FROM ({POSTINGS}) WHERE seq % 3 <> 0),
k AS (
  SELECT *, min(seq) OVER (PARTITION BY source, external_id) AS first_ext,
            min(seq) OVER (PARTITION BY source, url) AS first_url
  FROM p)
SELECT seq AS id, external_id, title, company, url, source, [search_keyword] AS search_keywords,
       description_raw, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS salary,
       'pending' AS status, CAST(NULL AS VARCHAR) AS filter_reason,
       CAST(NULL AS INTEGER) AS ai_score, CAST(NULL AS VARCHAR) AS ai_summary,
       CAST(NULL AS TIMESTAMP) AS ai_analysis_at, created_at, created_at AS first_seen_at,
       created_at AS last_seen_at, created_at AS updated_at
FROM k
WHERE (external_id IS NULL OR first_ext = seq) AND first_url = seq
"""

INCOMING = f"""
SELECT seq, external_id,
       CASE WHEN seq % 4 = 0 THEN title || ' (v2)' ELSE title END AS title,
       company, url, source, description_raw, search_keyword,
       CAST(NULL AS VARCHAR) AS location, CAST(NULL AS VARCHAR) AS salary, created_at
FROM ({POSTINGS})
"""


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


RESPONSES = f"""
SELECT seq, CASE seq % 9
  WHEN 0 THEN '{{"score": ' || n || ', "summary": "' || s || '"}}'
  WHEN 1 THEN 'Resultado: {{"score": ' || n || ', "summary": "' || s || '"}} fim'
  WHEN 2 THEN '{{"score": "' || n || '", "summary": "' || s || '"}}'
  WHEN 3 THEN '{{"score": -' || n || ', "summary": "' || s || '"}}'
  WHEN 4 THEN '{{"score": ' || CAST(seq % 13 + 10 AS VARCHAR) || ', "summary": "' || s || '"}}'
  WHEN 5 THEN '{{"score": true, "summary": ' || n || '}}'
  WHEN 6 THEN '{{"score": ' || n || ', "summary": "' || s || '"'
  WHEN 7 THEN '{{"summary": "   ", "other": ' || n || '.75}}'
  ELSE 'Resposta: [{{"score": ' || n || '.75, "summary": "' || s || '"}}]'
END AS response
FROM (SELECT seq, CAST(seq % 13 AS VARCHAR) AS n,
             replace(replace(title, '\\', ''), '"', '') AS s FROM ({POSTINGS}))
"""

NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parsed_responses(src: str) -> str:
    """L4-L6 in DuckDB over ``src(seq, response)``."""
    sc = "json_type(v, '$.score')"
    sv = "json_extract_string(v, '$.score')"
    num = f"CAST(trunc(greatest(0, least(10, CAST({{x}} AS DOUBLE)))) AS INTEGER)"
    return f"""
WITH b AS (
  SELECT seq, response,
         CASE WHEN json_valid(response) THEN
              CASE WHEN json_type(response) = 'OBJECT' THEN response END END AS v1,
         regexp_extract(response, '(?s)\\{{.*\\}}', 0) AS sn
  FROM ({src})),
c AS (
  SELECT seq, coalesce(v1, CASE WHEN json_valid(sn) THEN
                                CASE WHEN json_type(sn) = 'OBJECT' THEN sn END END) AS v
  FROM b)
SELECT seq,
  CASE WHEN v IS NULL THEN NULL
       WHEN {sc} = 'BOOLEAN' THEN CASE WHEN {sv} = 'true' THEN 1 ELSE 0 END
       WHEN {sc} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN {num.format(x=sv)}
       WHEN {sc} = 'VARCHAR' AND regexp_matches({strip(sv)}, {q(NUMBER_RE)})
            THEN {num.format(x=strip(sv))}
       ELSE 0 END AS score,
  CASE WHEN v IS NULL THEN NULL
       WHEN json_type(v, '$.summary') = 'VARCHAR'
            AND {strip("json_extract_string(v, '$.summary')")} <> ''
            THEN substr({strip("json_extract_string(v, '$.summary')")}, 1, 1000)
       ELSE 'Resumo indisponivel.' END AS summary,
  v IS NULL AS error
FROM c
"""


def _distinct(a: str, b: str) -> str:
    return f"({a} IS DISTINCT FROM {b})"


IDENTITY = f"""
WITH s AS ({STORED}), i AS ({INCOMING})
SELECT i.*, se.id AS e_id, su.id AS u_id, coalesce(se.id, su.id) AS matched_id
FROM i LEFT JOIN s se ON se.source = i.source AND se.external_id = i.external_id
       LEFT JOIN s su ON su.source = i.source AND su.url = i.url
"""

COMPARED = ["title", "company", "url", "description_raw", "location", "salary", "created_at"]


def changed_fields(a: str, b: str) -> str:
    parts = ", ".join(f"CASE WHEN {_distinct(f'{a}.{c}', f'{b}.{c}')} THEN '{c}' END" for c in COMPARED)
    return f"concat_ws(',', {parts})"


def upsert_single(include, exclude, with_failed: bool = True) -> str:
    st = strip
    valid = (f"title <> '' AND company <> '' AND url <> '' AND source <> '' AND "
             f"coalesce(length(external_id), 0) <= 255 AND length(title) <= 255 AND "
             f"length(company) <= 255 AND length(source) <= 50")
    return f"""
WITH s AS ({STORED}),
i0 AS ({INCOMING}),
ic AS (
  SELECT seq, nullif({st('external_id')}, '') AS external_id, {st('title')} AS title,
         {st('company')} AS company, {st('url')} AS url, lower({st('source')}) AS source,
         coalesce({st('description_raw')}, '') AS description_raw,
         nullif({st('search_keyword')}, '') AS search_keyword,
         {st('location')} AS location, {st('salary')} AS salary, created_at
  FROM i0),
i AS (SELECT *, {word_count(content(), include)} >= 3 AS passes,
             {classify_cols(content(), include, exclude)}
      FROM ic WHERE {valid}),
m AS (SELECT i.*, se.id AS e_id, su.id AS u_id, coalesce(se.id, su.id) AS mid
      FROM i LEFT JOIN s se ON se.source = i.source AND se.external_id = i.external_id
             LEFT JOIN s su ON su.source = i.source AND su.url = i.url),
ne AS (SELECT source, external_id, count(*) AS n_e FROM m WHERE external_id IS NOT NULL
       GROUP BY source, external_id),
nu AS (SELECT source, url, count(*) AS n_u FROM m GROUP BY source, url),
t AS (SELECT sid, count(*) AS n_touch FROM (
        SELECT e_id AS sid FROM m WHERE e_id IS NOT NULL
        UNION ALL
        SELECT u_id AS sid FROM m WHERE u_id IS NOT NULL AND (e_id IS NULL OR e_id <> u_id))
      GROUP BY sid),
f AS (SELECT m.* FROM m LEFT JOIN ne ON ne.source = m.source AND ne.external_id = m.external_id
                        LEFT JOIN nu ON nu.source = m.source AND nu.url = m.url
                        LEFT JOIN t ON t.sid = m.mid
      WHERE coalesce(n_e, 1) = 1 AND n_u = 1
        AND NOT (e_id IS NOT NULL AND u_id IS NOT NULL AND e_id <> u_id)
        AND (mid IS NULL OR n_touch = 1)),
c AS (
  SELECT f.*, cur.title AS c_title, cur.status AS c_status, cur.filter_reason AS c_reason,
         cur.search_keywords AS c_kws,
         f.search_keyword IS NOT NULL
           AND NOT coalesce(list_contains(cur.search_keywords, f.search_keyword), false) AS kw_new,
         {changed_fields('f', 'cur')} <> '' AS fields_changed
  FROM f LEFT JOIN s cur ON cur.id = f.mid),
o AS (
  SELECT *, CASE WHEN mid IS NOT NULL AND (kw_new OR fields_changed) THEN 'updated'
                 WHEN mid IS NOT NULL THEN 'skipped'
                 WHEN passes THEN 'inserted' ELSE 'discarded' END AS outcome
  FROM c)
SELECT seq, outcome, mid AS matched_id, source, search_keyword AS term,
       CASE WHEN outcome = 'skipped' THEN c_title ELSE title END AS title,
       CASE WHEN outcome = 'inserted' THEN rule_status
            WHEN outcome = 'updated' AND c_status <> 'analyzed' THEN rule_status
            WHEN mid IS NOT NULL THEN c_status END AS status,
       CASE WHEN outcome = 'inserted' THEN rule_reason
            WHEN outcome = 'updated' AND c_status <> 'analyzed' THEN rule_reason
            WHEN mid IS NOT NULL THEN c_reason END AS filter_reason,
       array_to_string(CASE
            WHEN outcome IN ('inserted', 'discarded') THEN
                 CASE WHEN search_keyword IS NOT NULL THEN [search_keyword] ELSE []::VARCHAR[] END
            WHEN outcome = 'updated' AND kw_new THEN list_append(c_kws, search_keyword)
            ELSE c_kws END, ',') AS search_keywords
FROM o
""" + (f"""
UNION ALL
SELECT seq, 'failed', NULL, source, search_keyword, NULL, NULL, NULL, NULL
FROM ic WHERE NOT ({valid})""" if with_failed else "")


def batch_in_order(stored: str, incoming: str, include, exclude) -> str:
    """The batch payload after payload (W4), as a recursive CTE ``t`` keyed by ``(kind, k)``:
    kind ``row`` holds table rows (``k`` = stored id, or -seq - 1 if a payload inserted it),
    ``out`` one outcome per valid payload, ``clock`` the last payload applied. ``bad`` holds the
    invalid payloads."""
    st = strip
    valid = ("title <> '' AND company <> '' AND url <> '' AND source <> '' AND "
             "coalesce(length(external_id), 0) <= 255 AND length(title) <= 255 AND "
             "length(company) <= 255 AND length(source) <= 50")
    fields = ["source", "external_id", "title", "company", "url", "description_md5", "location", "salary", "created_at"]
    same = " AND ".join(f"w.{c} IS NOT DISTINCT FROM p.{c}" for c in fields[2:])
    term = "CASE WHEN p.search_keyword IS NULL THEN []::VARCHAR[] ELSE [p.search_keyword] END"
    new = "p.search_keyword IS NOT NULL AND NOT coalesce(list_contains(w.kws, p.search_keyword), false)"
    ruled = "outcome = 'inserted' OR w_status <> 'analyzed'"
    return f"""
WITH RECURSIVE ic AS (
  SELECT seq, nullif({st('external_id')}, '') AS external_id, {st('title')} AS title,
         {st('company')} AS company, {st('url')} AS url, lower({st('source')}) AS source,
         coalesce({st('description_raw')}, '') AS description_raw,
         nullif({st('search_keyword')}, '') AS search_keyword,
         {st('location')} AS location, {st('salary')} AS salary, created_at
  FROM ({incoming})),
bad AS (SELECT * FROM ic WHERE NOT ({valid})),
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY seq) AS n, * EXCLUDE (description_raw), md5(description_raw) AS description_md5,
         {word_count(content(), include)} >= 3 AS passes, {classify_cols(content(), include, exclude)}
  FROM ic WHERE {valid}),
t(kind, k, {", ".join(fields)}, kws, status, reason, outcome, row_k, n) USING KEY (kind, k) AS (
  SELECT 'row', id, source, external_id, title, company, url, md5(description_raw), location, salary, created_at,
         search_keywords, status, filter_reason, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  FROM ({stored})
  UNION ALL
  SELECT 'clock', 0, {", ".join("NULL" for _ in fields)}, NULL, NULL, NULL, NULL, NULL, 0
  UNION
  SELECT x.kind, CASE x.kind WHEN 'row' THEN d.row_k WHEN 'out' THEN d.seq ELSE 0 END,
         d.source, CASE WHEN d.outcome = 'updated' THEN d.w_ext ELSE d.external_id END,
         {", ".join("d." + c for c in fields[2:])},
         CASE WHEN d.outcome = 'inserted' THEN d.term WHEN d.kw_new THEN list_append(d.w_kws, d.search_keyword) ELSE d.w_kws END,
         CASE WHEN {ruled} THEN d.rule_status ELSE d.w_status END,
         CASE WHEN {ruled} THEN d.rule_reason ELSE d.w_reason END,
         d.outcome, d.row_k, d.n
  FROM (
    SELECT p.*, {term} AS term, {new} AS kw_new, w.external_id AS w_ext, w.kws AS w_kws, w.status AS w_status,
           w.reason AS w_reason,
           CASE WHEN w.k IS NULL AND p.passes THEN 'inserted' WHEN w.k IS NULL THEN 'discarded'
                WHEN NOT ({new}) AND {same} THEN 'skipped' WHEN u.k <> w.k THEN 'failed' ELSE 'updated' END AS outcome,
           CASE WHEN w.k IS NOT NULL THEN w.k WHEN p.passes THEN -p.seq - 1 END AS row_k
    FROM t c JOIN v p ON c.kind = 'clock' AND p.n = c.n + 1
    LEFT JOIN recurring.t e ON e.kind = 'row' AND e.source = p.source AND e.external_id = p.external_id
    LEFT JOIN recurring.t u ON u.kind = 'row' AND u.source = p.source AND u.url = p.url
    LEFT JOIN recurring.t w ON w.kind = 'row' AND w.k = coalesce(e.k, u.k)
  ) d, (VALUES ('row'), ('out'), ('clock')) x(kind)
  WHERE x.kind <> 'row' OR d.outcome IN ('inserted', 'updated')
)"""


def batch_outcomes(include, exclude) -> str:
    """Outcome of every payload of the fixture batch, with the final state of its row."""
    return f"""{batch_in_order(STORED, INCOMING, include, exclude)}
SELECT v.seq, o.outcome, CASE WHEN o.row_k >= 0 THEN o.row_k END AS matched_id, v.source, v.search_keyword AS term,
       coalesce(r.title, v.title) AS title, r.status, r.reason AS filter_reason,
       array_to_string(CASE WHEN r.k IS NOT NULL THEN r.kws WHEN v.search_keyword IS NULL THEN []::VARCHAR[]
                            ELSE [v.search_keyword] END, ',') AS search_keywords
FROM v JOIN t o ON o.kind = 'out' AND o.k = v.seq LEFT JOIN t r ON r.kind = 'row' AND r.k = o.row_k
UNION ALL
SELECT seq, 'failed', NULL, source, search_keyword, NULL, NULL, NULL, NULL FROM bad"""
