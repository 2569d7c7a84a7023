"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from rankline.llm import lines as lines_
from rankline.llm import quality as q

_CLASSES = ["[a-z]+", "[ \\t\\n\\v\\f\\r]+", "[A-Z]+", "[0-9]+", "[.,;:!?''\"()\\-]+", "[#*$%&|<>]+", "\\p{L}+"]


def _removed(k: int) -> str:
    text = "t"
    for runs in _CLASSES[:k]:
        text = f"regexp_replace({text}, '{runs}', '', 'g')"
    return f"length({text})"


def quality_rules() -> str:
    sizes = ", ".join(f"{_removed(k)} AS s{k}" for k in range(len(_CLASSES) + 1))
    chars = " UNION ALL ".join(
        f"SELECT r, lang, 'c' AS kind, {k} AS bin, s{k} - {f's{k + 1}' if k < len(_CLASSES) else 0} AS c FROM sizes" for k in range(len(_CLASSES) + 1))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
    sizes AS (SELECT r, lang, {sizes} FROM d),
    words AS (SELECT r, list_filter(regexp_split_to_array(t, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM d),
    grams AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
    covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY r),
    lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
              WHERE regexp_matches(l, '[^ \\t\\n\\v\\f\\r]') GROUP BY r),
    base AS (SELECT d.r, d.doc_id, d.lang, len(w) AS n_words, s0 - (s1 - s2) AS word_chars, s5 - s6 AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
                    coalesce(covered.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(w) AS base_failed
             FROM d JOIN sizes USING (r) JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
    plain AS (SELECT r, lang, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) AS w FROM d),
    common AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k
               FROM (SELECT lang, w, count(*) AS n FROM plain WHERE length(w) <= {q.COMMON_LENGTH} GROUP BY ALL)
               QUALIFY k <= {q.COMMON_WORDS}),
    bins AS ({chars}
             UNION ALL SELECT r, p.lang, 'w', coalesce(k, 0), count(*) FROM plain p LEFT JOIN common USING (lang, w) GROUP BY ALL),
    refs AS (SELECT bins.lang, kind, bin, sum(c) AS c FROM bins JOIN base USING (r) WHERE NOT base_failed GROUP BY ALL),
    totals AS (SELECT r, lang, kind, sum(c) AS n FROM bins GROUP BY ALL),
    ref_totals AS (SELECT lang, kind, sum(c) AS n FROM refs GROUP BY ALL),
    both_ AS (SELECT x.r, x.kind, coalesce(b.c, 0) / x.n AS p, f.c / y.n AS v
              FROM totals x JOIN ref_totals y USING (lang, kind) JOIN refs f USING (lang, kind)
              LEFT JOIN bins b ON b.r = x.r AND b.kind = x.kind AND b.bin = f.bin WHERE x.n > 0 AND y.n > 0
              UNION ALL
              SELECT x.r, x.kind, b.c / x.n, 0 FROM totals x JOIN bins b ON b.r = x.r AND b.kind = x.kind JOIN ref_totals y ON y.lang = x.lang AND y.kind = x.kind
              LEFT JOIN refs f ON f.lang = x.lang AND f.kind = x.kind AND f.bin = b.bin WHERE f.bin IS NULL AND x.n > 0 AND y.n > 0),
    js AS (SELECT r, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + v)) / 2 ELSE 0 END
                                               + CASE WHEN v > 0 THEN v * log2(2 * v / (p + v)) / 2 ELSE 0 END))) AS dist FROM both_ GROUP BY ALL),
    far_ AS (SELECT DISTINCT js.r FROM js JOIN base USING (r) JOIN totals USING (r, kind)
             WHERE (kind = 'c' AND word_chars >= {q.MIN_CHARS} AND dist > {q.MAX_CHARS_DISTANCE})
                OR (kind = 'w' AND totals.n >= {q.MIN_WORDS} AND dist > {q.MAX_WORDS_DISTANCE}))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
           n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND far_.r IS NULL AS kept
    FROM base LEFT JOIN far_ USING (r)"""


def line_dedup() -> str:
    return f"""
    WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
    lines AS (SELECT doc_id, line, l, trim(regexp_replace(lower(l), '[ \\t\\v\\f\\r]+', ' ', 'g'), ' ') AS norm FROM raw),
    classes AS (SELECT norm, string_split(norm, ' ') AS w, min({{'d': doc_id, 'l': line}}) AS first FROM lines WHERE norm <> '' GROUP BY norm),
    long_ AS (SELECT *, len(w) AS n FROM classes WHERE len(w) >= {lines_.MIN_WORDS}),
    halves AS (SELECT *, unnest(CASE WHEN n % 2 = 0 THEN [n // 2, n // 2 - 1] ELSE [n // 2] END) AS q FROM long_),
    keys AS (SELECT norm, w, n, first, q, w[1:q] AS part, 0 AS side FROM halves UNION ALL SELECT norm, w, n, first, q, w[n - q + 1:n], 1 FROM halves),
    pairs AS (SELECT DISTINCT a.norm, a.w AS x, b.w AS y, b.first AS other FROM keys a JOIN keys b USING (q, part, side) WHERE b.first < a.first AND abs(a.n - b.n) <= 1),
    edits AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i]), true), least(len(x), len(y)) + 1) AS p FROM pairs),
    near AS (SELECT norm, min(other) AS best FROM edits
             WHERE CASE WHEN len(x) = len(y) THEN x[p + 1:] = y[p + 1:] WHEN len(x) > len(y) THEN x[p + 1:] = y[p:] ELSE x[p:] = y[p + 1:] END GROUP BY norm),
    judged AS (SELECT doc_id, line, l, coalesce(best, first) AS kept, coalesce({{'d': doc_id, 'l': line}} > coalesce(best, first), false) AS gone
               FROM lines LEFT JOIN classes USING (norm) LEFT JOIN near USING (norm)),
    out AS (SELECT doc_id, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text,
                   list_sort(coalesce(list(DISTINCT kept.d) FILTER (gone), [])) AS kept_in FROM judged GROUP BY doc_id)
    SELECT doc_id, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN documents.text IS NULL THEN NULL ELSE md5(out.text) END AS text_md5,
           coalesce(array_to_string(kept_in, ','), '') AS kept_in FROM documents LEFT JOIN out USING (doc_id)"""
