"""Column builders for the text rules (casefold, substring and whole-word matches,
redaction, markup). Everything returns a ``Column`` so it stays inside codegen."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Casefold expansions beyond lower() of the sharp s, the final sigma, the micro
# sign, the long s and common ligatures. Other characters are only lower-cased: each further
# one adds a scan of the text to every text rule.
CASEFOLD_EXTRA = [("ß", "ss"), ("ς", "σ"), ("\u00b5", "\u03bc"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi")]


def casefold(col: Column | str) -> Column:
    """Spark equivalent of ``str.casefold`` for the characters above."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    for src, dst in CASEFOLD_EXTRA:
        c = F.replace(c, F.lit(src), F.lit(dst))
    return c


def casefold_each(arr: Column) -> Column:
    """``casefold`` of every element of a string array, done on one joined string per row
    instead of per element (casefolding never creates or removes the separator)."""
    sep = "\u0001"
    return F.when(F.size(arr) == 0, arr).otherwise(
        F.split(casefold(F.array_join(arr, sep)), sep)
    )


def casefold_py(s: str) -> str:
    """Driver-side casefold for keyword literals (config lists only)."""
    return s.casefold()


def word_pattern(keyword: str) -> str:
    """Java regex for ``\\b<keyword>\\b`` with Unicode word boundaries, keyword quoted."""
    return "(?U)\\b" + re.escape(casefold_py(keyword)).replace("\\ ", " ") + "\\b"


def has_word(text: Column, keyword: str) -> Column:
    """Whole-word match of one literal keyword against already casefolded text.

    A whole-word hit is also a substring hit, so a cheap ``instr`` runs first and the
    regex (a literal, compiled once per task) only where the keyword occurs at all."""
    return (F.instr(text, F.lit(casefold_py(keyword))) > 0) & text.rlike(word_pattern(keyword))


def has_substring(text: Column, keyword: str) -> Column:
    return F.instr(text, F.lit(casefold_py(keyword))) > 0


def first_substring_hit(text: Column, keywords: Sequence[str]) -> Column:
    """First keyword in list order whose casefolded form is a substring of ``text``
    (returns the keyword as configured), else null. A ``CASE`` chain keeps list order
    and stops at the first hit."""
    expr = None
    for kw in keywords:
        cond = has_substring(text, kw)
        expr = F.when(cond, F.lit(kw)) if expr is None else expr.when(cond, F.lit(kw))
    return expr if expr is not None else F.lit(None).cast("string")


def distinct_word_hits(text: Column, keywords: Sequence[str]) -> Column:
    """Number of keywords (distinct as given) with a whole-word match in ``text``."""
    uniq = list(dict.fromkeys(keywords))
    if not uniq:
        return F.lit(0)
    terms = [has_word(text, kw).cast("int") for kw in uniq]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def word_hits_in_order(text: Column, keywords: Sequence[str]) -> Column:
    """Array of the keywords (list order) that have a whole-word match in ``text``."""
    if not keywords:
        return F.array().cast("array<string>")
    parts = [F.when(has_word(text, kw), F.lit(kw)) for kw in keywords]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


# The characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(col: Column) -> Column:
    """``str.strip()``: remove leading/trailing whitespace (Spark ``trim`` only removes
    spaces). A character-set trim, no regex."""
    return F.btrim(col, F.lit(PY_WHITESPACE))


def blank_to_null(col: Column) -> Column:
    s = py_strip(col)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


# The three redaction rules (pattern, replacement) applied in this order.
REDACT_RULES = [
    (r"(?i)(postgres(?:ql)?(?:\+\w+)?://[^:]+:)[^@]+(@)", r"\1***\2"),
    (r"(?i)((?:api[_-]?key|token|secret|password|gemini_api_key)\s*[=:]\s*)\S+", r"\1***"),
    (r"(?i)(bearer\s+)\S+", r"\1***"),
]


def _java_replacement(repl: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", repl)


def redact(col: Column) -> Column:
    """Mask credentials in free text with the three rules above (Unicode classes, as Python)."""
    out = col
    for pattern, repl in REDACT_RULES:
        out = F.regexp_replace(out, "(?U)" + pattern, _java_replacement(repl))
    return out


# Markup detection and the entities decoded after tag removal.
MARKUP_PATTERN = r"(?is)</?[a-z].*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&amp;", "&")]


def looks_like_markup(col: Column) -> Column:
    return py_strip(col).rlike(MARKUP_PATTERN)


def strip_markup(col: Column) -> Column:
    """Plain text of an HTML string: drop script/style blocks and comments, turn tags into
    spaces, decode the common entities, squeeze whitespace."""
    out = F.regexp_replace(col, r"(?is)<script\b.*?</script\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    out = F.regexp_replace(out, r"[ \t\r\n]+", " ")
    return F.trim(out)
