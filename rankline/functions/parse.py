"""Column builders for feed field parsing: salary texts (N5-N7) and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The salary pattern searched in subtitle + description when a feed gives no
# structured salary (first match, case-insensitive).
SALARY_PATTERN = (
    r"(R\$\s?[\d\.,]+(?:\s*a\s*R\$\s?[\d\.,]+)?|\$\s?[\d,\.]+(?:\s*-\s*\$\s?[\d,\.]+)?|A combinar)"
)


def thousands(n: Column) -> Column:
    """``f"{n:,}"``: an integer, or a JSON number as its text, whose fraction is kept."""
    text = n.cast("string")
    whole = F.format_string("%,d", F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("long"))
    part = F.regexp_extract(text, r"^-?\d+\.(\d+?)0*$", 1)
    return F.when(text.rlike(r"^-?\d+$"), whole) \
        .when(text.rlike(r"^-?\d+\.\d+$"), F.concat(whole, F.lit("."), part)) \
        .otherwise(F.format_string("%,.1f", text.try_cast("double")))


def _truthy(n: Column) -> Column:
    return F.coalesce(n.try_cast("double"), F.lit(0.0)) != 0


def range_text(lo: Column, hi: Column, currency: Column) -> Column:
    """``CUR lo - CUR hi`` / ``CUR lo+`` / ``CUR up to hi``; null when both are 0 or null."""
    has_lo, has_hi = _truthy(lo), _truthy(hi)
    return (
        F.when(has_lo & has_hi, F.concat(currency, F.lit(" "), thousands(lo), F.lit(" - "),
                                         currency, F.lit(" "), thousands(hi)))
        .when(has_lo, F.concat(currency, F.lit(" "), thousands(lo), F.lit("+")))
        .when(has_hi, F.concat(currency, F.lit(" up to "), thousands(hi)))
    )


def salary_feed_a(salary_min: Column, salary_max: Column) -> Column:
    """Feed A salary text in USD."""
    return range_text(salary_min, salary_max, F.lit("USD"))


def salary_regex(text: Column) -> Column:
    """First salary-looking span of the text, else null."""
    m = F.regexp_extract(text, "(?i)" + SALARY_PATTERN, 1)
    return F.when(m != "", m)


def salary_feed_b(job_salary: Column, subtitle: Column, description: Column) -> Column:
    """N6 then N7: structured salary (currency upper-cased, default BRL; ``uninformed`` with
    no amounts gives null without looking at the text), else the text pattern."""
    lo, hi = job_salary["from"], job_salary["to"]
    cur_raw = F.upper(F.coalesce(job_salary["currency"], F.lit("")))
    cur = F.when(cur_raw == "", F.lit("BRL")).otherwise(cur_raw)
    typ = F.lower(F.coalesce(job_salary["type"], F.lit("")))
    structured = range_text(lo, hi, cur)
    text = F.concat(F.coalesce(subtitle, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    uninformed = job_salary.isNotNull() & (typ == "uninformed") & ~_truthy(lo) & ~_truthy(hi)
    return (
        F.when(uninformed, F.lit(None).cast("string"))
        .when(job_salary.isNotNull() & structured.isNotNull(), structured)
        .otherwise(salary_regex(text))
    )


def to_utc_ntz(ts: Column, session_tz: str = "UTC") -> Column:
    """An instant (``timestamp``) as ``timestamp_ntz`` UTC wall time, whatever the session
    time zone is."""
    local = ts.cast("timestamp_ntz")
    if session_tz.upper() in ("UTC", "Z", "+00:00", "ETC/UTC"):
        return local
    return F.convert_timezone(F.lit(session_tz), F.lit("UTC"), local)


# an offset after the time part (a date alone ends in "-dd", which is not one)
OFFSET_SUFFIX = r"[Tt ].*[0-9](Z|z|[+-][0-9]{2}(:?[0-9]{2})?)$"


# a whole date, alone or with a time and an offset; Spark alone would also read a year, a
# month, a time of day or a zone name
ISO_TEXT = (
    r"^[0-9]{4}(-[0-9]{2}-[0-9]{2}|[0-9]{4})"
    r"([Tt ][0-9]{2}(:?[0-9]{2}(:?[0-9]{2}([.,][0-9]+)?)?)?(Z|z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"
)


def parse_feed_timestamp(value: Column, as_of: Column, session_tz: str = "UTC") -> Column:
    """ISO-8601 text to UTC (naive means UTC, offsets converted); empty or unparseable
    text gives ``as_of``. Compact ISO (``20260325T160004Z``) is read too; ISO week dates are
    not supported. Naive text keeps its wall time whatever the session time zone (parse and
    cast back to ``timestamp_ntz`` in the same zone); text with an offset is an instant,
    moved from the session zone to UTC."""
    v = value
    parsed = F.when(v.rlike(ISO_TEXT), F.coalesce(
        F.try_to_timestamp(v),
        F.try_to_timestamp(v, F.lit("yyyyMMdd'T'HHmmssX")),
        F.try_to_timestamp(v, F.lit("yyyyMMdd'T'HHmmss")),
        F.try_to_timestamp(v, F.lit("yyyyMMdd")),
    ))
    wall = parsed.cast("timestamp_ntz")
    utc = F.when(v.rlike(OFFSET_SUFFIX), to_utc_ntz(parsed, session_tz)).otherwise(wall)
    return F.when(v.isNull() | (v == ""), as_of).otherwise(F.coalesce(utc, as_of))
