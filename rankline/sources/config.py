"""Rule profiles (S4-S6): ``profile_id`` plus the three keyword lists.

One profile reproduces the single rule set of the reference; several let the rules run for
every (posting, profile) pair, the profile lists inlined as literals, so many to a scan. Keyword lists are normalised (N11) on read.
"""

from __future__ import annotations

import contextlib
import importlib.util
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.functions import text as TX

PROFILE_SCHEMA = ("profile_id long, search_terms array<string>, include_keywords array<string>, "
                  "exclude_keywords array<string>, updated_at timestamp_ntz")
LISTS = ("search_terms", "include_keywords", "exclude_keywords")
# profiles that become literal expressions of one projection; further ones get further scans
PROFILES_PER_SCAN = 64


def normalize_list(col) -> F.Column:
    """N11 on an array column: strip, drop blanks, keep order and duplicates; null -> []."""
    return F.coalesce(
        F.filter(F.transform(col, TX.py_strip), lambda x: x.isNotNull() & (x != "")),
        F.array().cast("array<string>"),
    )


# where the rules file keeps each list
YAML_PLACES = {"search_terms": ["search_terms"], "include_keywords": ["filters", "include_keywords"],
               "exclude_keywords": ["filters", "exclude_keywords"]}


def clean_terms(value) -> list[str]:
    """N11 for one plain value: its stripped non-blank strings; anything but a list is empty."""
    found = map(str.strip, filter(lambda x: isinstance(x, str), value if isinstance(value, (list, tuple)) else ()))
    return [x for x in found if x]


def load_yaml_rules(path: str) -> dict:
    """The rules file as a profile; lists that it does not hold, or a file that cannot be
    read as YAML, are empty."""
    tree: object = None
    if importlib.util.find_spec("yaml") and os.path.isfile(path):
        import yaml

        with open(path, encoding="utf-8") as file, contextlib.suppress(yaml.YAMLError, UnicodeDecodeError):
            tree = yaml.safe_load(file)

    def at(place: list[str]):
        return reduce(lambda node, key: node.get(key) if isinstance(node, dict) else None, place, tree)

    return {name: clean_terms(at(place)) for name, place in YAML_PLACES.items()}


def active_profile(spark: SparkSession, profiles: DataFrame | None, fallback: dict) -> dict:
    """Profile 1, else the lowest profile id, else the fallback lists. A stored profile
    wins completely (no merging with the fallback). Returns plain lists (config-sized)."""
    if profiles is not None:
        rows = (profiles.select("profile_id", *[normalize_list(F.col(c)).alias(c) for c in LISTS])
                .orderBy(F.when(F.col("profile_id") == 1, 0).otherwise(1), "profile_id").limit(1).collect())
        if rows:
            return {c: list(rows[0][c]) for c in LISTS}
    return {c: list(fallback.get(c, [])) for c in LISTS}


def seed_if_empty(spark: SparkSession, profiles: DataFrame, seed: dict, as_of) -> DataFrame:
    """The seed lists become profile 1 only when no profile exists."""
    seed_df = spark.createDataFrame(
        [(1, seed.get("search_terms", []), seed.get("include_keywords", []),
          seed.get("exclude_keywords", []))],
        "profile_id long, search_terms array<string>, include_keywords array<string>, "
        "exclude_keywords array<string>",
    ).withColumn("updated_at", as_of)
    add = seed_df.where(F.lit(profiles.limit(1).count() == 0))
    return profiles.unionByName(add)


def patch(profiles: DataFrame, patches: DataFrame, as_of) -> DataFrame:
    """``patches(profile_id, search_terms?, include_keywords?, exclude_keywords?)``; only
    the lists given (non-null) change, normalised; ``updated_at`` moves when any list was
    given, even an equal one."""
    p = patches.select("profile_id", *[F.col(c).alias(f"__new_{c}") for c in LISTS])
    j = profiles.join(p, "profile_id", "left")
    given = F.lit(False)
    for c in LISTS:
        given = given | F.col(f"__new_{c}").isNotNull()
        j = j.withColumn(c, F.when(F.col(f"__new_{c}").isNotNull(), normalize_list(F.col(f"__new_{c}")))
                         .otherwise(F.col(c)))
    j = j.withColumn("updated_at", F.when(given, as_of).otherwise(F.col("updated_at")))
    return j.select(*profiles.columns)


def rules_per_profile(postings: DataFrame, profiles: DataFrame, threshold: int = 3,
                      key: str = "seq") -> DataFrame:
    """F2 and F5 for every (posting, profile) pair: the lists of ``PROFILES_PER_SCAN``
    profiles at a time become literal expressions of one scan, each posting row carries one
    struct per profile, and ``inline`` turns them into rows
    ``key, profile_id, status, filter_reason, match_count, passes``."""
    rows = profiles.select("profile_id", *[normalize_list(F.col(c)).alias(c) for c in LISTS]).collect()
    if not rows:
        raise ValueError("no rule profile")
    parts = [_rules_of(postings, rows[i:i + PROFILES_PER_SCAN], threshold, key) for i in range(0, len(rows), PROFILES_PER_SCAN)]
    return reduce(DataFrame.unionAll, parts)


def _rules_of(postings: DataFrame, rows: list, threshold: int, key: str) -> DataFrame:
    from rankline.operators import rules

    per = []
    for r in rows:
        inc, exc = list(r.include_keywords), list(r.exclude_keywords)
        status, reason = rules.classification(inc, exc)
        kws = list(dict.fromkeys(inc))
        count = (TX.distinct_word_hits(rules.content_col(), kws) if kws else F.lit(0))
        per.append(F.struct(
            F.lit(r.profile_id).alias("profile_id"), status.alias("status"),
            reason.alias("filter_reason"), count.alias("match_count"),
            ((count >= threshold) if kws else F.lit(True)).alias("passes"),
        ))
    return postings.select(F.col(key), F.inline(F.array(*per)))
