"""Soft-membership mixing to target weights, in DataFrame functions only.

A classifier fitted on the labelled table (naive Bayes over a few text measures and over hits
in learned word lists) gives every document posteriors over the domains high, low and toxic.
Nonnegative rates r, one per document, are then fitted so that the expected tokens of each
domain, sum of r * tokens * posterior, meet the targets: least squares by projected gradient,

    r <- max(0, r - p . inv(M) (A r - target)),   M = sum of tokens * p p',

where only domain totals (three numbers) leave the executors in a step. M is the curvature of
the objective, so a full step is safe, and without the bound at 0 the first step would be exact.
A rate of 2.3 is two copies and a third with probability 0.3, decided by a hash of the row.

Defined cases: a null text has no tokens; labels without a doc_id or a label, and labels of
unknown documents, are ignored, and of repeated labels the largest counts; without any label
the posteriors are equal; rows that repeat an id are rated alike if their texts are; further
columns are kept as they are; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankline.llm.common import WORD_BREAK, free_names, own_columns, row_key, table

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.93, "low": 0.05, "toxic": 0.02}  # shares of the corpus' tokens
SAMPLE = 20_000  # labelled documents that the classifier is fitted on, at most
LIST_SIZE = 48  # words of a domain's list
LEAST_DOCS = 5  # labelled documents that a listed word is in, at least
STEPS, CLOSE = 40, 1e-4


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, domain): at most ``sample`` labelled ids, those with the smallest hashes."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")) \
        .agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    domain = F.when(F.col("t") > 0, "toxic").when(F.col("q") > 0, "high").otherwise("low")
    return one.select("__id", domain.alias("domain")).orderBy(F.xxhash64("__id"), "__id").limit(sample)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), " ")


def word_lists(sample: DataFrame) -> dict[str, list[str]]:
    """Per domain the words whose share of its documents most exceeds that of the others',
    by log odds; ``sample`` has domain and text."""
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    words = sample.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("w")).where("w <> ''")
    by = words.groupBy("w").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS])
    by = table(by.where(F.greatest(*DOMAINS) >= LEAST_DOCS), "words")
    total, lists = sum(sizes.values()), {}
    for d in DOMAINS:
        n, others = sizes.get(d, 0), total - sizes.get(d, 0)
        rest = sum((F.col(x) for x in DOMAINS if x != d), F.lit(0))
        odds = F.log((F.col(d) + 0.5) / (n + 1.0)) - F.log((rest + 0.5) / (others + 1.0))
        top = by.where(F.col(d) >= LEAST_DOCS).select("w", odds.alias("odds")).where("odds > 1").orderBy(F.desc("odds"), "w").limit(LIST_SIZE)
        lists[d] = [r["w"] for r in top.collect()]
    return lists


def tokens_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")).cast("long")


def features(text: Column, lists: dict[str, list[str]]) -> Column:
    """The measures of a text, as an array of doubles."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    plain = F.length(F.regexp_replace(text, r"[\p{L}\s]+", ""))
    signs = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    words = _words(text)
    n = F.size(words)
    listed = F.array_intersect(words, F.array(*map(F.lit, sorted(set().union(*lists.values())) or [""])))
    hits = [F.log1p(F.size(F.array_intersect(listed, F.array(*map(F.lit, lists[d]))))) if lists[d] else F.lit(0.0) for d in DOMAINS]
    return F.array(F.log1p(n.cast("double")), F.sqrt(plain / size), F.sqrt(signs / size), F.least(size / (n + 1), F.lit(50.0)) / 10, *hits)


def posteriors(f: Column, model: list[tuple[float, list[float], list[float]]]) -> Column:
    """Array of domain posteriors; ``model`` has log prior, means and variances per domain."""
    def one(prior: float, mean: list[float], var: list[float]) -> Column:
        terms = [(F.get(f, F.lit(i)) - m) * (F.get(f, F.lit(i)) - m) * (-0.5 / v) - 0.5 * float(np.log(v)) for i, (m, v) in enumerate(zip(mean, var))]
        return sum(terms, F.lit(float(prior)))

    logs = [one(*x) for x in model]
    raised = [F.exp(x - F.greatest(*logs)) for x in logs]
    return F.array(*[x / sum(raised[1:], raised[0]) for x in raised])


def fit(docs: DataFrame, measured: DataFrame, ids: DataFrame) -> list[tuple[float, list[float], list[float]]]:
    """Prior, means and variances of the measures per domain."""
    width = 4 + len(DOMAINS)
    rows = measured.join(F.broadcast(ids), "__id").groupBy("domain").agg(  # ids: at most SAMPLE rows
        F.count("*").alias("n"), *[F.avg(F.get("f", F.lit(i))).alias(f"m{i}") for i in range(width)],
        *[F.var_pop(F.get("f", F.lit(i))).alias(f"v{i}") for i in range(width)]).collect()
    by, total = {r["domain"]: r for r in rows}, sum(r["n"] for r in rows)
    if not total:
        return [(0.0, [0.0] * width, [1.0] * width)] * len(DOMAINS)
    model = []
    for d in DOMAINS:
        r = by.get(d)
        n = r["n"] if r else 0
        mean = [r[f"m{i}"] for i in range(width)] if r else [0.0] * width
        model.append((float(np.log((n + 0.5) / (total + 0.5 * len(DOMAINS)))), mean, [(r[f"v{i}"] if r else 0.0) + 0.02 for i in range(width)]))
    return model


def residual_steps(p: DataFrame, targets: dict[str, float]) -> list[list[float]]:
    """The vectors z of the steps r <- max(0, r - p.z), from r = 1; ``p`` has n_tokens and p."""
    k = len(DOMAINS)
    parts = [F.get("p", F.lit(i)) for i in range(k)]
    m = p.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * parts[i] * parts[j]) for i in range(k) for j in range(k)]).first()
    total = float(m[0] or 0)
    if not total:
        return []
    inverse = np.linalg.pinv(np.array(m[1:], dtype=float).reshape(k, k) / total, rcond=1e-9)
    want = np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    steps: list[list[float]] = []
    for _ in range(STEPS):
        got = p.select(rate(F.col("p"), steps).alias("r"), "n_tokens", "p").agg(*[F.sum(F.col("r") * F.col("n_tokens") * x) for x in parts]).first()
        gap = np.array(got, dtype=float) / total - want
        step = inverse @ gap
        if np.abs(gap).max() < CLOSE or np.abs(step).max() < CLOSE:
            break
        steps.append(step.tolist())
    return steps


def rate(p: Column, steps: list[list[float]]) -> Column:
    r = F.lit(1.0)
    for z in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.get(p, F.lit(i)) * x for i, x in enumerate(z)), F.lit(0.0)))
    return r


def copies(r: Column, id_: Column, hashed: Column) -> Column:
    """The whole part of the rate, and one more with the rest as probability."""
    u = F.pmod(F.xxhash64(id_, hashed), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(r) + (u < r - F.floor(r)).cast("int")).cast("int")


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple:
    """Word lists, model, steps, and the written table (doc_id, __id, __th, n_tokens, p)."""
    ids = table(labelled(labels), "labelled")
    key = row_key()
    known = docs.select(key[0], "text").join(F.broadcast(ids), "__id")  # at most SAMPLE rows
    lists = word_lists(known)
    measured = table(docs.select("doc_id", *key, tokens_of(F.col("text")).alias("n_tokens"), features(F.col("text"), lists).alias("f")), "measured")
    model = fit(docs, measured, ids)
    p = table(measured.select("doc_id", "__id", "__th", "n_tokens", posteriors(F.col("f"), model).alias("p")), "posteriors")
    return lists, model, residual_steps(p, targets or TARGETS), p


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies of every row of ``docs``."""
    _, _, steps, p = fitted(docs, labels, targets)
    out = p.withColumn("rate", rate(F.col("p"), steps))
    return out.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate",
                      copies(F.col("rate"), F.col("__id"), F.col("__th")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as its copies say. The rate is a function of the row,
    so it is computed in place and no text is shuffled."""
    lists, model, steps, _ = fitted(docs, labels, targets)
    f, p, r, n, copy = free_names(docs, "__f", "__p", "__r", "__n", "__copy")
    d = docs.withColumn(f, features(F.col("text"), lists))
    d = d.withColumn(p, posteriors(F.col(f), model)).withColumn(r, rate(F.col(p), steps))
    # A row number in the expression keeps the optimizer from copying all of it, text scans
    # included, into a filter on the number of copies.
    d = d.withColumn(n, F.when(F.monotonically_increasing_id() >= 0, copies(F.col(r), *row_key())))
    return d.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*own_columns(docs))
