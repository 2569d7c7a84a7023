"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words (lower-case runs of letters and digits), of pairs
of neighbouring words, and of pairs with one or two words between them; a feature is there or
not, however often it occurs and however long the text is. The model is fitted on at most ``SAMPLE``
labelled rows, those with the smallest id hashes. Features enter it once ``MIN_ROWS`` toxic rows
of the sample hold them, at most ``MOST_FEATURES`` of them, the most frequent. Each coordinate has its own
learning rate; L1 leaves most weights at zero, and only the others are sent to the tasks that score.

Defined cases: a null, empty or word-less text has the score of the bias alone; rows with a null
id and null labels are never learned from; of several labels of one id the highest holds, of
several texts of one id one, by its hash, is learned from; without a label of each kind every
score is the share of toxic rows (0 without labels); rows that repeat an id are scored each;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankline.llm.common import small_join, table

SAMPLE = 24_000  # labelled rows that the model is fitted on, at most
MIN_ROWS = 3
MOST_FEATURES = 1 << 18
SKIPS = 2  # words between the two of a skip-gram, at most
ALPHA, BETA, L1, L2 = 3.0, 1.0, 3.0, 0.1
ROUNDS = 4
THRESHOLD = 0.3
SEGMENT = 1 << 16  # words hashed at once
WORDS_KEPT = 300_000
WORD = re.compile(r"[^\W_]+")


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 13)
        return h


@lru_cache(maxsize=1)
def _hashes() -> Hashes:
    return Hashes()


def features(text: str | None) -> Iterator[np.ndarray]:
    """The hashed features of a text, a segment of words at a time, as non-negative longs."""
    words = WORD.findall((text or "").lower())
    get = _hashes().__getitem__
    for lo in range(0, len(words), SEGMENT):
        n = min(SEGMENT, len(words) - lo)
        part = words[lo:lo + SEGMENT + SKIPS + 1]
        h = np.fromiter(map(get, part), dtype=np.uint64, count=len(part))
        found = [h[:n]]
        for far in range(1, SKIPS + 2):
            a, b = h[:-far][:n], h[far:][:n]
            found.append((a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(far)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)))
        yield (np.concatenate(found) >> np.uint64(1)).astype(np.int64)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(h, toxic, text): at most ``sample`` labelled rows of ``docs`` that are not held out."""
    place = F.xxhash64(F.col("doc_id"), F.lit(13))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = table(known.withColumn("h", place), "known")
    n = known.count()
    # the lowest hashes: a threshold leaves few more than the sample, of which the first are taken
    share = min(1.0, 1.1 * sample / max(n, 1) + 1e-6)
    bound = (1 << 63) - 1 if share == 1.0 else int(-(1 << 63) + share * (1 << 64))
    some = table(known.where(F.col("h") <= F.lit(bound)).orderBy("h", "doc_id").limit(sample), "sample")
    rows = small_join(docs.select("doc_id", "text"), some, ["doc_id"])
    return rows.groupBy("doc_id", "h", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).drop("doc_id")


def vocabulary(made: DataFrame) -> np.ndarray:
    """The features of the written ``made`` (h, toxic, keys) that the model may use, ascending."""
    counts = made.where("toxic = 1").select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= MIN_ROWS).orderBy(F.desc("n"), "key").limit(MOST_FEATURES).select("key").toPandas()
    return np.sort(top["key"].to_numpy(dtype=np.int64))


def _places(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places in ``known`` (ascending) of those of ``keys`` that it holds."""
    if not len(known):
        return np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.unique(at[known[at] == keys])


class Ftrl:
    """FTRL-proximal; coordinate 0 is the bias, which is not regularised."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, bias = self.z[at], at == 0
        l1, l2 = np.where(bias, 0.0, self.l1), np.where(bias, 0.0, self.l2)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        root = np.sqrt(self.n[at])
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - root) / self.alpha * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def fit(rows: list[tuple[int, np.ndarray]], size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the bias and of ``size`` features from (label, places) rows, in their order."""
    model = Ftrl(size)
    for _ in range(rounds):
        for label, at in rows:
            model.learn(np.concatenate([[0], at + 1]), label)
    return model.weights(np.arange(size + 1))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(keys, weights, bias) of the features with a weight, keys ascending."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.unique(np.concatenate([np.empty(0, dtype=np.int64), *map(np.unique, features(t.as_py()))])) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], ["h", "toxic", "keys"])

    made = table(sample_rows(docs, labels, sample).select("h", "toxic", "text").mapInArrow(hashed, "h long, toxic int, keys array<long>"), "features")
    n, toxic = made.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        share = toxic / n if n else 0.0
        return np.empty(0, dtype=np.int64), np.empty(0), -math.inf if share == 0 else math.inf
    known = vocabulary(made)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [_places(np.asarray(k.values), known) for k in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int64()))], ["h", "toxic", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.asarray(at.values)) for b in batches for y, at in zip(b.column(1).to_pylist(), b.column(2))]
        if rows:
            w = fit(rows, len(known))
            used = np.flatnonzero(w[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], known[used]])), pa.array(np.concatenate([w[:1], w[1:][used]]))], ["key", "weight"])

    # One learner: its rows are the bounded sample, and only places of known features reach it.
    rows = made.mapInArrow(placed, "h long, toxic int, at array<long>").repartition(1).sortWithinPartitions("h", "toxic")
    got = rows.mapInArrow(train, "key long, weight double").toPandas().sort_values("key")
    keys, weights = got["key"].to_numpy(dtype=np.int64), got["weight"].to_numpy()
    return keys[1:], weights[1:], float(weights[0])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, learned from ``labels``
    (doc_id, toxic) of rows that are not held out."""
    keys, weights, bias = learned(docs, labels, sample)  # at most MOST_FEATURES numbers each
    maybe = np.zeros(1 << 20, dtype=bool)  # most features fail here, before they are looked up
    maybe[keys & (len(maybe) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            for i, t in enumerate(b.column(2)):
                hits = [f[maybe[f & (len(maybe) - 1)]] for f in features(t.as_py())] if len(keys) else []
                at = _places(np.concatenate(hits), keys) if hits else np.empty(0, dtype=np.int64)
                out[i] = 0.0 if bias == -math.inf else 1.0 if bias == math.inf else sigmoid(bias + weights[at].sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
