"""Language of a text by nearest centroid.

A text's vector holds its hashed character n-grams (1 to 3 characters, words apart) as
normalised TF-IDF. Document frequencies are counted over all training rows. Each language gets
several centroids: spherical k-means on at most ``SAMPLE`` of its rows, those with the smallest
hashes of id and text. The nearest centroid by cosine names the language; ``rejected`` tells that the text is
further from it than nearly all of the centroid's own members were.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text if
nothing could be learned; rows with a null id or language are never learned from; rows that
repeat an id are predicted each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankline.llm.common import small_join, table

BUCKETS = 4096
SAMPLE = 400  # training rows of a language that its centroids are fitted on, at most
CENTROIDS = 4
REJECT_SHARE = 0.01  # of a centroid's members that are further away than its radius
CHUNK = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.concatenate([[32], np.where(letter, c, 32), [32]]).astype(np.uint64)
    out = np.zeros(BUCKETS)
    for lo in range(0, len(c), CHUNK):
        part = c[lo:lo + CHUNK + 2]
        code = part
        for n in (1, 2, 3):
            if n > 1:
                code = code[:-1] * np.uint64(0x110001) + part[n - 1:]
            used = (code if lo + CHUNK >= len(c) else code[:CHUNK])
            at = part[:len(used)]
            used = used[(at != 32) | (n > 1)]
            out += np.bincount(((used * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    return out


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    n = counts(text)
    if n is None:
        return None
    v = np.log1p(n) * idf
    size = np.linalg.norm(v)
    return v / size if size else None


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def document_frequencies(train: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows; one row per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                c = counts(t.as_py())
                if c is not None:
                    seen[:-1] += c > 0
                    n += 1
        seen[-1] = n
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(seen)], ["bucket", "n"])

    got = train.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(BUCKETS + 1)
    for r in got:
        n[r["bucket"]] = r["n"]
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 0.05


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts; unit centroids and members."""
    mean = x.mean(0)
    start = [int(np.argmax(x @ mean))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(1))))
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = new / np.linalg.norm(new, axis=1, keepdims=True)
    return c, (x @ c.T).argmax(1)


def fitted_rows(train: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, h, text): for each language the ``sample`` rows with the smallest hashes of id and text,
    rows that repeat both counted once. A threshold on the hash, from the language's count
    of different rows, leaves a few times as many before any row is moved."""
    h = F.xxhash64("doc_id", "text")
    sizes = table(train.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")), "sizes")
    low = F.col("h").cast("double") / 2.0 ** 64 + 0.5 <= 3.0 * sample / F.col("n")
    some = small_join(train.select("lang", h.alias("h"), "text"), sizes, ["lang"]).where(low).groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return some.withColumn("r", rank).where(F.col("r") <= sample).drop("r")


def centroids(train: DataFrame, idf: np.ndarray, sample: int = SAMPLE, k: int = CENTROIDS) -> list[tuple[str, np.ndarray, float]]:
    """(language, unit centroid, radius as a cosine): at most ``k`` rows per language."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = [v for t in rows.sort_values("h")["text"] if (v := vector(t, idf)) is not None]
        if not x:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        x = np.array(x)
        c, own = _cluster(x, k)
        near = (x * c[own]).sum(1)
        return pd.DataFrame({"lang": key[0], "centroid": list(c), "radius": [
            float(np.quantile(near[own == i], REJECT_SHARE)) if (own == i).any() else 0.0 for i in range(len(c))]})

    found = fitted_rows(train, sample).groupBy("lang").applyInPandas(run, "lang string, centroid array<double>, radius double")
    return sorted(((r["lang"], np.array(r["centroid"]), r["radius"]) for r in found.collect()), key=lambda x: (x[0], x[1].tolist()))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs``, learned from its
    rows with a language that are not held out."""
    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    idf = document_frequencies(train)
    model = centroids(train, idf)
    names = [m[0] for m in model]
    matrix, radius = np.array([m[1] for m in model]).reshape(-1, BUCKETS), np.array([m[2] for m in model])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, out = [], np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=bool)
            for i, t in enumerate(b.column(2)):
                v = vector(t.as_py(), idf) if names else None
                if v is None:
                    pred.append("und")
                    continue
                near = matrix @ v
                best = int(near.argmax())
                pred.append(names[best])
                score[i], out[i] = min(1.0, max(0.0, near[best])), near[best] < radius[best]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(out)],
                                             ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
