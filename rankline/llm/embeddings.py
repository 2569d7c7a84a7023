"""Near-duplicate embeddings by collision-counting projections.

Vectors are compared inside cells of ``T`` tables: a cell is the side of ``g`` random planes that a
vector is on, with g such that a cell holds about ``CELL`` vectors however many there are,
and T such that a pair at the least cosine shares a cell of some table with probability
``RECALL``. In a cell, each of ``K`` random projections is sorted, and a pair collides on it if
the one value lies in a window centred on the other. Pairs with at least ``l`` collisions are
verified by their cosine in double precision; l is the largest count that a pair at the least
cosine reaches with probability ``COUNT_RECALL`` (collisions are independent, so the count is binomial).

A pair is counted only in the first table where it shares a cell, so links can be summed
without a pair list. Equal vectors are one class with a count. A cell of more than ``BLOCK``
classes is cut into blocks whose pairs are spread over tasks; a task emits sums and a
spanning forest, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths do not link; rows that repeat an id count as
vectors of their own; a null id never names a component that has another id; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.llm.common import connected_components, table

LEAST = 0.9
CELL, BLOCK = 1024, 3072
K, WIDTH = 20, 2.0  # projections; half a window, in deviations of a pair's difference
RECALL, COUNT_RECALL = 0.98, 0.995
SEED = 20_24


def calibration(n: int, least: float = LEAST) -> tuple[int, int, int]:
    """(g, T, l) for ``n`` vectors."""
    g = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    same = (1 - math.acos(least) / math.pi) ** g
    tables = 1 if g == 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - same))
    p = math.erf(WIDTH / math.sqrt(2))
    tail, count = 0.0, K + 1
    while tail < COUNT_RECALL:
        count -= 1
        tail += math.comb(K, count) * p ** count * (1 - p) ** (K - count)
    return g, tables, count


def _cells(x: np.ndarray, g: int, tables: int) -> np.ndarray:
    """The cell of each vector in each table; the planes depend on nothing but the length."""
    out = np.zeros((len(x), tables), dtype=np.int64)
    for t in range(tables):
        planes = np.random.default_rng([SEED, x.shape[1], t]).standard_normal((x.shape[1], g))
        out[:, t] = (x @ planes > 0) @ (1 << np.arange(g, dtype=np.int64))
    return out


def _unit(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large or small numbers finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, id; id is null where nothing can link) and classes (id, size, n, first, embedding)."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(fine, F.xxhash64(F.size(e), e)).alias("id"), F.when(fine, e).alias("embedding"))
    found = rows.where("id is not null").groupBy("id").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first"), F.any_value("embedding").alias("embedding"))
    return rows.select("vec_id", "id"), table(found.withColumn("size", F.size("embedding")), "classes")


def links(found: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, more, root): for each class and place where it has links, how many vectors of other
    classes it is linked to there, and a class that stands for those it is connected with."""
    g, tables, need = calibration(found.count(), least)
    width = WIDTH * math.sqrt(2 - 2 * least)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                x = _unit(part.column(3))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_cells(x, g, tables).tolist(), pa.list_(pa.int64()))],
                                                 ["id", "n", "size", "embedding", "cells"])

    placed = table(found.select("id", "n", "size", "embedding").mapInArrow(
        place, "id long, n long, size int, embedding array<double>, cells array<long>"), "placed")
    by = ["size", "t", "cell"]
    keys = placed.select("size", F.posexplode("cells").alias("t", "cell"))
    full = keys.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1")
    member = placed.select("id", "n", "size", "embedding", F.posexplode("cells").alias("t", "cell")).join(full, by)
    member = member.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "nb").cast("int"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))) \
        .select(*by, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "id", "n", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _groups(batches, 5):
            a, b = key[3], key[4]
            ids, n, own = (np.array(group.column(i)) for i in (6, 7, 5))
            x = _unit(group.column(8))
            ids, more, root = _linked(x, ids, n, own, a != b, key[1], g, tables, need, width, least)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(more), pa.array(root)], ["id", "more", "root"])

    order = [*by, "a", "b"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "id long, more long, root long")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_keys)], axis=1)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            key = tuple(keys[lo].tolist())
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def _linked(x, ids, n, own, crossed, t, g, tables, need, width, least):
    """Links inside one group: ids with links, their sums, and their roots."""
    m = len(x)
    side = own == own.min()
    cells = _cells(x, g, t)  # of the tables before this one
    values = x @ np.random.default_rng([SEED, x.shape[1], tables, 1]).standard_normal((x.shape[1], K))
    lows, highs, ranks = [], [], []
    for k in range(K):
        order = np.argsort(values[:, k], kind="stable")
        v = values[order, k]
        rank = np.empty(m, dtype=np.int32)
        rank[order] = np.arange(m, dtype=np.int32)
        ranks.append(rank)
        lows.append(np.searchsorted(v, values[:, k] - width, "left").astype(np.int32))
        highs.append(np.searchsorted(v, values[:, k] + width, "right").astype(np.int32))
    more, root = np.zeros(m, dtype=np.int64), np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    linked = np.zeros(m, dtype=bool)
    for lo in range(0, m, 256):
        i = np.arange(lo, min(m, lo + 256))
        count = np.zeros((len(i), m - lo), dtype=np.uint8)
        for k in range(K):
            r = ranks[k][None, lo:]
            count += (r >= lows[k][i, None]) & (r < highs[k][i, None])
        p, q = np.nonzero(count >= need)
        p, q = i[p], q + lo
        keep = (q > p) & ((side[p] != side[q]) if crossed else True)
        p, q = p[keep], q[keep]
        for a in range(0, len(p), 1 << 16):  # bounds the vectors held at once
            u, v = p[a:a + (1 << 16)], q[a:a + (1 << 16)]
            good = np.einsum("ij,ij->i", x[u], x[v]) >= least
            if t:
                good &= (cells[u] != cells[v]).all(axis=1)
            u, v = u[good], v[good]
            np.add.at(more, u, n[v])
            np.add.at(more, v, n[u])
            linked[u] = linked[v] = True
            for c, d in zip(u.tolist(), v.tolist()):
                c, d = find(c), find(d)
                if c != d:
                    root[max(c, d)] = min(c, d)
    at = np.flatnonzero(linked)
    return ids[at], more[at], ids[[find(i) for i in at.tolist()]] if len(at) else ids[at]


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    rows, found = classes(vectors)
    got = table(links(found, least), "links")
    comp = table(connected_components(got.select(F.col("id").alias("u"), F.col("root").alias("v")).distinct()), "components")
    sums = got.groupBy("id").agg(F.sum("more").alias("more"))
    c = found.select("id", "n", "first").join(sums, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left") \
        .select("id", "first", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("comp", "id").alias("comp"))
    named = c.groupBy("comp").agg(F.min("first").alias("component_id"))
    c = table(c.join(named, "comp").select("id", "n_links", "component_id"), "named")
    out = rows.join(c, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
