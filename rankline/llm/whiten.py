"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers x = floor(64 c) + 1000000; a row is centred exactly, as
(n x - S) / n with the sums S of all n rows. Each step of the bidiagonalisation is two passes
over the centred rows X: one for X v, one for X'u, and in both the products with all earlier
left vectors, so that every new left vector is made orthogonal to all of them, twice. A left
vector is as long as the table; it is never stored but kept as the coefficients a of u = X a
(as many as there are dimensions), and a task computes its part of it from its rows again. Right
vectors are made orthogonal on the driver. Where a new vector vanishes, the next right vector
starts anew, orthogonal to all before. The steps end when all wanted components have converged, or
after as many steps as there are dimensions; the singular values and right vectors of the small bidiagonal
matrix then give the components.

The passes read blocks of centred rows written once; what a pass returns is a vector of sums
(dimensions + steps), added up by Spark.

Defined cases: rows whose vector is null or holds null or non-finite entries, or entries too
large for a long, are left out; so are vectors whose length is not the commonest one (of equally
common ones the greatest); a null id is kept; rows that repeat an id are rows of their own; directions
without variance are no components; a sum of squares beyond a long is null; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.llm.common import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_BYTES = 1 << 20
SEED = 11
VANISHED = 1e-13  # share of the largest singular value below which a new vector is none
CONVERGED = 1e-15  # share of the largest singular value that a component's residual may have
MOST = 2.0 ** 62


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows that take part, with entries as longs."""
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST / SCALE / 2)), F.lit(False))
    rows = vectors.select("vec_id", F.when(fine, F.transform(e, lambda c: F.floor(SCALE * c) + SHIFT)).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (lengths["d"] if lengths else 0))


def totals(rows: DataFrame) -> tuple[int, np.ndarray, int]:
    """n, the sums per dimension (Python ints) and the largest distance of an entry from ``SHIFT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, far = 0, None, None, 0.0
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                # Sums of the low 32 bits and of the rest, which both fit a long.
                parts = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
                low, high = parts if low is None else (low + parts[0], high + parts[1])
                n += len(x)
                far = max(far, float(np.abs(x.astype(np.float64) - SHIFT).max(initial=0.0)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([far]), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))],
                                             ["n", "far", "low", "high"])

    made = rows.select("x").mapInArrow(run, "n long, far double, low array<long>, high array<long>")
    one = made.agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.max(F.size("low")).alias("d")).first()
    if not one["n"]:
        return 0, np.empty(0, dtype=object), 0
    at = made.select(F.posexplode(F.arrays_zip("low", "high")).alias("i", "s"))
    sums = at.groupBy("i").agg(F.sum("s.low").alias("low"), F.sum("s.high").alias("high")).orderBy("i").collect()  # a row per dimension
    return one["n"], np.array([r["low"] + (r["high"] << 32) for r in sums], dtype=object), int(one["far"])


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.int64).reshape(n, -1) if n else np.empty((0, 0), dtype=np.int64)


def centred(x: np.ndarray, n: int, sums: np.ndarray, far: int) -> tuple[np.ndarray, list[int | None]]:
    """(n x - S) / n as doubles, and the exact sums of squares of n x - S."""
    if 2 * n * (far + SHIFT) < MOST:
        t = n * x - sums.astype(np.int64)
    else:
        t = n * x.astype(object) - sums
    if 4 * x.shape[1] * (n * (far + 1)) ** 2 < MOST:
        squares = (t * t).sum(1)
    else:
        squares = (t.astype(object) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), dtype=object)
    return (t / n).astype(np.float64), [int(s) if s < 1 << 63 else None for s in squares.tolist()]


def blocks(rows: DataFrame, n: int, sums: np.ndarray, far: int) -> DataFrame:
    """The centred rows, about ``BLOCK_BYTES`` to a row: vec_id, deviation (arrays) and raw."""
    most = max(1, BLOCK_BYTES // (8 * max(1, len(sums))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, most):
                part = b.slice(lo, most)
                x, squares = centred(_matrix(part.column(1)), n, sums, far)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([squares], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())],
                    ["vec_id", "deviation", "raw"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id array<long>, deviation array<long>, raw binary")


def _added(made: DataFrame, product: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum of ``product(X)`` over all blocks X of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0):
                part = product(np.frombuffer(raw.as_buffer(), dtype=np.float64).reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "s"])

    got = made.select("raw").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["i"]] = r["s"]
    return out


def bidiagonalise(made: DataFrame, d: int, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of the centred rows: the
    ``k`` largest, to double precision."""
    rng = np.random.default_rng(SEED)
    vs, coefficients, crossed = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))  # V; A with U = X A; X'U
    diagonal: list[float] = []
    beside: list[float] = []
    v = _fresh(rng, vs)
    scale = 0.0
    while True:
        vs = np.column_stack([vs, v])
        j = len(diagonal)
        w = coefficients
        # X v, and what it has of the earlier left vectors
        h = _added(made, lambda x, w=w, v=v: (x @ w).T @ (x @ v), d) if j else np.empty(0)
        a = v - w @ h
        # X'u of what is left, once more what it has of the earlier left vectors, and its size
        def product(x: np.ndarray, w: np.ndarray = w, a: np.ndarray = a) -> np.ndarray:
            t = x @ a
            return np.concatenate([x.T @ t, (x @ w).T @ t, [t @ t]])

        got = _added(made, product, d)
        z, g, size = got[:d], got[d:-1], got[-1]
        alpha = float(np.sqrt(max(size - g @ g, 0.0)))
        scale = max(scale, alpha, max(beside, default=0.0))
        if alpha <= VANISHED * scale or not scale:
            alpha, a, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            a, z = (a - w @ g) / alpha, (z - crossed @ g) / alpha
        diagonal.append(alpha)
        coefficients, crossed = np.column_stack([coefficients, a]), np.column_stack([crossed, z])
        r = z - alpha * v
        for _ in range(2):
            r = r - vs @ (vs.T @ r)
        beta = float(np.linalg.norm(r))
        if len(diagonal) == d:
            beside.append(0.0)
            break
        fresh = beta <= VANISHED * scale or not scale
        beside.append(0.0 if fresh else beta)
        if not fresh and len(diagonal) >= k:
            p, s, _ = np.linalg.svd(_bidiagonal(diagonal, beside))
            if (beta * np.abs(p[-1, :k]) <= CONVERGED * s[0]).all():
                break
        v = _fresh(rng, vs) if fresh else r / beta
    _, s, qt = np.linalg.svd(_bidiagonal(diagonal, beside))
    return s[:k], (vs @ qt.T)[:, :k]


def _bidiagonal(diagonal: list[float], beside: list[float]) -> np.ndarray:
    return np.diag(diagonal) + np.diag(beside[:len(diagonal) - 1], 1)


def _fresh(rng: np.random.Generator, vs: np.ndarray) -> np.ndarray:
    v = rng.standard_normal(len(vs))
    for _ in range(3):
        v = v - vs @ (vs.T @ v)
        v /= np.linalg.norm(v)
    return v


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each
    row of ``vectors`` (vec_id, embedding) that takes part and each of at most ``k`` components."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors)
    n, sums, far = totals(rows)
    d = len(sums)
    if not n or not d:
        return spark.createDataFrame([], OUT)
    made = table(blocks(rows, n, sums, far), "centred")
    trace = _added(made, lambda x: np.array([(x * x).sum()]), d)[0]
    values, found = bidiagonalise(made, d, k) if trace else (np.empty(0), np.empty((d, 0)))
    used = values > VANISHED * max(values, default=0.0) * 10
    values, found = values[used], found[:, used]
    m = len(values)
    if not m:
        return spark.createDataFrame([], OUT)
    explained = values ** 2 / trace
    to = found / (values / np.sqrt(n))
    middle = _added(made, lambda x: (x @ to).sum(0), d) / n

    def product(x: np.ndarray) -> np.ndarray:
        w = x @ to - middle
        return (w.T @ w).ravel()

    error = float(np.abs(_added(made, product, d).reshape(m, m) / n - np.eye(m)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(2)[i].as_buffer(), dtype=np.float64).reshape(-1, d)
                size = len(x)
                at = pa.array(np.repeat(np.arange(size), m))
                yield pa.RecordBatch.from_arrays([
                    b.column(0)[i].values.take(at), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)), pa.array(np.full(size * m, n)), b.column(1)[i].values.take(at),
                    pa.array((x @ to).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * m, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return made.select("vec_id", "deviation", "raw").mapInArrow(run, OUT)
