"""Vector best-fit packing of documents into sequences.

An item takes from a sequence its tokens, one document, and its attention cost (tokens
squared). Items of one length are alike in all three, so the packing is done on counts:
the driver sees a table of at most ``capacity`` rows (length, count) and lets bins in the
same state stand for each other. Longest items first, an item goes where it leaves the
smallest weighted residual norm (or has the largest weighted dot product with the residual)
among the states that hold it under every constraint; a new bin is opened if there is none.
The plan says which ranks of a length go to which bins at which offset; every piece finds
its place by its rank among the pieces of its length.

Defined cases: a null text is empty (the end id only); rows that repeat an id are packed each;
a null id stays null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankline.llm.common import table
from rankline.llm.tokens import END_ID, encoded, encoder

CAPACITY = 1024


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its rank among the pieces
    of its length in its ``chunk`` (input partition). The first piece of a longer document
    takes what full pieces leave over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(b.column(0).to_pylist(), encoded(b.column(1), path, end_id)):
                n = len(raw) // 4
                ends = range(n % capacity or capacity, n + 1, capacity)
                for piece, hi in enumerate(ends):
                    lo = max(0, hi - capacity) if piece else 0
                    rows.append((doc_id, piece, lo, hi - lo, zlib.crc32(raw[4 * lo:4 * hi]), chunk, int(seen[hi - lo])))
                    seen[hi - lo] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"])
        encoder(path).rest()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, rank long")


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int = CAPACITY, max_attention: int = CAPACITY ** 2,
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first bin, offset): bins are numbered from 0."""
    limit = np.array([capacity, max_docs, max_attention], dtype=np.float64)
    weight = np.array(weights) / limit ** 2
    open_bins: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # state used -> ranges of bins
    out, n_bins = [], 0
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        item = np.array([length, 1, length ** 2], dtype=np.float64)
        if (item > limit).any():
            raise ValueError(f"an item of length {length} fits no empty sequence")
        left, rank = counts[length], 0
        while left:
            states = np.array(list(open_bins), dtype=np.float64).reshape(-1, 3)
            fits = (states + item <= limit).all(axis=1)
            if fits.any():
                room = limit - states
                score = -(((room - item) ** 2) @ weight) if rule == "norm" else room @ (weight * item)
                state = tuple(int(x) for x in states[np.argmax(np.where(fits, score, -np.inf))])
                start, n = open_bins[state].pop()
                if not open_bins[state]:
                    del open_bins[state]
            else:
                state, start, n = (0, 0, 0), n_bins, left
            each = min(int(((limit - state) // item).min()), left)
            used = min(n, left // each)
            if state == (0, 0, 0) and start == n_bins:
                n_bins += used
            elif n > used:
                open_bins.setdefault(state, []).append((start + used, n - used))
            for j in range(each):
                out.append((length, rank, used, start, state[0] + j * length))
                rank += used
            left -= each * used
            after = (state[0] + each * length, state[1] + each, state[2] + each * length ** 2)
            open_bins.setdefault(after, []).append((start, used))
    return out


def placed(parts: DataFrame, segments: list[tuple[int, int, int, int, int]], capacity: int = CAPACITY) -> DataFrame:
    """The pieces (with ``rank`` over all pieces of their length) with sequence_id and offset.
    ``segments`` has a bounded number of rows: it depends on the lengths, not on the input."""
    seg = np.array(sorted(segments), dtype=np.int64).reshape(-1, 5)
    at = np.searchsorted(seg[:, 0], np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            which = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                rows = length == n
                which[rows] = at[n] + np.searchsorted(seg[at[n]:at[n + 1], 1], rank[rows], side="right") - 1
            s = seg[which]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(s[:, 3] + rank - s[:, 1]), pa.array(s[:, 4])],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    cols = parts.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return cols.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, max_docs: int = CAPACITY, max_attention: int = CAPACITY ** 2) -> DataFrame:
    """Pieces of ``docs`` with their sequence and offset."""
    cut = table(pieces(docs, capacity), "pieces")
    counts = table(cut.groupBy("chunk", "length").agg(F.count("*").alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return placed(ranked, plan(totals, capacity, max_docs, max_attention), capacity)
