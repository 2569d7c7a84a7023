"""SimHash near-duplicates by covering locality-sensitive hashing.

A bit position i gets a vector phi(i) of radius + 1 bits; table v (1 .. 2^(radius+1) - 1)
masks out the bits with phi(i).v = 0. Any set of ``radius`` positions leaves some v that is
orthogonal to all of their vectors, so two fingerprints within the radius have equal masked
values in at least one table: no pair is missed. Pairs that meet are checked by counting bits.

Defined cases: a null or word-less text has fingerprint zero and links like any other; fewer
words than a shingle make one shingle; rows that repeat an id or a text get the same answer;
a null id never names a component (the component of a group of null ids is null); further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.llm.common import WHOLE_KEY, by_key, connected_components, free_names, own_columns, row_key, table, whole_key, without

SEED = 42
BLOCK = 2048  # fingerprints of one bucket that a task compares with another such block


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = [words] if len(words) < shingle else zip(*(words[i:] for i in range(shingle)))
    h = np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, __th, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "__th", "fp"])

    return docs.select("doc_id", row_key()[1], "text").mapInArrow(run, "doc_id long, __th long, fp long")


def masks(radius: int) -> list[int]:
    """One mask per table, as signed longs."""
    width = 2 ** (radius + 1) - 1
    phi = [1 + i % width for i in range(64)]
    kept = [sum(((phi[i] & v).bit_count() & 1) << i for i in range(64)) for v in range(1, width + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def near_edges(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that join all fingerprints linked at ``radius`` or fewer differing bits.

    ``fps`` is a written table of distinct fingerprints (fp). Buckets of one row go before
    anything is compared; a bucket of more than ``block`` rows is cut into blocks whose pairs
    are spread over tasks. A task emits a spanning forest of the links it finds, never the pairs.
    """
    keys = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for v, m in enumerate(masks(radius))
    ])).alias("k")).select("k.t", "k.key", "fp")
    many = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keys.join(many, ["t", "key"]).withColumn("nb", F.ceil(F.col("n") / block).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("fp"), "nb").cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))) \
        .select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in _runs(batches, 4):
            u, v = _forest(fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    by = ["t", "key", "a", "b"]
    return dealt.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(run, "u long, v long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[np.ndarray]:
    """The last column of each run of rows with equal first ``n_keys`` columns."""
    held: list[np.ndarray] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_keys)], axis=1)
        values = b.column(n_keys).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for lo, hi in zip(starts[:-1], starts[1:]):
            if last is not None and tuple(keys[lo]) != last:
                yield np.concatenate(held)
                held = []
            last = tuple(keys[lo])
            held.append(values[lo:hi])
    if held:
        yield np.concatenate(held)


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the components of the links among ``fp``, by breadth-first search
    in which each fingerprint is compared once with those not reached yet."""
    left, us, vs = np.unique(fp), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root], dtype=np.uint64)
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for i in range(0, len(front), 256):
                hit |= (np.bitwise_count(front[i:i + 256, None] ^ left[None, :]) <= radius).any(axis=0)
            front, left = left[hit], left[~hit]
            us.append(front)
            vs.append(np.full(len(front), root, dtype=np.uint64))
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def components(rows: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, first, comp) per fingerprint of the written ``rows``: its smallest doc_id and its component."""
    fps = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = table(connected_components(near_edges(fps.select("fp"), radius)), "linked")
    return fps.join(linked, fps["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, __th, fingerprint, component_id) per row; component_id is the smallest
    doc_id reachable over links of ``radius`` or fewer differing bits."""
    rows = table(fingerprints(docs, shingle), "fingerprints")
    placed = components(rows, radius)
    named = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = table(placed.join(named, "comp").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "__th", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` per component: that with the smallest doc_id (null after all others),
    of rows that repeat the id the one whose text has the smallest hash, and of rows that
    repeat the text too the smallest by all columns but maps (of equal ones the first as they are written)."""
    rows = table(fingerprints(docs, shingle), "fingerprints")
    key = whole_key()
    place = F.struct(key[2], key[0], "__th")
    firsts = rows.groupBy("fp").agg(F.min(place).alias("place"))
    placed = table(components(rows, radius).join(firsts, "fp").select("fp", "comp", "place"), "placed")
    kept = table(placed.groupBy("comp").agg(F.min("place").alias("kept")), "kept")
    named = table(placed.join(kept, "comp").select("fp", "kept"), "named")
    found = rows.join(named, "fp").select(place.alias("place"), "kept")
    left = without(docs, table(found.where("place <> kept").select("place.*"), "dropped"))
    again = table(found.where("place = kept").groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place.*"), "repeated")
    if again.isEmpty():
        return left
    repeated = by_key(docs, again, "left_semi")
    number, *key = free_names(docs, "__row", *WHOLE_KEY)
    numbered = table(repeated.withColumns({number: F.monotonically_increasing_id()} | dict(zip(key, whole_key()))), "numbered")  # written: numbers stay
    ordered = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    place = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(ordered)], F.col(number).alias("number"))
    first = numbered.groupBy(*key).agg(F.min(place).alias("place")).select(F.col("place.number").alias(number))
    one = numbered.join(first, number, "left_semi").select(*own_columns(docs))
    return without(left, again).unionByName(one)
