"""Whitening, tokenizer alignment and toxicity against plain versions."""

from __future__ import annotations

import bisect
import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from cases import documents, odd_rows  # noqa: E402
from rankline.llm import align, toxicity, whiten  # noqa: E402

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

# Whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n long, raw string")


def vector_rows(x, start=0):
    return [(start + i, [float(c) for c in r], 1, "a", 2, "b") for i, r in enumerate(x)]


def plain_whitening(x, k=32):
    x = np.floor(64 * np.asarray(x, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    keep = min(k, int((e > e[0] * 1e-20).sum()))
    return n, ((n * x - s) ** 2).sum(1), c @ q[:, :keep] / np.sqrt(e[:keep]), e[:keep] / np.trace(v)


def test_whitening_equals_eigenvectors_on_the_table(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    p = d.toPandas()
    n, deviation, white, share = plain_whitening(np.array(p["embedding"].tolist(), dtype=np.float32))
    got = whiten.whitened(d).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort(p["vec_id"].to_numpy(), kind="stable")
    assert len(got) == n * 32 and (got["n"] == n).all()
    w = got["whitened"].to_numpy().reshape(n, 32)
    assert np.abs(np.abs(w) - np.abs(white[order])).max() < 1e-8
    assert (np.sign(w[:, :5]) * np.sign(white[order][:, :5])).std(axis=0).max() < 1e-9  # one sign for all rows
    assert (got["deviation"].to_numpy().reshape(n, 32)[:, 0] == deviation[order]).all()
    assert np.allclose(got["explained"].to_numpy()[:32], share, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_few_dimensions_rank_loss_and_equal_values(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 3))
    flat = np.round(np.column_stack([base, base[:, 0]]) * 16) / 64  # the last dimension repeats the first
    got = whiten.whitened(vectors(spark, vector_rows(flat)), k=32).toPandas()
    assert sorted(got["component"].unique()) == [1, 2, 3]
    assert got["explained"].unique().sum() == pytest.approx(1, abs=1e-9) and got["identity_error"].max() < 1e-9
    cube = np.array([[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)], dtype=float)  # all variances equal
    got = whiten.whitened(vectors(spark, vector_rows(cube))).toPandas()
    assert sorted(got["component"].unique()) == [1, 2, 3] and got["identity_error"].max() < 1e-9
    assert np.allclose(got["explained"], 1 / 3)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 4))
    odd = [(90, None, 1, "a", 2, "b"), (91, [1.0, None, 0.0, 0.0], 1, "a", 2, "b"), (92, [1.0, float("nan"), 0.0, 0.0], 1, "a", 2, "b"),
           (93, [1.0, float("inf"), 0.0, 0.0], 1, "a", 2, "b"), (94, [1.0], 1, "a", 2, "b"), (95, [], 1, "a", 2, "b")]
    again = [(None, [float(c) for c in x[0]], 1, "a", 2, "b"), (0, [float(c) for c in x[0]], 1, "a", 2, "b")]
    got = whiten.whitened(vectors(spark, vector_rows(x) + odd + again)).toPandas()
    assert len(got) == 32 * 4 and (got["n"] == 32).all()
    assert got["vec_id"].isna().sum() == 4 and (got["vec_id"] == 0).sum() == 8 and got["vec_id"].max() == 29
    n, deviation, white, _ = plain_whitening(np.vstack([x, x[:1], x[:1]]).astype(np.float32), 4)
    assert set(got["deviation"]) == set(deviation.tolist())
    same = vectors(spark, vector_rows(np.ones((5, 3))))
    assert whiten.whitened(same).count() == 0 and whiten.whitened(same.limit(0)).count() == 0


def test_exact_sums_beyond_a_long():
    x = np.array([[5_000_000_000, 7], [1, 9]])
    n, sums = 2_000_000_000, np.array([3_000_000_000_000_000_000, 8 * 2_000_000_000], dtype=object)
    c, squares = whiten.centred(x, n, sums, 5_000_000_000)
    assert squares == [None if s >= 1 << 63 else s for s in (sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for row in x)]
    assert c[0, 0] == float((n * 5_000_000_000 - int(sums[0])) / n)


# Alignment


def plain_alignment(made, text):
    """Groups by plain set intersection, the tokenizers called on the whole text."""
    if not text:
        return [], [], []
    a = made.a.encode(" " + text, add_special_tokens=False).ids
    b = made.b.encode(text)
    in_a, in_b = [made.bytes_a[i] for i in a], [made.bytes_b[i] for i in b]
    if not (b"".join(in_a) == b"".join(in_b) == (" " + text).encode()):
        return [], [], []
    ea, eb = np.cumsum(list(map(len, in_a))).tolist(), np.cumsum(list(map(len, in_b))).tolist()
    common, i, j, out = sorted(set(ea) & set(eb)), 0, 0, []
    for x in common:
        m, n = bisect.bisect_right(ea, x), bisect.bisect_right(eb, x)
        out.append((i, m, j, n))
        i, j = m, n
    return a, b, out


def plain_summaries(rows):
    made, count, best, found = align.aligner(), Counter(), Counter(), []
    for doc_id, text in rows:
        a, b, gs = plain_alignment(made, text)
        links = [(x, y) for i, m, j, n in gs for x in a[i:m] for y in b[j:n]]
        count.update(set(links))
        found.append((doc_id, a, b, gs, links))
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, a, b, gs, links in found:
        digest = ";".join(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])) for i, m, j, n in gs)
        out.append((doc_id, len(a), len(b), len(gs), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(digest.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


TRICKY = ["a  b", " a", "a ", "x's there", "x'sab", "don't we'll I'd", "a\n b", "a \n", "\n", "\t\tab", "a\r\nb", "▁x", "<s> hi</s>", "<|endoftext|> z", "é", "é", "a\xa0b", "日本語 text",
          "\U0001F600\U0001F600 ok", "3.14 12345 a1b2", "...!?—", "_a_b__c", "x" * 3000, " " * 40, "ſtra\x00ße", "<0x41><unk>", "A.B,C;D:E", "12ab34", "'s", "a 's b", "÷×", "\x85a", "!'s"]


def test_galloping_equals_set_intersection():
    rng = random.Random(7)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(1, 200), rng.choice([0, 1, 3, 20, 150]))) for _ in range(2))
        at_a, at_b = align.common_ends(a, b)
        assert [a[i] for i in at_a] == [b[j] for j in at_b] == sorted(set(a) & set(b))
        ranges = align.overlaps(a, b)
        starts = [0, *a][:len(a)]
        for (lo, hi), (x, y) in zip(zip(starts, a), ranges):
            want = [j for j, (p, q) in enumerate(zip([0, *b], b)) if p < hi and q > lo]
            assert list(range(x, y)) == want


def test_stretches_give_the_tokens_of_whole_texts(spark):
    made, rng = align.aligner(), random.Random(8)
    assert made.borders
    bits = ["ab", "The", "é", "'s", "'ll", "\n", " ", "  ", ".", ",", "12", "_", "-", "\t", "ñandú", "(", ")", "\r\n", "X", "ß", "'", "...", "$", "hello world"]
    texts = TRICKY + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    n = 0
    for t in texts:
        cut = made.stretches(t)
        if cut is not None:
            a, b, _ = plain_alignment(made, t)
            parts = list(made.align_stretches(cut))
            assert a and [x for p in parts for x in p.a] == a and [x for p in parts for x in p.b] == b, repr(t)
            n += 1
    assert n > 500


@pytest.mark.parametrize("size", [50, 2_000_000])
def test_alignment_of_the_table_and_of_odd_texts(spark, size):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = rows[:60] + [(1000 + i, t) for i, t in enumerate(TRICKY)] + [(r[0], r[1]) for r in odd_rows()]
    docs = documents(spark, [(*r, "en") for r in rows]).withColumn("chunk", F.lit("z")).repartition(3)
    got = align.summaries(docs, size=size, stretches=100 if size == 50 else align.STRETCHES).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_summaries(rows)
    assert align.summaries(docs.limit(0)).count() == 0


def test_new_stretches_are_aligned_together_as_one_by_one(monkeypatch):
    """B is asked once a document for its new stretches without line feeds; stretches that are long,
    hold line feeds or are not given back by B are aligned one by one."""
    made, rng = align.aligner(), random.Random(9)
    texts = ["".join(rng.choice(" abcdefgé1!'.") for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    texts += ["\n".join(texts[:3]), "a\n\n b\n", "-" * 200 + " on " + "qxz" * 40, "x", "one two two one"]
    alone, calls = [made.whole(t) for t in texts], []

    class Counted:
        def __getattr__(self, name):
            return getattr(made.b, name)

        def encode(self, x, **kw):
            calls.append(x)
            return made.b.encode(x, **kw)

    apart = align.Aligner(*align.tokenizer_paths())
    for lossy in (False, True):
        chunk = align.Chunk(apart)
        monkeypatch.setattr(apart, "tokenize_stretches", (lambda found: None) if lossy else align.Aligner.tokenize_stretches.__get__(apart))
        for k, (text, x) in enumerate(zip(texts, alone)):
            chunk.add(k, text)
            keys, times = x.links()
            assert chunk.docs[-1][1:6] == (len(x.a), len(x.b), len(x.groups), sum(times), hashlib.sha256(x.digest().encode()).hexdigest())
            assert sorted(set(keys)) == chunk.pairs[-1].tolist()
    with monkeypatch.context() as m:
        m.setattr(apart, "b", Counted())
        m.setattr(apart, "tokenize_stretches", align.Aligner.tokenize_stretches.__get__(apart))
        align.Chunk(apart).add(1, "some few words that none of the others has, none of them long")
    assert [type(x) for x in calls] == [str]


def test_alignment_rows(spark):
    made = align.aligner()
    docs = documents(spark, [(1, "Hello wörld 日本", "en"), (2, None, "en"), (3, "▁", "en")])
    rows = {r["doc_id"]: r for r in align.alignments(docs).collect()}
    a, b, gs = plain_alignment(made, "Hello wörld 日本")
    assert rows[1]["a"] == a and rows[1]["b"] == b and [tuple(g) for g in rows[1]["groups"]] == gs
    assert rows[1]["a_ends"][-1] == rows[1]["b_ends"][-1] == len(" Hello wörld 日本".encode())
    assert len(rows[1]["overlaps"]) == len(a) and rows[2]["a"] == rows[3]["a"] == []


def test_links_of_a_large_group():
    x = align.Alignment([1, 2] * 20, [5, 6, 5], [(0, 40, 0, 3)])
    keys, times = x.links()
    want = Counter(p * align.PAIR + q for p in x.a for q in x.b)
    assert dict(zip(keys, times)) == want and len(keys) == len(want)


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(d, labels).toPandas()
    assert len(got) == d.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    out = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    toxic, clean = out[out["toxic"] == 1], out[out["toxic"] == 0]
    assert toxic["predicted"].mean() > 0.75 and clean["predicted"].mean() < 0.02


def test_scores_do_not_depend_on_held_out_labels(spark):
    d, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(tuple(r) for r in toxicity.score(d, x).collect()) for x in (labels, flipped))
    assert one == two


def test_ftrl_equals_a_plain_version():
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.3), np.array(sorted(rng.sample(range(12), rng.randint(0, 6))), dtype=np.int64)) for _ in range(200)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1, l2 = (0, 0) if i == 0 else (toxicity.L1, toxicity.L2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + l2)

    for _ in range(2):
        for y, at in rows:
            used = [0, *(int(i) + 1 for i in at)]
            w = {i: weight(i) for i in used}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in used:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(toxicity.fit(rows, 12, rounds=2), [weight(i) for i in range(13)])


def test_features_over_segments(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = set(np.concatenate(list(toxicity.features(text))).tolist())
    monkeypatch.setattr(toxicity, "SEGMENT", 16)
    parts = list(toxicity.features(text))
    assert len(parts) > 30 and set(np.concatenate(parts).tolist()) == whole
    assert list(toxicity.features(None)) == list(toxicity.features(" .,")) == []


def test_toxicity_of_odd_rows(spark):
    rows = odd_rows() + [(100 + i, f"you are a scum {i} w{i}" if i % 4 == 0 else f"a nice day {i} v{i}", "en") for i in range(200)]
    docs = documents(spark, rows).withColumn("toxic", F.lit("x")).withColumn("h", F.lit(1))
    marks = [(100 + i, 1, int(i % 4 == 0)) for i in range(200)] + [(100, 0, 0), (4, None, 0), (None, 1, 1), (5, 1, None), (4, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[100 + i]["predicted"] == int(i % 4 == 0) for i in range(200))
    assert by[1]["score"] == by[2]["score"] == by[3]["score"] < 0.3
    for some, share in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1 and doc_id >= 100"), 1.0)):
        assert {r["score"] for r in toxicity.score(docs, some).collect()} == {share}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_sample_is_bounded(spark):
    d, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    twice = d.union(d).union(d.withColumn("text", F.lit("other")))
    assert toxicity.sample_rows(twice, labels, sample=50).count() <= 50
