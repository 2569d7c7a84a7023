"""Quality rules, line dedup and SimHash against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(__file__))

from cases import WORD, documents, odd_rows, sentence  # noqa: E402
from rankline.llm import lines, quality, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Quality rules


def base_counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    had, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in had
            had.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), n < 10 or 100 * len(covered) > 20 * n)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts_and_divergence_match_plain_versions(spark, docs):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    per_row = {}
    for r in rows:
        assert tuple(got[r["doc_id"]][c] for c in COLUMNS) == base_counts(r["text"])
        plain = re.findall(r"[^\W\d_]+", r["text"].lower())
        classes = [0] * 8
        for c in r["text"]:
            kind = (0 if "a" <= c <= "z" else 1 if c in " \t\n\x0b\x0c\r" else 2 if "A" <= c <= "Z" else 3 if c in "0123456789" else
                    4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>" else 6 if c.isalpha() else 7)
            classes[kind] += 1
        per_row[r["doc_id"]] = (r["lang"], plain, classes)
    vocab, refs = {}, {}
    for lang in {v[0] for v in per_row.values()}:
        n = Counter(w for x, p, _ in per_row.values() if x == lang for w in p if len(w) <= quality.COMMON_LENGTH)
        vocab[lang] = [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:quality.COMMON_WORDS]]

    def common(lang, plain):
        n = Counter(plain)
        some = [n[w] for w in vocab[lang]]
        return some + [len(plain) - sum(some)]

    for i, (lang, plain, classes) in per_row.items():
        if not got[i]["base_failed"]:
            a, b = refs.get(lang, (np.zeros(8), np.zeros(quality.COMMON_WORDS + 1)))
            refs[lang] = (a + classes, b + common(lang, plain))

    def distance(x, y):
        p, q = np.array(x) / np.sum(x), np.array(y) / np.sum(y)
        m = (p + q) / 2
        return math.sqrt(max(0.0, sum(a * math.log2(a / c) / 2 for a, c in zip(p, m) if a > 0) + sum(a * math.log2(a / c) / 2 for a, c in zip(q, m) if a > 0)))

    for i, (lang, plain, classes) in per_row.items():
        far = False
        if got[i]["word_chars"] >= quality.MIN_CHARS:
            assert got[i]["js_chars"] == pytest.approx(distance(classes, refs[lang][0]), abs=1e-9)
            far |= got[i]["js_chars"] > quality.MAX_CHARS_DISTANCE
        if len(plain) >= quality.MIN_WORDS:
            assert got[i]["js_words"] == pytest.approx(distance(common(lang, plain), refs[lang][1]), abs=1e-9)
            far |= got[i]["js_words"] > quality.MAX_WORDS_DISTANCE
        else:
            assert got[i]["js_words"] is None
        assert got[i]["kept"] == (not far and not got[i]["base_failed"])


def test_quality_keeps_clean_and_rejects_symbol_noise(docs):
    noisy = {r["doc_id"] for r in docs.collect() if len(re.findall(r"[#*$%&|<>]", r["text"])) > 0.2 * len(r["text"])}
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert noisy and not any(got[i] for i in noisy)
    clean = {r["doc_id"] for r in docs.collect() if not re.search(r"[#*$%&|<>0-9]", r["text"]) and not base_counts(r["text"])[5] and len(WORD.findall(r["text"])) > 50}
    assert sum(got[i] for i in clean) >= 0.97 * len(clean)


def test_quality_odd_rows_and_empty(spark):
    rows = odd_rows()
    got = quality.judge(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *base_counts(t)) for i, t, _ in rows)
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == want
    kept = quality.filtered(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert kept.count() == sum(r["kept"] for r in got)
    empty = documents(spark, [])
    assert quality.judge(empty).count() == 0 and quality.filtered(empty).count() == 0


def test_quality_rows_of_one_id_and_text_are_judged_one_by_one(spark):
    rng = random.Random(4)
    clean, far = [" ".join(rng.choice(words.split()) for _ in range(150)) for words in ("the cat and dog run to a red hill in sun", "der hund und katze im wald bei nacht am see")]
    few = sentence(rng, 5)
    rows = [(i, " ".join(rng.sample(clean.split(), 150)), "en") for i in range(10, 60)] + [(i, " ".join(rng.sample(far.split(), 150)), "de") for i in range(60, 110)]
    rows += [(1, far, "en"), (1, far, "de"), (-1, clean, "en"), (None, clean, "de"), (-1, few, "en"), (None, few, "en")]
    got = Counter((r["doc_id"], r["text"], r["lang"]) for r in quality.filtered(documents(spark, rows)).collect())
    assert got == Counter(r for r in rows if r not in {(1, far, "en"), (None, clean, "de"), (-1, few, "en"), (None, few, "en")})


# Line dedup


def one_edit(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < lines.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return a[p + 1:] == b[p + 1:]
    a, b = max(a, b, key=len), min(a, b, key=len)
    return a[p + 1:] == b[p:]


def plain_line_dedup(rows):
    """(doc_id, kept text) of rows (doc_id, text), each line against all earlier ones."""
    before, out = [], []
    for i, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in text.split("\n"):
            w = tuple(re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip(" ").split(" "))
            if w == ("",):
                kept.append(line)
                continue
            if not any(one_edit(w, v) for v in before):
                kept.append(line)
            before.append(w)
        out.append((i, "\n".join(kept)))
    return out


def test_line_dedup_matches_plain_version_on_edited_lines(spark):
    rng = random.Random(3)
    pool = [sentence(rng, n).split() for n in (1, 2, 3, 4, 5, 5, 6, 7, 8, 12, 13, 30)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                kind, at = rng.choice("sdi"), rng.randrange(len(w)) if w else 0
                if kind == "s" and w:
                    w[at] = rng.choice(["xx", "yy", w[0]])
                elif kind == "d" and len(w) > 1:
                    del w[at]
                else:
                    w.insert(rng.randint(0, len(w)), rng.choice(["xx", "zz", w[at] if w else "q"]))
            text.append(rng.choice(["", " ", "\t"]).join(["", " ".join(w) if rng.random() < 0.8 else "  ".join(w).upper(), ""]))
        rows.append((i, "\n".join(text)))
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(documents(spark, [(i, t, "en") for i, t in rows])).collect()}
    assert got == dict(plain_line_dedup(rows))


def test_line_dedup_on_documents(spark, docs):
    want = dict(plain_line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()]))
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["__kept_in"]) for r in lines.deduplicated(docs).collect()}
    assert {i: v[0] for i, v in got.items()} == want
    assert all(n == len(t) for t, n, k in got.values() if k)


def test_line_dedup_one_line_in_most_documents(spark):
    rng = random.Random(8)
    hot = sentence(rng, 9)
    rows = [(i, hot + "\n" + sentence(rng, 12), "en") for i in range(300)]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(documents(spark, rows)).collect()}
    assert got[0].startswith(hot) and all(hot not in got[i] for i in range(1, 300))


def test_line_dedup_odd_rows_and_empty(spark):
    d = documents(spark, odd_rows())
    got = lines.deduplicated(d)
    assert got.columns == d.columns + ["__gone", "__kept_in"]
    rows = {(r["doc_id"], i) for i, r in enumerate(got.collect())}
    assert len(rows) == len(odd_rows())
    by = {r["doc_id"]: r["text"] for r in got.where("doc_id is not null").collect()}
    assert by[1] is None and by[2] == "" and by[3] == " \n\t " and by[9] == "a\n\nb\n" and by[5] == ""
    assert [r["text"] for r in got.where("doc_id is null").orderBy("text").collect()] == ["", ""]
    assert lines.deduplicated(documents(spark, [])).count() == 0


# SimHash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    parts = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    comp = {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(ids[a]), find(ids[b])
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_plain_version(docs):
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = plain_components([r["doc_id"] for r in rows], fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == {r["doc_id"]: f for r, f in zip(rows, fps)}
    assert {i: r["component_id"] for i, r in got.items()} == want
    kept = {r["doc_id"] for r in simhash.dedup(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_covering_masks_meet_every_pair_within_the_radius():
    masks = simhash.masks(3)
    assert len(masks) == 15
    for positions in [(a, b, c) for a in range(0, 64, 3) for b in range(a, 64, 5) for c in range(b, 64)]:
        flip = sum(1 << p for p in set(positions))
        assert any(m & flip == 0 for m in masks)


def test_near_edges_with_small_blocks_and_a_dense_group(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 60:
        fps.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))))
    fps |= {rng.getrandbits(64) for _ in range(40)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.near_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, block=8)
    from rankline.llm.common import connected_components
    comp = {r["node"]: r["comp"] for r in connected_components(edges).collect()}
    want = plain_components(list(range(len(fps))), fps)
    groups = Counter()
    for a in range(len(fps)):
        for b in range(a):
            assert (want[a] == want[b]) == (comp.get(signed[a], signed[a]) == comp.get(signed[b], signed[b]))
        groups[want[a]] += 1
    assert max(groups.values()) >= 40


def test_simhash_dedup_keeps_one_row_of_a_component(spark):
    rng = random.Random(8)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    rows = [(1, a, "en")] * 50 + [(1, a, "de"), (2, a, "en"), (None, a, "en")] + [(None, b, "en")] * 3 + [(None, b.upper(), "en")] + [(None, c, "en")] + [(3, d, "en"), (-1, c, "en"), (3, d.upper(), "en")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"].lower(), r["lang"]) for r in simhash.dedup(documents(spark, rows)).collect())
    assert got == [(False, -1, c, "en"), (False, 1, a, "de"), (False, 3, d, "en"), (True, 0, b, "en")]


def test_simhash_odd_rows_and_empty(spark):
    d = documents(spark, odd_rows())
    got = simhash.near_duplicates(d).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and by[1]["fingerprint"] == "0" * 16
    assert by[4]["component_id"] == 4 == by[5]["component_id"]
    kept = simhash.dedup(d)
    assert kept.columns == d.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert 4 in left and 5 not in left and 1 in left and 2 not in left
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 and simhash.dedup(documents(spark, [])).count() == 0


def test_connected_components_of_a_path_and_a_star(spark):
    from rankline.llm.common import connected_components
    path = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(200, 260)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{j: 7 for j in range(200, 260)}, 7: 7}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_text_md5_of_query(spark):
    import __spark_entry__ as e
    got = {r["doc_id"]: r for r in e.queries()["op10_line_dedup"](spark, SF).collect()}
    want = dict(plain_line_dedup([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
    assert {i: r["text_md5"] for i, r in got.items()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()}
