"""Mixing, token files, packing, language ID, embeddings, licenses, HTML and the pipeline."""

from __future__ import annotations

import itertools
import os
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from cases import documents, odd_rows, sentence  # noqa: E402
from rankline.llm import embeddings, html, langid, licenses, mixing, packing, tokens  # noqa: E402

SF, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    return {r["doc_id"]: tok.encode(r["text"], add_special_tokens=False).ids + [2] for r in docs.collect()}


def crc(x) -> int:
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


# Mixing


@pytest.mark.parametrize("targets", [{"high": 0.3, "low": 0.6, "toxic": 0.1}, {"high": 0.0, "low": 0.6, "toxic": 0.4}])
def test_rates_meet_targets_and_match_plain_projected_gradient(spark, targets):
    d, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    rows = mixing.rates(d, labels, targets).collect()
    assert len(rows) == d.count()
    p = np.array([[r[f"p_{x}"] for x in mixing.DOMAINS] for r in rows])
    n = np.array([r["n_tokens"] for r in rows], dtype=float)
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    m, want, r = (p.T * n) @ p / n.sum(), np.array([targets[x] for x in mixing.DOMAINS]), np.ones(len(n))
    for _ in range(mixing.STEPS):
        gap = (p.T @ (r * n)) / n.sum() - want
        step = np.linalg.pinv(m, rcond=1e-9) @ gap
        if np.abs(gap).max() < mixing.CLOSE or np.abs(step).max() < mixing.CLOSE:
            break
        r = np.maximum(0, r - p @ step)
    got = np.array([x["rate"] for x in rows])
    assert np.allclose(got, r, atol=1e-6) and (got >= 0).all()
    assert (got == 0).any() == (targets["high"] == 0)  # out of reach: mixed documents hold some of it
    if targets["high"]:
        assert np.allclose((p.T @ (got * n)) / n.sum(), want, atol=2e-3)
    copies = np.array([x["copies"] for x in rows])
    assert ((copies == np.floor(got)) | (copies == np.floor(got) + 1)).all()
    assert abs(copies.mean() - got.mean()) < 0.1


def test_mixed_rows_follow_the_copies(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.rates(d, labels).collect() if r["copies"]}
    got = {}
    for r in mixing.mixed(d, labels).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want


def test_toxic_words_are_learned(spark):
    d, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    p = {r["doc_id"]: r["p_toxic"] for r in mixing.rates(d, labels).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    hit = [p[i] for i, t in toxic.items() if t and i in p]
    rest = [p[i] for i, t in toxic.items() if not t and i in p]
    assert np.mean(hit) > 5 * np.mean(rest)


def test_mixing_odd_rows_and_empty(spark):
    d = documents(spark, odd_rows())
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 0, 0), (None, 1, 1), (10, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.rates(d, labels).count() == len(odd_rows())
    assert mixing.mixed(d, labels).columns == d.columns
    none = labels.limit(0)
    got = mixing.rates(d, none).collect()
    assert all(abs(r["p_high"] - 1 / 3) < 1e-12 for r in got)
    assert mixing.rates(documents(spark, []), labels).count() == 0 and mixing.mixed(documents(spark, []), none).count() == 0


# Token files


def test_token_files_round_trip(spark, docs, ids):
    got = tokens.round_trip(docs).orderBy("doc_id").collect()
    start = 0
    for r, (i, x) in zip(got, sorted(ids.items()), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(x), crc(x))
        start += len(x)


def test_files_hold_the_ids_in_order(spark, docs, ids, tmp_path):
    made = tokens.write_files(docs, str(tmp_path)).orderBy("part").collect()
    flat = np.concatenate([np.memmap(tmp_path / f"tokens-{r['name']}.bin", dtype="<u2", mode="r") for r in made])
    assert flat.tolist() == [t for i in sorted(ids) for t in ids[i]]
    assert [r["base"] for r in made] == [0, *np.cumsum([r["n_tokens"] for r in made])[:-1].tolist()]


def test_pieces_give_the_ids_of_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.tokenizer_path())
    texts = ["", " ", "it's don't I'll  x\n\n\nY  ", "a²½ µ ª 日本 x", "<|endoftext|> a", "\ttwo\t\ttabs ", "\x1c a \x85 b\xa0c", "été_élan 12_34 ×÷ŉ",
             "a 'sb 'S ''t", "x\r\n y", "1 22  333", "_ __ _a_", "ÀÖØöøÿĀſƀɏ", "\U0001F600 smile", "é combining"]
    rng = random.Random(4)
    texts += ["".join(rng.choice(" \n\t'sdtrevml_09éß.,-²") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    encode = tokens.Encoder(tokens.tokenizer_path())
    assert encode.cuts
    for t in texts:
        assert np.frombuffer(encode(t), dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_token_files_odd_rows_and_empty(spark):
    got = tokens.round_trip(documents(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_tokens"] == 1 and by[i]["ids_crc32"] == crc([2]) for i in (1, 2))
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(order, order[1:]))
    assert tokens.round_trip(documents(spark, [])).count() == 0


# Packing


def check_packing(rows, ids, capacity):
    parts, bins = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert set(parts) == set(ids)
    for i, p in parts.items():
        p.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in p] == list(range(len(p)))
        assert p[0]["start"] == 0 and all(a["start"] + a["length"] == b["start"] for a, b in zip(p, p[1:]))
        assert sum(r["length"] for r in p) == len(ids[i]) and all(r["length"] == capacity for r in p[1:])
        assert all(r["ids_crc32"] == crc(ids[i][r["start"]:r["start"] + r["length"]]) for r in p)
    for b in bins.values():
        b.sort(key=lambda r: r["offset"])
        assert b[0]["offset"] == 0 and all(x["offset"] + x["length"] == y["offset"] for x, y in zip(b, b[1:]))
        assert b[-1]["offset"] + b[-1]["length"] <= capacity
    return bins


def test_packing_places_every_piece(docs, ids):
    bins = check_packing(packing.pack(docs).collect(), ids, 1024)
    assert len(bins) <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_packing_keeps_every_constraint():
    plan = packing.plan({200: 5, 100: 40, 30: 77, 1: 300}, capacity=256, max_docs=4, max_attention=45_000)
    state, placed = {}, {}
    for length, rank, n, first, offset in plan:
        for k in range(n):
            t, d, a = state.get(first + k, (0, 0, 0))
            assert t == offset
            state[first + k] = (t + length, d + 1, a + length ** 2)
            placed.setdefault(length, []).append(rank + k)
    assert all(t <= 256 and d <= 4 and a <= 45_000 for t, d, a in state.values())
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in {200: 5, 100: 40, 30: 77, 1: 300}.items()}
    with pytest.raises(ValueError):
        packing.plan({300: 1}, capacity=256)


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] + x <= capacity]
        if fits:
            max(fits, key=lambda b: b[0])[0] += x
        else:
            bins.append([x])
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_needs_no_more_bins_than_plain_best_fit(rule):
    rng = random.Random(6)
    for _ in range(5):
        lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 30)]) for _ in range(500)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        got = max(first + n for _, _, n, first, _ in packing.plan(counts, 100, 100, 10_000, rule=rule))
        assert got <= plain_best_fit(lengths, 100) * (1.02 if rule == "norm" else 1.25) + 1


def test_packing_odd_rows_and_empty(spark):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 5] + [(5, "the the", "en")]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokens.tokenizer_path())
    check_packing(packing.pack(documents(spark, rows)).collect(), {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}, 1024)
    assert packing.pack(documents(spark, odd_rows())).where("piece = 0").count() == len(odd_rows())
    assert packing.pack(documents(spark, [])).count() == 0


# Language ID


def test_language_id_on_held_out_rows(spark):
    d = spark.read.parquet(f"{MID}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict(d).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 0.1 * len(got)


def test_language_id_does_not_look_at_held_out_labels(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    changed = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    a, b = (sorted((r["doc_id"], r["lang_pred"], round(r["score"], 12)) for r in langid.predict(documents(spark, x)).collect()) for x in (rows, changed))
    assert a == b


def test_language_id_odd_rows_and_empty(spark):
    got = langid.predict(documents(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 11))
    assert langid.predict(documents(spark, [])).count() == 0
    assert [r["lang_pred"] for r in langid.predict(documents(spark, [(1, "abc", None)])).collect()] == ["und"]


def test_ngram_counts_of_long_texts_do_not_depend_on_the_chunk(monkeypatch):
    text = sentence(random.Random(1), 900)
    want = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert (langid.counts(text) == want).all()


# Embeddings


def plain_links(vectors, least):
    x = np.array(vectors, dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    comp = list(range(len(x)))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(near)):
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return near.sum(1), comp


def planted(n, seed=0, dims=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, n // 2, 2):  # partners at cosines around the bound
        noise = rng.standard_normal(dims)
        noise -= (noise @ x[i]) * x[i]
        c = rng.uniform(0.86, 0.99)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)
    x[n // 2:n // 2 + 20] = x[n // 2]  # a group of copies
    return x


def test_embeddings_match_brute_force_in_one_cell(spark):
    x = planted(600)
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, n int")).orderBy("vec_id").collect()
    n, comp = plain_links(x, 0.9)
    found = np.array([r["n_links"] for r in got])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert np.mean([r["component_id"] == c for r, c in zip(got, comp)]) >= 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings_recall_with_many_cells_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 64)
    monkeypatch.setattr(embeddings, "BLOCK", 24)
    x = planted(800, seed=3)
    g, tables, need = embeddings.calibration(800)
    assert g >= 3 and tables > 1 and 1 < need < embeddings.K
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    n, _ = plain_links(x, 0.9)
    found = np.array([r["n_links"] for r in got])
    assert (found <= n).all() and found.sum() >= 0.95 * n.sum()


def test_embeddings_odd_rows_and_empty(spark):
    schema = "vec_id long, embedding array<double>, id string, more int"
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (8, [2.0, 0.0]), (None, [0.0, 1.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e300, 1e290]), (12, [-1.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], schema)).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 10, 12))
    assert by[7]["n_links"] == 3 and by[8]["n_links"] == 3 and by[8]["component_id"] == 7 == by[11]["component_id"]
    assert by[9]["n_links"] == 1 and by[9]["component_id"] == 9 and by[None]["component_id"] == 9
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0


# Licenses


def test_license_lines_are_found_where_they_stand(spark):
    d = spark.read.parquet(f"{MID}/documents.parquet")
    want = set()
    for r in d.collect():
        for name in ("all-rights-reserved", "mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0"):
            for m in re.finditer(re.escape(licenses.TEMPLATES[name]), r["text"]):
                want.add((r["doc_id"], name, m.start(), m.end() - 1))  # the full stop is no word
    got = {(r["doc_id"], r["license"], r["span_start"], r["span_end"]) for r in licenses.matches(d).where("coverage = 1").collect()}
    assert want and got == want


def test_license_with_changed_words_and_longest_match(spark):
    text = "Intro words. " + licenses.TEMPLATES["mit-permission"].replace("copy, modify", "copy and modify").replace("free of charge", "gratis") + " end. All rights  RESERVED"
    got = licenses.matches(documents(spark, [(1, text, "en"), (2, "all rights", "en"), (3, "this work is licensed under", "en")])).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(1, "mit-permission"), (1, "all-rights-reserved")]
    assert 0.9 < got[0]["coverage"] < 1 and text[got[0]["span_start"]:].startswith("Permission") and text[:got[0]["span_end"]].endswith("do so")


def test_banded_alignment_is_the_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(1, 8))], [rng.randint(0, 4) for _ in range(rng.randint(1, 8))]
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert licenses.align(a, b, 0, band=10)[0] == table[-1, -1]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_with_a_fifth_of_its_words_changed_is_a_candidate(name):
    rng = np.random.default_rng(5)
    index = licenses.Index({name: licenses.TEMPLATES[name]})
    words = [m[0] for m in licenses.WORD.finditer(licenses.TEMPLATES[name])]
    for _ in range(200):
        changed = list(words)
        for i in rng.choice(len(words), size=len(words) // 5, replace=False):
            changed[i] = "zzz"
        text = "some words before " + " ".join(changed) + " and some behind"
        assert [m[0] for m in licenses.scan(text, index)] == [name], changed


def test_short_notice_with_another_article():
    found = licenses.scan("Released under a MIT License", licenses.Index(licenses.TEMPLATES))
    assert [(m[0], m[3], m[4]) for m in found] == [("mit", 4, 0.8)]


def test_overlapping_matches_as_by_trying_every_pair():
    rng = np.random.default_rng(6)
    for _ in range(300):
        found = [(int(c), int(a), int(a + n), int(t)) for c, a, n, t in rng.integers([1, 0, 0, 0], [9, 60, 12, 4], size=(25, 4))]
        kept = []
        for f in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1], f[3])):
            if all(f[2] < k[1] or f[1] > k[2] for k in kept):
                kept.append(f)
        assert licenses.apart(found) == sorted(kept, key=lambda f: f[1])


def test_licenses_odd_rows_and_empty(spark):
    assert licenses.matches(documents(spark, odd_rows())).count() == 0
    assert licenses.matches(documents(spark, [])).count() == 0
    twice = licenses.matches(documents(spark, [(1, "All rights reserved. x y z w All rights reserved.", "en")] * 2)).collect()
    assert len(twice) == 4


# HTML


def plain_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    from html import unescape
    parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{MID}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(pages).collect()}
    assert {i: t for i, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values())


def test_furniture_inside_and_outside_the_article():
    page = """<html><head><title>T</title></head><body class="menu-open"><header><h1>Site</h1></header><div id="cookie-notice">Cookies!</div>
    <main><article><h1>Big &amp; small</h1><p>First <a href=x>linked</a> text<br/>goes&nbsp;on.<p>Second <!-- no --> one.
    <aside>Aside</aside><ul><li>One<li>Two</ul><div class="ad-slot">Buy</div><form><label>Mail</label><input></form>
    <script>if (a < b) "</p>"</script><section class="comments"><p>Nice post</p></section></article></main>
    <div class="sidebar"><p>Other</p></div><footer>&copy; Foot</footer></body></html>"""
    assert html.extract(page, {}) == "Big & small\n\nFirst linked text goes on.\n\nSecond one.\n\nOne\n\nTwo"


@pytest.mark.parametrize("wrapper", ["class='content-sidebar-wrap'", "class='has-sidebar'", "id='page-with-menu'", "class='post-comments-open'"])
@pytest.mark.parametrize("name", ["<article>", "<main>", "<main><article class='tag-social'>", "<div role='main'>", "<div role=article>", "<article><div class=inner>"])
def test_layout_wrapper_around_the_article(wrapper, name):
    close = "".join(f"</{x}>" for x in reversed(re.findall(r"<(\w+)", name)))
    for inside in (f"<div {wrapper}>{{}}</div>", f"<body><div {wrapper}><section class='share-on'>{{}}</section></div>", f"<main><h1>T</h1><div {wrapper}>{{}}</div></main>"):
        page = inside.format(f"<div class=sidebar><p>Other</p></div>{name}<p>First.</p><section class='comments'><article class='comment'>Nice</article></section>"
                             f"<p>Second.</p>{close}<div class=related><article>Teaser</article></div><nav><article>Menu</article></nav>")
        assert html.extract("<header>Site</header>" + page + "<footer>Foot</footer>", {}) == ("T\n\n" if "<h1>" in inside else "") + "First.\n\nSecond."


def test_marked_articles_beside_the_main_text():
    for name in ("article", "main"):
        page = f"<{name}><p>Text.</p></{name}><div class='comments'><article>Nice</article></div><div class='related'><article>Teaser</article></div>"
        assert html.extract(page, {}) == "Text."
    assert html.extract("<aside><div class=has-sidebar><article>Aside</article></div></aside><form>Form</form><nav><main>Menu</main></nav>", {}) == ""
    assert html.extract("<div id='page-with-menu' role='main'><p>Text.</p></div>", {}) == html.extract("<div role='main' id='page-with-menu'><p>Text.</p></div>", {}) == "Text."


@pytest.fixture(scope="module")
def odds(spark):
    return html.learned(spark.read.parquet(f"{SF}/pages.parquet"))


SENTENCES = "A full sentence stands here and goes on for a while. " * 4
BODY = f"<p>{SENTENCES}</p>"


@pytest.mark.parametrize("page,n", [
    (f"<form id='aspnetForm'><label>Search</label><input><button>go</button>{BODY * 3}</form>", 3),
    (f"<form><article>{BODY * 2}</article></form>", 2),
    (f"<form><div class='has-sidebar'><main>{BODY}</main><form><p>Sign up today, please.</p></form></div></form>", 1),
    (f"<article>{BODY}</article><form><label>Name</label><p>Sign up for our list today, please.</p></form>", 1),
    (f"{BODY * 2}<form><p>Sign up for our list today, please.</p></form>", 2),
    (f"<div aria-hidden='true'><article>{BODY}</article></div><div role='dialog'><p>{SENTENCES}</p></div>", 1),
    (f"<div aria-hidden=true>{BODY}</div><div role='dialog'>Take it</div>", 1),
    (f"<article>{BODY}</article><div hidden>{BODY}</div><div style='display: none'>{BODY}</div><p style=visibility:hidden>{SENTENCES}</p>", 1),
    (f"<article>{BODY}<div hidden>{BODY}</div>{BODY}</article>", 2),
    (f"<article><section id='market-share'>{BODY * 2}</section></article>", 2),
    (f"<article>{BODY}<div class='restaurant-menu'>{BODY * 2}</div></article>", 3),
    (f"<article>{BODY}<div class='share-buttons'><a href=x>Tweet</a> <a href=y>Post</a></div>{BODY}</article>", 2),
    (f"<article>{BODY}<div class='ad'>Buy now, cheap.</div>{BODY}</article>", 2),
])
def test_forms_hidden_blocks_and_hints(odds, page, n):
    whole = f"<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>{page}<footer>(c) Site</footer></body></html>"
    assert html.extract(whole, odds) == "\n\n".join([SENTENCES.strip()] * n)


def test_time_of_a_long_page_grows_with_its_length(odds):
    unit = BODY + "<ul><li><a href=x>One</a></li><li><a href=y>Two three</a></li></ul><div><a>ab</a></div>"

    def seconds(n):
        began = time.process_time()
        assert html.extract("<body>" + unit * n, odds).count(SENTENCES.strip()) == n
        return time.process_time() - began

    assert seconds(8000) < 24 * max(seconds(1000), 0.05)


def test_layout_wrapper_without_landmarks(spark):
    odds = html.learned(spark.read.parquet(f"{SF}/pages.parquet"))
    words = sentence(random.Random(2), 60).capitalize() + "."
    page = f"<header>Site</header><div class='has-sidebar'><div><p>{words}</p><p>{words}</p></div><div class='sidebar'><p>{words}</p></div></div>"
    assert html.extract(page, odds) == f"{words}\n\n{words}"


def test_pages_without_landmarks_use_the_learned_measures(spark):
    odds = html.learned(spark.read.parquet(f"{SF}/pages.parquet"))
    words = sentence(random.Random(2), 60).capitalize() + "."
    page = "<body><div><a href=a>Home</a> <a href=b>News</a></div>" + f"<div><p>{words}</p><p>{words}</p></div>" + "<div><a href=c>Terms</a></div></body>"
    assert html.extract(page, odds) == f"{words}\n\n{words}"


def test_min_cut_is_the_smallest():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(i, j, round(rng.uniform(0, 2), 2)) for i in range(n) for j in range(i + 1, min(n, i + 3))]

        def price(labels):
            return sum(-c if c < 0 and x else c if c > 0 and not x else 0 for c, x in zip(costs, labels)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(price(x) for x in itertools.product([True, False], repeat=n))
        assert price(html.min_cut(costs, edges)) == pytest.approx(best)


def test_html_odd_rows_and_empty(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>x"), (3, "u", "no markup"), (4, "u", "<p><b>a<p>b</i></p></div><script>"), (5, "u", "<article><p>" + "long " * 100_000),
            (5, "u", "<!-- open"), (6, "u", "<a <b> < & &am &#x41; &#99999999;")]
    got = html.main_text(spark.createDataFrame([(*r, "t", 1) for r in rows], schema)).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["n_chars"]): r["text"] for r in got}
    assert by[(1, 0)] == "" and by[(2, 0)] == "" and by[(None, 1)] == "x" and (5, 499_999) in by
    assert html.main_text(spark.createDataFrame([], schema)).count() == 0


# Language ID against a plain version


def plain_language_id(rows):
    """Whole-table numpy version: every training row in one matrix per language."""
    train = sorted({(lang, i, t) for i, t, lang in rows if i is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1}, key=str)
    found = [(lang, langid.counts(t)) for lang, _, t in train]
    held = [c > 0 for _, c in found if c is not None]
    idf = np.log((1 + len(held)) / (1 + np.sum(held, axis=0))) + 0.05
    parts = []
    for lang in sorted({x[0] for x in train}):
        x = np.array([langid.vector(t, idf) for n, _, t in train if n == lang and langid.counts(t) is not None])
        c, _ = langid._cluster(x, langid.CENTROIDS)
        parts += [(lang, y) for y in c]
    out = {}
    for i, t, _ in rows:
        v = langid.vector(t, idf)
        near = [(y @ v, lang) for lang, y in parts] if v is not None else []
        out[i] = max(near)[1] if near else "und"
    return out


def test_language_id_agrees_with_a_plain_version(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(documents(spark, rows)).collect()}
    want = plain_language_id(rows)  # the same rows, in another order of the start
    assert np.mean([got[i] == want[i] for i in want]) > 0.99


def test_language_sample_of_repeated_rows(spark):
    rows = [(i % 7, f"the same row {i % 7}", "en") for i in range(3000)] + [(10 + i, f"ein anderer Satz {i}", "de") for i in range(900)]
    got = langid.fitted_rows(documents(spark, rows), sample=50).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 7, "de": 50}


# Token files: tasks that read


def test_as_many_tasks_read_as_there_are_parts(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i, f"text {i}", "en") for i in range(400)]  # a third without an id
    made = tokens.write_files(documents(spark, rows), str(tmp_path))
    parts = made.collect()
    assert len(parts) == 8 and max(p["n_docs"] for p in parts) < 120
    read = tokens.read_files(made, str(tmp_path))
    assert read.count() == 400
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() >= 7


# Pipeline


def test_pipeline_stages_follow_their_operators(spark):
    import corpus_pipeline as c
    from rankline.llm import lines, quality, simhash
    from test_text_operators import plain_components, plain_fingerprint, plain_line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(c.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "simhash dedup", "mixing to target weights", "best-fit packing"]
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    one = stages["quality rules"](spark, docs, SF)
    assert one.columns == names and {r["doc_id"] for r in one.collect()} == kept
    two = stages["line dedup"](spark, one, SF)
    rows = {r["doc_id"]: r["text"] for r in two.collect()}
    assert two.columns == names and rows == dict(plain_line_dedup([(r["doc_id"], r["text"]) for r in one.collect()]))
    three = stages["simhash dedup"](spark, two, SF)
    order = list(rows)
    comp = plain_components(order, [plain_fingerprint(rows[i]) for i in order])
    assert three.columns == names and {r["doc_id"] for r in three.collect()} == {i for i, x in comp.items() if i == x}
    four = stages["mixing to target weights"](spark, three, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.rates(three, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert four.columns == names and sorted(r["doc_id"] for r in four.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    five = stages["best-fit packing"](spark, four, SF).collect()
    assert sum(r["length"] for r in five) == sum(len(x) // 4 for r in four.collect() for x in [tokens.encoder()(r["text"]) + b"\0" * 4])
    whole = c.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in five)


def test_pipeline_keeps_columns_with_clashing_names(spark):
    import corpus_pipeline as c

    names = ["__id", "__th", "__none", "__lang", "__gone", "__kept_in", "__n", "__copy", "__ends", "__parts", "__row", "___id"]
    d = documents(spark, [*odd_rows(), *[(50 + i, sentence(random.Random(i), 40) + "\nfirst second third fourth fifth", "en") for i in range(30)]])
    d = d.withColumns({n: F.concat(F.lit(n), F.coalesce("doc_id", F.lit(-5)).cast("string")) for n in names})
    d = d.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    for title, stage in c.STAGES[:-1]:
        after = stage(spark, d, SF)
        assert after.columns == d.columns, title
        for r in after.collect():
            assert all(r[n] == f"{n}{-5 if r['doc_id'] is None else r['doc_id']}" for n in names) and r["tags"] == {"a": r["doc_id"]}, title
        d = after


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as c

    for rows in (odd_rows(), []):
        d = documents(spark, rows)
        for _, stage in c.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == documents(spark, []).columns
        assert c.STAGES[-1][1](spark, d, SF).count() >= (1 if rows else 0)
