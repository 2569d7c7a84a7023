"""The batch upsert (singles natively + component fold) against a plain sequential fold
written from the ingest rules, on the fixture batch and on random colliding batches."""

import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from rankline.operators import ingest as IG
from rankline.plans import queries as Q
from rankline.sources import testdata as TD

from conftest import SF_SMALL

INC, EXC = Q.INCLUDE, Q.EXCLUDE


def _fold(stored, payloads, include, exclude):
    """Sequential reference fold: returns {seq: outcome} and final rows by key."""
    rows = {r["id"]: dict(r) for r in stored}
    kws = set(include)

    def find(p):
        if p["external_id"]:
            for r in rows.values():
                if r["source"] == p["source"] and r["external_id"] == p["external_id"]:
                    return r
        for r in rows.values():
            if r["source"] == p["source"] and r["url"] == p["url"]:
                return r
        return None

    def words(text):
        t = text.casefold()
        return sum(1 for k in kws if re.search(r"\b" + re.escape(k.casefold()) + r"\b", t))

    def classify(title, desc):
        t = f"{title}\n{desc}".casefold()
        for k in exclude:
            if k.casefold() in t:
                return "discarded", f"Palavra excluida: {k}"
        for k in include:
            if k.casefold() in t:
                return "ready_for_ai", None
        return "pending", None

    out = {}
    for p in sorted(payloads, key=lambda x: x["seq"]):
        p = {k: (v.strip() if isinstance(v, str) else v) for k, v in p.items()}
        p["source"] = p["source"].lower()
        if not p["title"] or not p["company"] or not p["url"] or not p["source"]:
            out[p["seq"]] = "failed"
            continue
        kw = p["search_keyword"] or None
        ex = find(p)
        if ex is not None:
            changed = kw is not None and kw not in ex["search_keywords"]
            new = dict(ex)
            if changed:
                new["search_keywords"] = ex["search_keywords"] + [kw]
            for f in IG.COMPARED:
                if ex[f] != p[f]:
                    new[f] = p[f]
                    changed = True
            if not changed:
                out[p["seq"]] = "skipped"
                continue
            if any(r is not ex and r["source"] == new["source"] and r["url"] == new["url"]
                   for r in rows.values()):
                out[p["seq"]] = "failed"
                continue
            if new["status"] != "analyzed":
                new["status"], new["filter_reason"] = classify(new["title"], new["description_raw"])
            rows[ex["id"]] = new
            out[p["seq"]] = "updated"
        else:
            if include and words(f"{p['title']}\n{p['description_raw']}") < 3:
                out[p["seq"]] = "discarded"
                continue
            st, rs = classify(p["title"], p["description_raw"])
            rows[-p["seq"]] = dict(id=-p["seq"], external_id=p["external_id"] or None,
                                   title=p["title"], company=p["company"], url=p["url"],
                                   source=p["source"], description_raw=p["description_raw"],
                                   location=p["location"], salary=p["salary"],
                                   created_at=p["created_at"], status=st, filter_reason=rs,
                                   search_keywords=[kw] if kw else [])
            out[p["seq"]] = "inserted"
    return out, rows


def _as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_fixture_batch_matches_sequential_fold(spark):
    stored = TD.stored_rows(spark, SF_SMALL)
    inc = TD.incoming_batch(spark, SF_SMALL)
    got = IG.upsert_outcomes(stored, inc, INC, EXC, F.lit("2025-01-01").cast("timestamp_ntz"))
    got = {r.seq: (r.outcome, r.status, r.title) for r in got.collect()}
    exp, rows = _fold(_as_dicts(stored), _as_dicts(inc), INC, EXC)
    assert {k: v[0] for k, v in got.items()} == exp


def test_random_colliding_batches(spark):
    rnd = random.Random(7)
    ts = datetime(2024, 1, 1)
    stored = []
    for i in range(1, 9):
        stored.append(dict(id=i, external_id=rnd.choice([None, f"e{i}"]), title=f"t{i}",
                           company="c", url=f"u{i}", source="s", description_raw="with from thing",
                           location=None, salary=None, created_at=ts, status="pending",
                           filter_reason=None, search_keywords=["k"], ai_score=None,
                           ai_summary=None, ai_analysis_at=None, first_seen_at=ts,
                           last_seen_at=ts, updated_at=ts))
    schema = ("id long, external_id string, title string, company string, url string, "
              "source string, description_raw string, location string, salary string, "
              "created_at timestamp_ntz, status string, filter_reason string, "
              "search_keywords array<string>, ai_score int, ai_summary string, "
              "ai_analysis_at timestamp_ntz, first_seen_at timestamp_ntz, "
              "last_seen_at timestamp_ntz, updated_at timestamp_ntz")
    for trial in range(3):
        pays = []
        for s in range(1, 25):
            pays.append(dict(seq=s, external_id=rnd.choice([None, "", f"e{rnd.randint(1, 12)}"]),
                             title=rnd.choice(["t1", "t2", "new", " t3 "]), company="c",
                             url=f"u{rnd.randint(1, 12)}", source=rnd.choice(["s", "S"]),
                             description_raw=rnd.choice(["with from thing", "nothing"]),
                             search_keyword=rnd.choice([None, "k", "k2"]), location=None,
                             salary=None, created_at=ts))
        pschema = ("seq long, external_id string, title string, company string, url string, "
                   "source string, description_raw string, search_keyword string, "
                   "location string, salary string, created_at timestamp_ntz")
        sdf = spark.createDataFrame(stored, schema)
        pdf = spark.createDataFrame(pays, pschema)
        got = IG.upsert_outcomes(sdf, pdf, INC, EXC, F.lit("2025-01-01").cast("timestamp_ntz"))
        got = {r.seq: r.outcome for r in got.collect()}
        exp, _ = _fold(stored, pays, INC, EXC)
        assert got == exp, trial


def _final_key(rows):
    return sorted((r["source"], r["url"], r["title"], r["status"], tuple(r["search_keywords"]),
                   r["external_id"]) for r in rows)


def test_final_table_and_hot_chain(spark):
    """A hot url shared by many payloads with different external ids and terms (one chain),
    next to colliding keys; the new table equals the sequential fold's table."""
    rnd = random.Random(11)
    ts = datetime(2024, 1, 1)
    stored = [dict(id=i, external_id=f"e{i}" if i % 2 else None, title=f"t{i}", company="c",
                   url=f"u{i}", source="s", description_raw="with from thing", location=None,
                   salary=None, created_at=ts, status="analyzed" if i == 3 else "pending",
                   filter_reason=None, search_keywords=["k"], ai_score=None, ai_summary=None,
                   ai_analysis_at=None, first_seen_at=ts, last_seen_at=ts, updated_at=ts)
              for i in range(1, 6)]
    pays = []
    for s in range(1, 80):
        hot = s % 3 != 0
        pays.append(dict(seq=s, external_id=f"h{rnd.randint(1, 30)}" if hot else rnd.choice([None, f"e{rnd.randint(1, 7)}"]),
                         title=rnd.choice(["a", "b"]), company="c",
                         url="HOT" if hot else f"u{rnd.randint(1, 7)}", source="s",
                         description_raw=rnd.choice(["with from thing", "with from thing pour", "nothing"]),
                         search_keyword=rnd.choice([None, "k", "k2", "k3"]), location=None,
                         salary=None, created_at=ts))
    schema = ("id long, external_id string, title string, company string, url string, "
              "source string, description_raw string, location string, salary string, "
              "created_at timestamp_ntz, status string, filter_reason string, "
              "search_keywords array<string>, ai_score int, ai_summary string, "
              "ai_analysis_at timestamp_ntz, first_seen_at timestamp_ntz, "
              "last_seen_at timestamp_ntz, updated_at timestamp_ntz")
    pschema = ("seq long, external_id string, title string, company string, url string, "
               "source string, description_raw string, search_keyword string, "
               "location string, salary string, created_at timestamp_ntz")
    sdf = spark.createDataFrame(stored, schema)
    pdf = spark.createDataFrame(pays, pschema)
    table, outcomes = IG.apply_batch(sdf, pdf, INC, EXC, F.lit("2025-01-01").cast("timestamp_ntz"))
    exp_out, exp_rows = _fold(stored, pays, INC, EXC)
    assert {r.seq: r.outcome for r in outcomes.collect()} == exp_out
    assert _final_key(_as_dicts(table)) == _final_key(exp_rows.values())


PSCHEMA = ("seq long, external_id string, title string, company string, url string, "
           "source string, description_raw string, search_keyword string, location string, "
           "salary string, created_at timestamp_ntz")


def test_same_job_under_several_terms(spark):
    """Inserted, then updated (new term), then skipped (known term), then updated (changed
    description); the stored row keeps the terms in order."""
    ts = datetime(2026, 3, 27, 10)
    base = dict(external_id="job-1", title="Backend Engineer", company="Acme",
                url="https://example.com/jobs/1", source="feed_a", location=None, salary=None,
                created_at=ts)
    pays = [dict(base, seq=1, search_keyword="python", description_raw="d"),
            dict(base, seq=2, search_keyword="django", description_raw="d"),
            dict(base, seq=3, search_keyword="python", description_raw="d"),
            dict(base, seq=4, search_keyword="python", description_raw="d2")]
    empty = spark.createDataFrame([], "id long, external_id string, title string, company string, "
                                      "url string, source string, description_raw string, location string, "
                                      "salary string, created_at timestamp_ntz, status string, "
                                      "filter_reason string, search_keywords array<string>, ai_score int, "
                                      "ai_summary string, ai_analysis_at timestamp_ntz, "
                                      "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, "
                                      "updated_at timestamp_ntz")
    table, out = IG.apply_batch(empty, spark.createDataFrame(pays, PSCHEMA), [], [],
                                F.lit("2026-04-01").cast("timestamp_ntz"))
    assert [r.outcome for r in out.orderBy("seq").collect()] == ["inserted", "updated", "skipped", "updated"]
    rows = table.collect()
    assert len(rows) == 1 and list(rows[0].search_keywords) == ["python", "django"]
    assert rows[0].description_raw == "d2" and rows[0].status == "pending"


def test_external_id_chains_against_sequential_fold(spark):
    """Groups sharing an external id over many urls (ext chains), with and without a stored
    row holding the id, mixed with url collisions; outcomes and final table as the fold."""
    rnd = random.Random(23)
    ts = datetime(2024, 1, 1)
    stored = [dict(id=i, external_id=f"x{i}", title="t", company="c", url=f"s{i}", source="s",
                   description_raw="with from thing", location=None, salary=None, created_at=ts,
                   status="pending", filter_reason=None, search_keywords=["k"], ai_score=None,
                   ai_summary=None, ai_analysis_at=None, first_seen_at=ts, last_seen_at=ts,
                   updated_at=ts) for i in range(1, 4)]
    schema = ("id long, external_id string, title string, company string, url string, "
              "source string, description_raw string, location string, salary string, "
              "created_at timestamp_ntz, status string, filter_reason string, "
              "search_keywords array<string>, ai_score int, ai_summary string, "
              "ai_analysis_at timestamp_ntz, first_seen_at timestamp_ntz, "
              "last_seen_at timestamp_ntz, updated_at timestamp_ntz")
    for trial in range(3):
        pays = []
        for s in range(1, 40):
            ext = rnd.choice(["x1", "x2", "y1", "y2", None])
            url = f"p{s}" if rnd.random() < 0.7 else rnd.choice(["s1", "s3", "q1", "q2"])
            pays.append(dict(seq=s, external_id=ext, title=rnd.choice(["a", "b"]), company="c",
                             url=url, source="s",
                             description_raw=rnd.choice(["with from thing", "nothing"]),
                             search_keyword=rnd.choice([None, "k", "k2"]), location=None,
                             salary=None, created_at=ts))
        sdf = spark.createDataFrame(stored, schema)
        pdf = spark.createDataFrame(pays, PSCHEMA)
        table, outcomes = IG.apply_batch(sdf, pdf, INC, EXC, F.lit("2025-01-01").cast("timestamp_ntz"))
        exp_out, exp_rows = _fold(stored, pays, INC, EXC)
        assert {r.seq: r.outcome for r in outcomes.collect()} == exp_out, trial
        assert _final_key(_as_dicts(table)) == _final_key(exp_rows.values()), trial


def test_external_id_chain_shapes(spark):
    """Deterministic ext chains: an id spread over fresh urls with a stored target, an id
    never seen (insert chain), an id whose url group is not closed; checked against the
    fold, and the chain kinds are the expected ones."""
    ts = datetime(2024, 1, 1)
    stored = [dict(id=i, external_id=f"x{i}", title="t", company="c", url=f"s{i}", source="s",
                   description_raw="with from thing", location=None, salary=None, created_at=ts,
                   status="pending", filter_reason=None, search_keywords=["k"], ai_score=None,
                   ai_summary=None, ai_analysis_at=None, first_seen_at=ts, last_seen_at=ts,
                   updated_at=ts) for i in (1, 2)]
    spec = [("x1", "p1", "a", "k"), ("x1", "p2", "a", "k2"), ("x1", "p3", "b", "k"),
            ("y1", "p4", "a", "k"), ("y1", "p5", "b", "k3"), ("y1", "p4", "b", "k3"),
            ("x2", "s2", "a", None), ("x2", "p6", "b", "k"), (None, "p7", "a", "k")]
    pays = [dict(seq=i + 1, external_id=e, title=t, company="c", url=u, source="s",
                 description_raw="with from thing pour" if i != 3 else "nothing",
                 search_keyword=kw, location=None, salary=None, created_at=ts)
            for i, (e, u, t, kw) in enumerate(spec)]
    schema = ("id long, external_id string, title string, company string, url string, "
              "source string, description_raw string, location string, salary string, "
              "created_at timestamp_ntz, status string, filter_reason string, "
              "search_keywords array<string>, ai_score int, ai_summary string, "
              "ai_analysis_at timestamp_ntz, first_seen_at timestamp_ntz, "
              "last_seen_at timestamp_ntz, updated_at timestamp_ntz")
    sdf = spark.createDataFrame(stored, schema)
    pdf = spark.createDataFrame(pays, PSCHEMA)
    flags = IG.chain_flags(IG.identity_match(sdf, pdf))
    kinds = {r.seq: (r.chain, r.chain_key.split("\u0001")[0]) for r in flags.collect()}
    assert all(kinds[s] == (True, "e") for s in range(1, 9)) and kinds[9] == (True, "u")
    table, outcomes = IG.apply_batch(sdf, pdf, INC, EXC, F.lit("2025-01-01").cast("timestamp_ntz"))
    exp_out, exp_rows = _fold(stored, pays, INC, EXC)
    assert {r.seq: r.outcome for r in outcomes.collect()} == exp_out
    assert _final_key(_as_dicts(table)) == _final_key(exp_rows.values())


def test_a_payload_with_seq_zero_is_no_stored_row(spark):
    stored = TD.stored_rows(spark, SF_SMALL).where("false")
    ts = datetime(2026, 3, 25, 10, 0)
    # ids and urls shared crosswise, so that the payloads interact
    keys = [("a", "u1"), ("a", "u2"), ("b", "u2"), ("b", "u1")]
    rows = [(i, e, f"from with thing {i}", "co", u, "feed_a", "", "t", None, None, ts) for i, (e, u) in enumerate(keys)]
    batch = spark.createDataFrame(rows, "seq long, external_id string, title string, company string, url string, source string, "
                                        "description_raw string, search_keyword string, location string, salary string, created_at timestamp_ntz")
    got = {r["seq"]: r for r in IG.upsert_outcomes(stored, batch, INC, EXC, F.lit(ts)).collect()}
    assert got[0]["outcome"] == "inserted" and got[1]["outcome"] == "updated"
    assert {r["matched_id"] for r in got.values()} == {None}
    want, _ = _fold([], [r.asDict() for r in batch.collect()], INC, EXC)
    assert {s: r["outcome"] for s, r in got.items()} == want
