"""Payloads applied as sets against the sequential fold, and lookups that leave stored rows in place."""

import random

import pandas as pd
from pyspark.sql import functions as F

from rankline.operators import ingest as IG
from rankline.operators import settle
from rankline.session import cut_lineage
from rankline.sources import testdata as TD

from conftest import SF_SMALL

P = ("seq long, source string, external_id string, url string, e_id long, u_id long, kw string, passes boolean, rule_status string, "
     "rule_reason string, fp struct<a: long, b: long>")
R = "id long, source string, external_id string, url string, fp struct<a: long, b: long>, keywords array<string>, status string, filter_reason string"


def _interacting(rng, n, ids, urls):
    """Payloads and stored rows over a few ids and urls; a row's values name its url and a title."""
    rows = [(i, "s", f"e{i}" if i % 3 else None, f"u{i}", (10 * i, 0), ["k"], "analyzed" if i == 4 else "pending", None) for i in range(1, 8)]
    by_e, by_u = {r[2]: r[0] for r in rows if r[2]}, {r[3]: r[0] for r in rows}
    pays = []
    for s in range(n):
        e, u = rng.choice([None, f"e{rng.randint(1, ids)}"]), rng.randint(1, urls)
        pays.append((3 * s, "s", e, f"u{u}", by_e.get(e), by_u.get(f"u{u}"), rng.choice([None, "k", "k2", "k3"]), rng.random() < 0.7,
                     rng.choice(["pending", "ready_for_ai"]), None, (10 * u + rng.randint(0, 1), 0)))
    return pays, rows


def test_settled_payloads_equal_the_sequential_fold(spark, monkeypatch):
    monkeypatch.setattr(settle, "SLICE", 30)
    pays, rows = _interacting(random.Random(5), 40, 14, 12)
    cols = ["comp", "kind", "seq", "id", "source", "external_id", "url", "fp", "keywords", "search_keyword", "status", "filter_reason", "passes", "rule_status", "rule_reason"]
    recs = [(0, "p", p[0], None, p[1], p[2], p[3], list(p[10]), None, p[6], None, None, p[7], p[8], p[9]) for p in pays]
    recs += [(0, "s", None, r[0], r[1], r[2], r[3], list(r[4]), r[5], None, r[6], r[7], None, None, None) for r in rows]
    want = IG._fold_component(pd.DataFrame(recs, columns=cols, dtype=object))
    rdf = cut_lineage(spark.createDataFrame(rows, R))
    g, done = settle.settled(cut_lineage(spark.createDataFrame(pays, P)), rdf)
    assert done
    assert {r["seq"]: (r["outcome"], r["row"]) for r in g.collect()} == {w["seq"]: (w["outcome"], w["row_key"]) for w in want if w["outcome"] != "row"}
    names = ["src_seq", "status", "filter_reason", "first_seen_new", "touched", "row_ext"]
    got = {r["row"]: ([r[n] for n in names], list(r["keywords"])) for r in settle.final_rows(g, rdf).collect()}
    assert got == {w["row_key"]: ([w[n] for n in names], list(w["keywords"])) for w in want if w["outcome"] == "row"}


def test_stored_rows_are_scanned_but_not_shuffled_for_a_small_batch(spark, tmp_path):
    """Only what carries a key of the batch leaves the scan of the stored rows; the wide columns of other rows are not read for it."""
    TD.stored_rows(spark, SF_SMALL).write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    inc = TD.incoming_batch(spark, SF_SMALL)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    wide = plan(IG.rows_of(stored, inc.select(F.col("seq").alias("id"))))
    assert "LeftSemi, BuildRight" in wide and "hashpartitioning(id" not in wide
    keys = IG._holders(stored, ["source", "url"], inc, True)
    assert "LeftSemi, BuildRight" in plan(keys) and "description_raw" not in plan(keys).split("Scan parquet")[-1]


def test_last_before_in_slices_equals_one_window(spark, monkeypatch):
    monkeypatch.setattr(settle, "SLICE", 7)
    rng = random.Random(8)
    rows = [(rng.choice("ab"), s, rng.choice([None, s])) for s in range(120)] + [("hot", 1000 + s, s if s == 3 else None) for s in range(60)]
    d = spark.createDataFrame(rows, "k string, seq long, v long")
    a, b = (sorted(map(tuple, settle.last_before(d, ["k"], "v", x).select("k", "seq", "__last").collect())) for x in (False, True))
    assert a == b and a[-1][2] == 3


def test_hash_tells_null_from_empty_and_moved_values(spark):
    rows = [(None, "a"), ("a", None), ("", "a"), ("a", ""), (None, None), ("", ""), ("a", "a")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string")
    assert d.select(settle.hash128([F.col("x"), F.col("y")]).alias("h")).distinct().count() == len(rows)
