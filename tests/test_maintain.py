"""Maintenance operators: dedup merge priorities and keyword order, cleanup, manual status,
keyword backfill, rule profiles and the snapshot store."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankline.operators import maintain as MT
from rankline.session import shared_path
from rankline.sources import config as CF
from rankline.sources import store as ST

T0 = datetime(2024, 1, 1)
SCHEMA = ("id long, external_id string, source string, url string, status string, "
          "filter_reason string, ai_score int, ai_summary string, ai_analysis_at timestamp_ntz, "
          "search_keywords array<string>, first_seen_at timestamp_ntz")


def _row(i, ext, url, status, score=None, kws=(), minutes=0):
    return (i, ext, "s", url, status, f"r{i}", score, f"m{i}" if score is not None else None,
            None, list(kws), T0 + timedelta(minutes=minutes))


def test_dedup_merge_priority_ties_and_keywords(spark):
    rows = [
        _row(5, "e1", "u5", "pending", kws=["b", ""], minutes=1),
        _row(2, "e1", "u2", "discarded", kws=["a", "b"], minutes=3),
        _row(9, "e1", "u9", "discarded", kws=["c"], minutes=2),
        _row(7, None, "ux", "analyzed", 8, kws=["z"], minutes=5),
        _row(8, None, "ux", "analyzed", 3, kws=["y", "z"], minutes=5),
        _row(4, None, "solo", "pending", kws=["q", "q"], minutes=0),
    ]
    out = {r.id: r for r in MT.dedup_merge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {5, 7, 4}
    # survivor: earliest first_seen; best: highest priority, ties to the earliest
    assert (out[5].url, out[5].status, out[5].filter_reason) == ("u5", "discarded", "r9")
    assert list(out[5].search_keywords) == ["b", "c", "a"]
    assert (out[7].ai_score, list(out[7].search_keywords)) == (8, ["z", "y"])
    assert list(out[4].search_keywords) == ["q", "q"] and out[4].n_merged == 1
    groups = {(r.key_type, r.key_value): r.n for r in MT.duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert groups == {("e", "e1"): 3, ("u", "ux"): 2}


def _jobs(spark):
    return spark.createDataFrame(
        [(1, "Python Django FastAPI", "", "pending", None), (2, "python", "", "ready_for_ai", None),
         (3, "nada", "", "analyzed", None)],
        "id long, title string, description_raw string, status string, filter_reason string",
    ).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))


def test_cleanup(spark):
    kept = {r.id for r in MT.cleanup(_jobs(spark), ["Python", "python", "Django", "FastAPI"], 3).collect()}
    assert kept == {1, 3}  # casefold dedupe: 'Python'/'python' count once
    with pytest.raises(ValueError):
        MT.cleanup(_jobs(spark), [], 3)


def test_manual_status(spark):
    changes = spark.createDataFrame([(1, "discarded"), (3, "analyzed"), (999, "ready_for_ai")],
                                    "id long, status string")
    new, outs = MT.manual_status(_jobs(spark), changes, F.lit("2025-01-01").cast("timestamp_ntz"))
    o = {r.id: r.outcome for r in outs.collect()}
    assert o == {1: "updated", 3: "invalid_status", 999: "not_found"}
    n = {r.id: r for r in new.collect()}
    assert n[1].status == "discarded" and n[1].updated_at is not None and n[3].status == "analyzed"


def test_keyword_backfill_roundtrip(spark):
    df = spark.createDataFrame([(1, "python"), (2, ""), (3, None)], "id long, search_keyword string")
    up = MT.backfill_keywords(df)
    assert [list(r.search_keywords) for r in up.orderBy("id").collect()] == [["python"], [], []]
    down = MT.downgrade_keywords(up)
    assert [r.search_keyword for r in down.orderBy("id").collect()] == ["python", None, None]


def test_profiles_read_seed_patch(spark, tmp_path):
    yml = tmp_path / "rules.yaml"
    yml.write_text("search_terms: [python, ' ', vue]\nfilters:\n  include_keywords: [Python]\n")
    seed = CF.load_yaml_rules(str(yml))
    assert seed == {"search_terms": ["python", "vue"], "include_keywords": ["Python"], "exclude_keywords": []}
    assert CF.load_yaml_rules(str(tmp_path / "missing.yaml"))["search_terms"] == []
    empty = spark.createDataFrame([], CF.PROFILE_SCHEMA)
    now = F.lit("2025-01-01").cast("timestamp_ntz")
    seeded = CF.seed_if_empty(spark, empty, seed, now)
    assert CF.active_profile(spark, seeded, {})["include_keywords"] == ["Python"]
    patched = CF.patch(seeded, spark.createDataFrame([(1, None, [" Go ", ""], None)],
                                                     "profile_id long, search_terms array<string>, "
                                                     "include_keywords array<string>, exclude_keywords array<string>"), now)
    prof = CF.active_profile(spark, patched, {})
    assert prof == {"search_terms": ["python", "vue"], "include_keywords": ["Go"], "exclude_keywords": []}
    assert CF.seed_if_empty(spark, patched, {"search_terms": ["x"]}, now).count() == 1


def test_store_versions(spark):
    root = shared_path(spark, "test_store", uuid.uuid4().hex)
    assert ST.read(spark, root).count() == 0
    row = (1, None, "t", "c", "u", "s", ["k"], "d", None, None, "pending", None, None, None, None,
           T0, T0, T0, T0)
    df = spark.createDataFrame([row], ST.JOBS_SCHEMA)
    assert ST.write(df, root, 0) is True
    assert ST.write(df.union(df.withColumn("id", F.lit(2).cast("long"))), root, 1) is True
    assert ST.write(df, root, 1) is False
    assert ST.latest_version(spark, root) == 1 and ST.read(spark, root).count() == 2
    assert ST.read(spark, root, 0).count() == 1
    assert ST.prune(spark, root, retain=1) == [0]


def test_store_rewrites_only_touched_buckets(spark):
    root = shared_path(spark, "test_store_b", uuid.uuid4().hex)
    rows = [(i, None, f"t{i}", "c", f"u{i}", "s", ["k"], "d", None, None, "pending", None, None,
             None, None, T0, T0, T0, T0) for i in range(1, 11)]
    base = spark.createDataFrame(rows, ST.JOBS_SCHEMA)
    assert ST.write(base, root, 0, buckets=64)
    changed = base.where("id = 3").withColumn("title", F.lit("new")).unionByName(
        base.where("id = 1").withColumn("id", F.lit(100).cast("long")))
    assert ST.write_changes(changed, root, 1)
    m = ST.manifest(spark, root)
    rewritten = sorted(int(b) for b, f in m["files"].items() if f.startswith("data/v=1/"))
    assert rewritten == [3, 36]
    t = {r.id: r.title for r in ST.read(spark, root).collect()}
    assert len(t) == 11 and t[3] == "new" and t[100] == "t1"
    assert ST.write_changes(changed, root, 1) is False
    assert ST.write_changes(base.where("id = 2").limit(0), root, 2,
                            deleted_ids=base.where("id = 2").select("id"))
    assert 2 not in {r.id for r in ST.read(spark, root).collect()}
    assert "2" not in ST.manifest(spark, root)["files"]


def test_rules_per_profile(spark):
    posts = spark.createDataFrame([(1, "Python Django FastAPI", ""), (2, "PHP dev", "")],
                                  "seq long, title string, description_raw string")
    profiles = spark.createDataFrame(
        [(1, [], ["Python", "Django", "FastAPI"], ["PHP"]), (2, [], ["PHP"], [])],
        "profile_id long, search_terms array<string>, include_keywords array<string>, "
        "exclude_keywords array<string>")
    out = {(r.seq, r.profile_id): (r.status, r.match_count, r.passes)
           for r in CF.rules_per_profile(posts, profiles).collect()}
    assert out == {(1, 1): ("ready_for_ai", 3, True), (2, 1): ("discarded", 0, False),
                   (1, 2): ("pending", 0, False), (2, 2): ("ready_for_ai", 1, False)}


def test_dedup_merge_hot_group(spark):
    """One key holding most rows: one survivor, best status, ordered distinct keywords."""
    n = 3000
    df = spark.range(1, n + 1).select(
        F.col("id"), F.lit("hot").alias("external_id"), F.lit("s").alias("source"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") == 1700, F.lit("analyzed")).otherwise(F.lit("pending")).alias("status"),
        F.lit(None).cast("string").alias("filter_reason"),
        F.when(F.col("id") == 1700, F.lit(9)).cast("int").alias("ai_score"),
        F.lit(None).cast("string").alias("ai_summary"),
        F.lit(None).cast("timestamp_ntz").alias("ai_analysis_at"),
        F.array(F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).alias("search_keywords"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("first_seen_at"),
    ).repartition(8)
    out = MT.dedup_merge(df).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.id, r.status, r.ai_score, r.n_merged) == (1, "analyzed", 9, n)
    assert list(r.search_keywords) == ["k1", "k2", "k0"]
