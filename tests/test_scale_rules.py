"""Cases in which size or odd input must not change an answer."""

import datetime as dt
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from rankline.functions import parse as PR
from rankline.functions import text as TX
from rankline.operators import fetch as FT
from rankline.operators import ingest as IG
from rankline.operators import maintain as MT
from rankline.operators import rules
from rankline.operators import scoring as SC
from rankline.sources import config as CF
from rankline.sources import feeds


def _file(tmp_path, fetch, text, name="part.json"):
    folder = tmp_path / f"fetch_id={fetch}"
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text(text)


def test_junk_elements_and_fractional_salaries_of_feed_a(spark, tmp_path):
    good = {"id": 1, "position": "p", "company": "c", "url": "u", "salary_min": 50000.5, "salary_max": 60000}
    _file(tmp_path, "a", json.dumps(["notice", good, 5, None, {**good, "id": 2, "salary_min": 0, "salary_max": 1234567.0}]))
    _file(tmp_path, "b", "{broken")
    rows = feeds.normalize_feed_a(feeds.read_feed_a(spark, str(tmp_path)), F.lit("x"), F.lit("2026-01-01").cast("timestamp_ntz")).orderBy("pos").collect()
    assert [(r.external_id, r.pos, r.salary) for r in rows] == [("1", 1, "USD 50,000.5 - USD 60,000"), ("2", 4, "USD up to 1,234,567.0")]
    assert [r.fetch_id for r in feeds.malformed_files(spark, str(tmp_path), feeds.FEED_A_SOURCE).collect()] == ["b"]


def test_junk_element_does_not_end_feed_b(spark, tmp_path):
    row = {"id": 1, "title": "t", "company": {"name": "c"}, "jobSalary": {"from": 1000.5, "to": None, "currency": "usd"}}
    _file(tmp_path, "a", json.dumps({"meta": {}, "data": [row, "junk", {**row, "id": 2}]}), "page=1.json")
    _file(tmp_path, "a", json.dumps({"meta": {}, "data": [{**row, "id": 3}]}), "page=2.json")
    rows = feeds.normalize_feed_b(feeds.read_feed_b(spark, str(tmp_path)), F.lit("x"), F.lit("2026-01-01").cast("timestamp_ntz"), "https://b")
    assert [(r.external_id, r.salary) for r in rows.orderBy("page", "pos").collect()] == [(str(i), "USD 1,000.5+") for i in (1, 2, 3)]


def test_a_fetch_without_a_term_is_cut_too(spark):
    rows = spark.createDataFrame([("a", None, i, dt.datetime(2026, 3, d)) for i, d in enumerate((27, 25, 28))], "source string, search_keyword string, pos int, created_at timestamp_ntz")
    ck = spark.createDataFrame([("a", dt.datetime(2026, 3, 26))], "source string, checkpoint timestamp_ntz")
    assert [r.pos for r in FT.take_while(rows, ["source", "search_keyword"], F.col("pos"), ck).collect()] == [0]


@pytest.mark.parametrize("text,want", [
    ("2026", None), ("2026-03", None), ("12:30", None), ("2026-3-5", None), (" 2026-03-05", None), ("2026-03-25T10:00 America/Sao_Paulo", None),
    ("20260325", "2026-03-25 00:00:00"), ("2026-03-25", "2026-03-25 00:00:00"), ("2026-03-25T10:00:00-03:00", "2026-03-25 13:00:00"),
    ("20260325T160004Z", "2026-03-25 16:00:04"), ("2026-03-25 10:00:00.250", "2026-03-25 10:00:00.25"),
])
def test_only_iso_texts_are_timestamps(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(PR.parse_feed_timestamp(F.col("t"), F.lit(None).cast("timestamp_ntz")).cast("string")).first()[0]
    assert got == want


def test_casefold_of_latin_letters_is_the_unicode_one(spark):
    places = [*range(0x250), *range(0x370, 0x400), *range(0x400, 0x530), 0xFB01, 0xFB02, 0xFB03, 0x1E9E]
    chars = [chr(i) for i in places if chr(i) not in "\u0149\u01f0\u0345\u0390\u03b0\u03d0\u03d1\u03d5\u03d6\u03f0\u03f1\u03f5"]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", TX.casefold("c").alias("f")).collect()
    assert [r.c for r in rows if r.f != r.c.casefold()] == []
    assert spark.createDataFrame([("Straße oﬃce µSERVICES",)], "c string").select(TX.casefold("c")).first()[0] == "strasse office μservices"


def test_keyword_hits_do_not_depend_on_the_number_of_keywords(spark):
    df = spark.createDataFrame([(1, "golang dev", "uses django c++"), (2, "go dev", "++ a.b"), (3, "", None)], "seq long, title string, description_raw string")
    kw = spark.createDataFrame([("x", i, k) for i, k in enumerate(["go", "dj", "++", "c++", "a.b", "dev", "zz", "d", "o d", "\u00b5", "DEV"])], "list_name string, pos int, keyword string")
    few, many = (sorted(map(tuple, rules.keyword_hits(df, kw, max_literal_keywords=n).collect())) for n in (100, 0))
    assert few == many and ("++" in {r[3] for r in many}) and (1, "x", 0, "go", True, False) in many


def test_many_keywords_are_found_by_whole_runs_without_shuffling_texts(spark):
    texts = ["golang dev\nc++ a.b a++b x++", "\u65e5\u672c\u8a9e" * 200 + "\u7d42", "x" * 700 + "yz", "o d  o\td \u00b5s \u00b2x _y", ""]
    df = spark.createDataFrame([(i, t, None if i % 2 else t[::-1]) for i, t in enumerate(texts)], "seq long, title string, description_raw string")
    words = ["go", "gol", "golang", "golf", "++", "c++", "a.b", "d", "o d", "\u00b5", " ", "\u672c", "\u7d42", "xyz", "\u00b2", "_y", "\n"]
    kw = spark.createDataFrame([("x", i, k) for i, k in enumerate(words)], "list_name string, pos int, keyword string")
    texts = df.select("seq", rules.content_col().alias("__content"))
    want = sorted(map(tuple, rules.keyword_hits(df, kw).collect()))
    assert want == sorted(map(tuple, rules.hits_by_join(texts, kw, "seq").collect())) == sorted(map(tuple, rules.hits_by_join(texts, kw, "seq", many=0).collect()))
    plain = rules.keyword_hits(df, kw.where("keyword rlike '^[a-z]+$'"), max_literal_keywords=0)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "MapInArrow" in plan


def test_many_profiles(spark):
    p = spark.createDataFrame([(1, "python dev", "")], "seq long, title string, description_raw string")
    profiles = spark.createDataFrame([(i, [], ["python"], [], None) for i in range(2 * CF.PROFILES_PER_SCAN + 3)], CF.PROFILE_SCHEMA)
    assert CF.rules_per_profile(p, profiles).select("profile_id").distinct().count() == 2 * CF.PROFILES_PER_SCAN + 3


def test_components_of_a_long_chain_and_of_large_nodes(spark):
    big = 1 << 61
    edges = [(i, i) for i in range(120)] + [(i, i + 1) for i in range(120)] + [(big + 2 * i, -1 - i // 3) for i in range(6)]
    got = {r.node: r.label for r in IG.components(spark.createDataFrame(edges, "node long, key long")).collect()}
    assert got == {**{i: 0 for i in range(120)}, **{big + 2 * i: big + 6 * (i // 3) for i in range(6)}}


def test_repeated_status_changes_are_refused(spark):
    changes = spark.createDataFrame([(1, "discarded"), (1, "ready_for_ai")], "id long, status string")
    jobs = spark.createDataFrame([(1, "pending", None)], "id long, status string, updated_at timestamp_ntz")
    with pytest.raises(ValueError):
        MT.manual_status(jobs, changes, F.lit("2026-01-01").cast("timestamp_ntz"))


def test_another_run_scores_anew_and_returns_the_asked_rows(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "python dev", ""), (2, "python ops", "")], "id long, title string, description_raw string")
    staging = f"{tmp_path}/{uuid.uuid4().hex}"

    def scorer(value):
        return lambda pdf: pdf["id"].map(lambda i: json.dumps({"score": value, "summary": "s"}))

    SC.score_and_stage(jobs, scorer(3), ["python"], [], staging, run="a").collect()
    again = SC.score_and_stage(jobs.where("id = 1"), scorer(8), ["python"], [], staging, run="b").collect()
    assert [(r.id, r.score) for r in again] == [(1, 8)]
    same = SC.score_and_stage(jobs.where("id = 2"), scorer(9), ["python"], [], staging, run="a").collect()
    assert [(r.id, r.score) for r in same] == [(2, 3)]


def test_payloads_without_a_target_are_spread(spark):
    left = spark.range(2000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, F.col("id") * 2).alias("target"))
    right = spark.range(4000).where("id % 3 <> 0").select(F.col("id").alias("target"), F.struct("id").alias("cur"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = IG.left_by(left, right, "target")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "target", "left").select("seq", "target", "cur").collect()), key=str)
        rows = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(rows) == 8 and max(rows) < 500
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_a_text_is_folded_once_for_all_keywords(spark):
    df = spark.createDataFrame([("Straße PHP", "python")], "title string, description_raw string").withColumn("t", rules.content_col())
    status, reason = rules.classification(["python", "x"], ["php", "y"], text="t")
    assert tuple(df.select(status, reason).first()) == ("discarded", rules.EXCLUDED_REASON_PREFIX + "php")
    assert "lower" not in str(status) and "lower" not in str(reason) and "lower" not in str(rules.gate_passes(["python"], 1, text="t"))
