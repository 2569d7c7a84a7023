"""Streaming ingestion: availableNow over several files equals one batch; replaying a
committed batch is a no-op; the store keeps versions."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from rankline.operators import ingest as IG
from rankline.plans import queries as Q
from rankline.session import shared_path
from rankline.sources import store as ST
from rankline.sources import testdata as TD
from rankline.streaming import ingest_stream as IS

from conftest import SF_SMALL


def _key(df):
    return sorted((r.source, r.url, r.title, r.status, tuple(r.search_keywords))
                  for r in df.select("source", "url", "title", "status", "search_keywords").collect())


def test_stream_equals_one_batch_and_replay(spark):
    run = shared_path(spark, "test_stream", uuid.uuid4().hex)
    Q.land_postings(spark, SF_SMALL, f"{run}/landing")
    q, log = IS.start(spark, f"{run}/landing", f"{run}/jobs", f"{run}/_ck", Q.INCLUDE, Q.EXCLUDE, files_per_trigger=1)
    q.awaitTermination()
    assert len(log.stats) == Q.STREAM_FILES
    streamed = ST.read(spark, f"{run}/jobs")

    empty = spark.createDataFrame([], ST.JOBS_SCHEMA)
    payloads = spark.read.schema(IS.PAYLOAD_SCHEMA).parquet(f"{run}/landing").drop("cycle_id")
    one, _ = IG.apply_batch(empty, payloads, Q.INCLUDE, Q.EXCLUDE, F.lit("2025-01-01").cast("timestamp_ntz"))
    assert _key(streamed) == _key(one)

    versions = ST.committed_versions(spark, f"{run}/jobs")
    assert versions == list(range(Q.STREAM_FILES))
    assert ST.write(streamed, f"{run}/jobs", versions[-1]) is False  # replay: no-op


def test_checkpoint_cut_drops_late_rows(spark):
    run = shared_path(spark, "test_stream_cut", uuid.uuid4().hex)
    p = TD.postings(spark, SF_SMALL).select(
        "seq", "external_id", "title", "company", "url", "source", "description_raw",
        "search_keyword", F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("salary"), "created_at")
    # newest half lands first, the older half afterwards: all of it is at or before the checkpoint
    mid = 100
    p.where(F.col("seq") >= mid).coalesce(1).write.parquet(f"{run}/landing/part=0")
    p.where(F.col("seq") < mid).coalesce(1).write.parquet(f"{run}/landing/part=1")
    q, log = IS.start(spark, f"{run}/landing", f"{run}/jobs", f"{run}/_ck", [], [], files_per_trigger=1)
    q.awaitTermination()
    assert log.stats[1]["inserted"] == 0 and sum(log.stats[1][o] for o in IG.OUTCOMES) == 0


def test_continuous_mode_stops_after_empty_cycles(spark):
    """A polling stream; the second file repeats the first (no insert or update),
    so the driver stops it after that cycle and the idle polls that follow."""
    run = shared_path(spark, "test_stream_poll", uuid.uuid4().hex)
    p = TD.postings(spark, SF_SMALL).select(
        "seq", "external_id", "title", "company", "url", "source", "description_raw",
        "search_keyword", F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("salary"), "created_at").where(F.col("seq") < 40)
    p.coalesce(1).write.parquet(f"{run}/landing/part=0")
    q, log = IS.start(spark, f"{run}/landing", f"{run}/jobs", f"{run}/_ck", [], [],
                      available_now=False, poll_seconds=1)
    import threading
    import time

    def land_again():
        while log.cycles < 1:
            time.sleep(0.2)
        p.coalesce(1).write.parquet(f"{run}/landing/part=1")

    threading.Thread(target=land_again, daemon=True).start()
    reason = IS.run_until(q, log, max_cycles=10, max_empty_cycles=9, poll=0.2)
    assert reason == "max_empty_cycles"
    assert log.stats[0]["inserted"] > 0
    assert log.stats[-1]["inserted"] == 0 and log.stats[-1]["updated"] == 0


def _land(spark, path, rows):
    cols = ("seq long, external_id string, title string, company string, url string, source string, description_raw string, "
            "search_keyword string, location string, salary string, created_at timestamp_ntz, cycle_id string")
    full = [(s, e, "t " + e, "c", "https://x/" + e, "a", "", term, None, None, dt.datetime(2026, 3, day), cycle) for s, e, term, day, cycle in rows]
    spark.createDataFrame(full, cols).coalesce(1).write.parquet(path)


def test_terms_of_one_cycle_share_the_checkpoint(spark):
    """Two files of one source and cycle, one per trigger: the second term is not cut at
    what the first one brought; the next cycle is."""
    run = shared_path(spark, "test_stream_cycle", uuid.uuid4().hex)
    _land(spark, f"{run}/landing/part=0", [(1, "e1", "python", 27, "c1"), (2, "e2", "python", 26, "c1")])
    _land(spark, f"{run}/landing/part=1", [(3, "e3", "django", 26, "c1"), (4, "e4", "django", 25, "c1")])
    q, log = IS.start(spark, f"{run}/landing", f"{run}/jobs", f"{run}/_ck", [], [], files_per_trigger=1)
    q.awaitTermination()
    assert len(log.stats) == 2
    assert {r.external_id for r in ST.read(spark, f"{run}/jobs").collect()} == {"e1", "e2", "e3", "e4"}
    _land(spark, f"{run}/landing/part=2", [(5, "e5", "python", 28, "c2"), (6, "e6", "python", 27, "c2"), (7, "e7", None, 24, "c2")])
    q, log = IS.start(spark, f"{run}/landing", f"{run}/jobs", f"{run}/_ck", [], [], files_per_trigger=1)
    q.awaitTermination()
    assert {r.external_id for r in ST.read(spark, f"{run}/jobs").collect()} == {"e1", "e2", "e3", "e4", "e5"}


def test_files_that_land_together_are_one_cycle(spark):
    run = shared_path(spark, "test_stream_together", uuid.uuid4().hex)
    _land(spark, f"{run}/landing/part=0", [(1, "e1", "python", 27, None)])
    _land(spark, f"{run}/landing/part=1", [(3, "e3", "django", 26, None)])
    q, log = IS.start(spark, f"{run}/landing", f"{run}/jobs", f"{run}/_ck", [], [])
    q.awaitTermination()
    assert len(log.stats) == 1 and log.stats[0]["inserted"] == 2


def test_idle_polls_stop_the_stream(spark):
    run = shared_path(spark, "test_stream_idle", uuid.uuid4().hex)
    _land(spark, f"{run}/landing/part=0", [(1, "e1", "python", 27, None)])
    q, log = IS.start(spark, f"{run}/landing", f"{run}/jobs", f"{run}/_ck", [], [], available_now=False, poll_seconds=1)
    assert IS.run_until(q, log, max_duration_seconds=120, max_empty_cycles=3, poll=0.2) == "max_empty_cycles"
    assert log.cycles == 1 and log.stats[0]["inserted"] == 1


def test_a_range_is_landed_by_all_tasks_that_read_it(spark):
    run = shared_path(spark, "test_land", uuid.uuid4().hex)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(3).write.parquet(f"{run}/sf/documents.parquet")
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a task a file
        Q.land_postings(spark, f"{run}/sf", f"{run}/landing", parts=2)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    landed = spark.read.schema(IS.PAYLOAD_SCHEMA).parquet(f"{run}/landing")
    assert sorted(r.seq for r in landed.select("seq").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for k in range(2):
        files = spark.read.parquet(f"{run}/landing/part={k}").select(F.col("_metadata.file_path").alias("f"), "seq").groupBy("f").agg(F.max("seq"), F.min("seq")).collect()
        assert len(files) > 1
