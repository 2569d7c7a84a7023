"""Continuous ingestion (R1-R5) with Structured Streaming.

Landed payload files are read with ``readStream``; every micro-batch (one cycle) is cut
at the per-source checkpoint read from the table at the start of the batch (R4), upserted
and committed as a new table version named after the batch id (R5: replaying a committed
batch is a no-op). ``availableNow`` runs one pass over what has landed (R2); a processing
time trigger polls (R1); the stop rules (R3) are evaluated by the driver after each cycle.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.operators import fetch as FT
from rankline.operators import ingest as IG
from rankline.sources import store

PAYLOAD_SCHEMA = (
    "seq long, external_id string, title string, company string, url string, source string, "
    "description_raw string, search_keyword string, location string, salary string, "
    "created_at timestamp_ntz, cycle_id string"
)
FETCH = ["cycle_id", "source", "search_keyword"]


@dataclass
class CycleLog:
    """Per-cycle counters kept on the driver (A10 and the stop rules)."""

    cycles: int = 0
    empty_streak: int = 0
    stats: list[dict] = field(default_factory=list)
    poll_seconds: float | None = None
    last_end: float = field(default_factory=time.monotonic)

    def empty_cycles(self, idle: bool) -> int:
        """Cycles in a row without an insert or update; a trigger that finds no new file is
        one too, and Spark runs no batch for it."""
        polls = int((time.monotonic() - self.last_end) / self.poll_seconds) if idle and self.poll_seconds else 0
        return self.empty_streak + polls


def cycle_checkpoints(spark: SparkSession, root: str, table: DataFrame, batch: DataFrame, batch_id: int) -> DataFrame:
    """``cycle_id, source, checkpoint`` for the cycles of a batch: each cycle keeps the
    checkpoint of the table as it stood when its first file came, so all its terms and files
    are cut alike, also when they come in several batches."""
    folder = f"{root.rstrip('/')}_cycles"
    seen = batch.select("cycle_id").distinct()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    schema = "cycle_id string, source string, checkpoint timestamp_ntz, batch long"
    old = None
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.schema(schema).parquet(folder).where(F.col("batch") < batch_id)
        seen = seen.join(old.select(F.col("cycle_id").alias("__c")).distinct(), F.col("cycle_id").eqNullSafe(F.col("__c")), "left_anti")
    known = FT.checkpoints(table)
    marker = spark.createDataFrame([(None, None)], "source string, checkpoint timestamp_ntz")
    # a few cycles, each with the few sources; the marker names cycles that found an empty table
    rows = known.unionByName(marker).agg(F.collect_list(F.struct("source", "checkpoint")).alias("r")).first()["r"]
    new = seen.withColumn("r", F.explode(F.array(*[F.struct(
        F.lit(x["source"]).cast("string").alias("source"), F.lit(x["checkpoint"]).cast("timestamp_ntz").alias("checkpoint")) for x in rows])))
    new = new.select("cycle_id", "r.source", "r.checkpoint")
    new.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    return spark.read.schema(schema).parquet(folder).where(F.col("batch") <= batch_id).select("cycle_id", "source", "checkpoint")


def _upsert_batch(spark: SparkSession, root: str, include, exclude, batch: DataFrame,
                  batch_id: int, log: CycleLog, feed_order: str | None) -> None:
    if batch_id in store.committed_versions(spark, root):
        return  # R5: already committed
    table = store.read(spark, root)
    # Once per source and cycle. Files without a cycle_id that land together are a cycle.
    batch = batch.withColumn("cycle_id", F.coalesce("cycle_id", F.lit(f"batch-{batch_id}")))
    ck = cycle_checkpoints(spark, root, table, batch, batch_id)
    # feed order: a given ascending position column, else newest first
    order = F.col(feed_order) if feed_order else F.struct(
        (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("o"), F.col("seq"))
    cut = FT.take_while(batch, FETCH, order, ck, on=["cycle_id", "source"]).drop("cycle_id")
    as_of = F.lit(time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())).cast("timestamp_ntz")
    changed, outcomes = IG.apply_batch_changes(table, cut, include, exclude, as_of)
    store.write_changes(changed, root, batch_id)  # rewrites only the touched buckets
    row = outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in IG.OUTCOMES]).collect()[0]
    stats = row.asDict()
    log.cycles += 1
    new_or_updated = stats["inserted"] + stats["updated"]  # A10
    log.empty_streak = 0 if new_or_updated else log.empty_streak + 1
    log.stats.append({"batch_id": batch_id, **stats})
    log.last_end = time.monotonic()


def start(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    include: Sequence[str],
    exclude: Sequence[str],
    available_now: bool = True,
    poll_seconds: int = 300,
    files_per_trigger: int | None = None,
    feed_order: str | None = None,
):
    """Starts the ingestion stream; returns ``(query, log)``. By default a trigger takes all
    files that have landed, as one cycle. With ``files_per_trigger`` a cycle can span several
    triggers; its files then carry a ``cycle_id``."""
    log = CycleLog(poll_seconds=None if available_now else poll_seconds)
    files = spark.readStream.schema(PAYLOAD_SCHEMA)
    if files_per_trigger is not None:
        files = files.option("maxFilesPerTrigger", files_per_trigger)
    src = files.parquet(landing)
    writer = src.writeStream.foreachBatch(
        lambda df, bid: _upsert_batch(spark, root, include, exclude, df, bid, log, feed_order)
    ).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=f"{poll_seconds} seconds")
    return writer.start(), log


def run_until(query, log: CycleLog, max_cycles: int | None = None,
              max_duration_seconds: float | None = None, max_empty_cycles: int | None = None,
              poll: float = 0.5) -> str:
    """Stop a continuous stream after ``max_cycles``, once ``max_duration_seconds`` has
    passed, or after ``max_empty_cycles`` consecutive cycles with no insert or update (a
    poll that finds nothing is one). Checked between cycles only. Returns the reason."""
    t0 = time.monotonic()
    while query.isActive:
        reason = None
        now = query.status
        if not now["isTriggerActive"]:
            if max_cycles is not None and log.cycles >= max_cycles:
                reason = "max_cycles"
            elif max_duration_seconds is not None and time.monotonic() - t0 >= max_duration_seconds:
                reason = "max_duration"
            elif max_empty_cycles is not None and log.empty_cycles(now["message"].startswith("Waiting for data")) >= max_empty_cycles:
                reason = "max_empty_cycles"
        if reason:
            query.stop()
            return reason
        time.sleep(poll)
    return "finished"
