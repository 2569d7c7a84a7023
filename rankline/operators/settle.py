"""Payloads that interact, applied as sets: the sequential fold (W4) as a fixed point.

A payload's outcome depends on earlier payloads through three things only: which row holds its
external id, which row stands at its url, and what the row it reaches holds. All three are
"the last event before me" under a key. Starting from a guess of every payload's row and
outcome, a round derives the events from the guess (a writer arrives at its url, its row leaves the
one before, its values are the row's) and looks all three up again for every payload. If a
round changes nothing, every payload agrees with all earlier ones, so by induction over
``seq`` the guess is the sequential result. After k rounds at least all payloads with a chain
of k dependencies are right; guesses are right far earlier, because most payloads only
repeat what the stored rows already tell.

Looking up the last event is a window over (key, slice of ``seq``) with the last event of
each earlier slice carried in, so a key that most payloads share is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankline.session import cut_lineage

SLICE = 20_000  # consecutive values of ``seq`` in one window
ROUNDS = 24  # rounds before what still changes is handed to the sequential fold
WRITES = ("inserted", "updated")


def hash128(columns: Sequence[Column]) -> Column:
    """Two 64-bit hashes of values and of which of them are null."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("b"))


def last_before(events: DataFrame, keys: Sequence[str], value: str, sliced: bool) -> Column | DataFrame:
    """``events`` (keys, seq, ``value``, ...) with ``__last``: the ``value`` of the latest row
    of the same key with a smaller seq and a value that is not null."""
    frame = Window.orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    if not sliced:
        return events.withColumn("__last", F.last(value, ignorenulls=True).over(frame.partitionBy(*keys)))
    e = events.withColumn("__slice", F.floor(F.col("seq") / SLICE))
    by = [*keys, "__slice"]
    e = e.withColumn("__near", F.last(value, ignorenulls=True).over(frame.partitionBy(*by)))
    ends = e.groupBy(*by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq"))).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, F.last("__end", ignorenulls=True).over(earlier).alias("__far")).where("__far is not null")
    return e.join(ends, by, "left").withColumn("__last", F.coalesce("__near", "__far")).drop("__slice", "__near", "__far")


def first_guess(payloads: DataFrame, rows: DataFrame) -> DataFrame:
    """Every payload against the stored rows alone."""
    row = F.coalesce("e_id", "u_id")
    g = payloads.withColumn("row", row).join(rows.select(F.col("id").alias("row"), F.col("fp").alias("__fp")), "row", "left")
    outcome = F.when(F.col("row").isNotNull(), F.when(F.col("fp") == F.col("__fp"), F.lit("skipped")).otherwise(F.lit("updated"))) \
        .when(F.col("passes"), F.lit("inserted")).otherwise(F.lit("discarded"))
    g = g.withColumn("outcome", outcome).drop("__fp")
    return g.withColumn("row", F.when(F.col("outcome") == "inserted", -F.col("seq") - 1).otherwise(F.col("row")))


def look_again(guess: DataFrame, rows: DataFrame, sliced: bool) -> DataFrame:
    """One round: row and outcome of every payload from the events of ``guess``; ``moved``
    tells whether they differ from it."""
    home = rows.select(F.col("id").alias("row"), F.col("url").alias("__url"))
    writes = guess.where(F.col("outcome").isin(*WRITES))
    moves = last_before(writes.select("source", "row", "seq", "url"), ["row"], "url", sliced).join(home, "row", "left")
    # a round in three plans: in one, each use of a look-up repeats all that is before it (half a megabyte of plan)
    moves = cut_lineage(moves.select("source", F.coalesce("__last", "__url").alias("left"), "url", "seq").where("left <> url"))
    # who stands at a url: arrivals are rows of the payloads themselves
    at = guess.select("source", "url", "seq", F.when(F.col("outcome").isin(*WRITES), F.struct(F.col("row").alias("who"))).alias("event"), F.lit(True).alias("asks"))
    gone = moves.select("source", F.col("left").alias("url"), "seq", F.struct(F.lit(None).cast("long").alias("who")).alias("event"), F.lit(False).alias("asks"))
    stands = last_before(at.unionByName(gone), ["source", "url"], "event", sliced).where("asks").select("seq", F.col("__last").alias("event"))
    g = guess.withColumnsRenamed({"row": "was_row", "outcome": "was"}).drop("moved").join(stands, "seq")
    g = g.withColumn("holder", F.when(F.col("event").isNull(), F.col("u_id")).otherwise(F.col("event.who"))).drop("event")
    # who holds an external id: ids are given at insertion and stay
    given = guess.where("outcome = 'inserted' and external_id is not null").groupBy("source", "external_id").agg(F.min("seq").alias("born"))
    named = g.where("external_id is not null").join(given, ["source", "external_id"], "left")
    g = named.unionByName(g.where("external_id is null").withColumn("born", F.lit(None).cast("long")))
    g = g.withColumn("row", F.coalesce("e_id", F.when(F.col("born") < F.col("seq"), -F.col("born") - 1), "holder")).drop("born")
    g = cut_lineage(g)
    # what the row holds
    asks = g.select("row", "seq", F.lit(None).cast(g.schema["fp"].dataType).alias("held"), F.lit(True).alias("asks")).where("row is not null")
    tells = writes.select("row", "seq", F.col("fp").alias("held"), F.lit(False).alias("asks"))
    held = last_before(tells.unionByName(asks), ["row"], "held", sliced).where("asks").select("seq", F.col("__last").alias("held"))
    terms = writes.where("kw is not null").groupBy("row", "kw").agg(F.min("seq").alias("told"))
    stored = rows.select(F.col("id").alias("row"), F.col("fp").alias("__fp"), F.col("keywords").alias("__kws"))
    g = g.join(held, "seq", "left").join(stored, "row", "left").join(terms, ["row", "kw"], "left")
    known = F.coalesce(F.array_contains("__kws", F.col("kw")), F.lit(False)) | F.coalesce(F.col("told") < F.col("seq"), F.lit(False))
    changed = (F.col("kw").isNotNull() & ~known) | ~F.coalesce("held", "__fp").eqNullSafe(F.col("fp"))
    outcome = F.when(F.col("row").isNull(), F.when(F.col("passes"), F.lit("inserted")).otherwise(F.lit("discarded"))) \
        .when(~changed, F.lit("skipped")).when(F.col("holder") != F.col("row"), F.lit("failed")).otherwise(F.lit("updated"))
    g = g.withColumn("outcome", outcome).withColumn("row", F.when(F.col("outcome") == "inserted", -F.col("seq") - 1).otherwise(F.col("row")))
    moved = ~F.col("row").eqNullSafe(F.col("was_row")) | (F.col("outcome") != F.col("was"))
    return g.withColumn("moved", moved).drop("was_row", "was", "holder", "held", "told", "__fp", "__kws")


def settled(payloads: DataFrame, rows: DataFrame, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """Payloads with ``row`` (a stored id, or -seq - 1 of the inserting payload), ``outcome`` and
    ``moved`` (still changing after the last round), and whether none is.

    ``payloads``: seq, source, external_id, url, e_id, u_id, kw, passes, rule_status,
    rule_reason, fp. ``rows``: the stored rows that e_id and u_id name: id, external_id, url, fp,
    keywords, status, filter_reason."""
    low, high = payloads.agg(F.min("seq"), F.max("seq")).first()
    sliced = low is not None and low // SLICE != high // SLICE
    g = cut_lineage(first_guess(payloads, rows).withColumn("moved", F.lit(True)))
    for _ in range(ROUNDS if rounds is None else rounds):
        g = cut_lineage(look_again(g, rows, sliced))
        if g.where("moved").isEmpty():
            return g, True
    return g, False


def final_rows(g: DataFrame, rows: DataFrame) -> DataFrame:
    """The state that settled payloads leave in every stored row and every inserted one: row,
    src_seq (the last writer), keywords, status, filter_reason, first_seen_new, touched, row_ext."""
    writes = g.where(F.col("outcome").isin(*WRITES))
    last = writes.groupBy("row").agg(
        F.max("seq").alias("src_seq"), F.max_by("rule_status", "seq").alias("rule_status"), F.max_by("rule_reason", "seq").alias("rule_reason"),
        F.min_by("external_id", "seq").alias("given"))
    terms = writes.where("kw is not null").groupBy("row", "kw").agg(F.min("seq").alias("told"))
    told = terms.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("told", "kw"))), lambda x: x["kw"]).alias("told"))
    r = rows.withColumnRenamed("id", "row").withColumn("stored", F.lit(True)).join(last, "row", "full").join(told, "row", "left")
    none = F.array().cast("array<string>")
    old, new = F.coalesce("keywords", none), F.coalesce("told", none)
    stays = F.col("src_seq").isNull() | F.coalesce(F.col("status") == "analyzed", F.lit(False))
    return r.select(
        "row", "src_seq", F.concat(old, F.array_except(new, old)).alias("keywords"),
        F.when(stays, F.col("status")).otherwise(F.col("rule_status")).alias("status"),
        F.when(stays, F.col("filter_reason")).otherwise(F.col("rule_reason")).alias("filter_reason"),
        F.col("stored").isNull().alias("first_seen_new"), F.col("src_seq").isNotNull().alias("touched"),
        F.when(F.col("stored"), F.col("external_id")).otherwise(F.col("given")).alias("row_ext"))
