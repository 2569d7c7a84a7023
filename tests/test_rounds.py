"""What rounds of joins leave on the driver: size estimates, plans and the number of rounds."""

import random

from pyspark.sql import functions as F

from rankline.operators import ingest as IG
from rankline.operators import settle
from rankline.session import cut_lineage
from rankline.sources import testdata as TD

from conftest import SF_SMALL


def _bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """Each round joins the last with itself, which squared the estimate that a checkpoint keeps."""
    df = cut_lineage(spark.range(50).select("id", F.struct("id", F.lit("x").alias("x")).alias("s"), F.array("id").alias("a")))
    want = df.schema
    for _ in range(6):
        df = cut_lineage(df.join(df.select(F.col("id").alias("o"), F.lit(1).alias("n")), F.col("id") == F.col("o")).drop("o", "n"))
    assert _bits(df) < 64
    assert df.schema.simpleString() == want.simpleString()
    assert sorted(map(tuple, df.select("id", "s.x", F.col("a")[0]).collect())) == [(i, "x", i) for i in range(50)]
    # the rows are read from the checkpoint, whose plan they no longer hold
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_components_of_a_path_in_any_order_take_few_rounds(spark, monkeypatch):
    """A region hears of a smaller label by its own least node, not hop by hop."""
    cuts = []
    monkeypatch.setattr(IG, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    ids = list(range(300))
    random.Random(3).shuffle(ids)
    # ends of regions of 30: their least nodes stand at the far end of the way that labels come
    path = [n for k in range(10) for n in sorted(ids[30 * k:30 * k + 30], reverse=True)]
    pairs = [(n, f"k{i}") for i, n in enumerate(path)] + [(n, f"k{i}") for i, n in enumerate(path[1:])]
    alone = [(1000 + i, f"a{i // 2}") for i in range(6)]
    got = {r.node: r.label for r in IG.components(spark.createDataFrame(pairs + alone, "node long, key string")).collect()}
    assert got == {**{n: 0 for n in path}, **{1000 + i: 1000 + i // 2 * 2 for i in range(6)}}
    assert (len(cuts) - 2) / 2 <= 10


def test_a_settling_round_is_planned_in_small_parts(spark, monkeypatch):
    """In one plan, a round over slices of seq had 400 kB of text, written again at each stage."""
    monkeypatch.setattr(settle, "SLICE", 10)
    p = spark.createDataFrame([(i, "s", f"e{i % 7}", f"u{i % 5}", None, None, "k", True, "pending", None, (i % 2, 0)) for i in range(40)],
                              "seq long, source string, external_id string, url string, e_id long, u_id long, kw string, passes boolean, "
                              "rule_status string, rule_reason string, fp struct<a: long, b: long>")
    rows = cut_lineage(spark.createDataFrame([], "id long, external_id string, url string, fp struct<a: long, b: long>, keywords array<string>, status string, filter_reason string"))
    sizes = []

    def cut(df):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return cut_lineage(df)

    monkeypatch.setattr(settle, "cut_lineage", cut)
    guess = cut_lineage(settle.first_guess(p, rows).withColumn("moved", F.lit(True)))
    out = settle.look_again(guess, rows, True)
    sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert out.count() == 40
    assert len(sizes) > 1 and max(sizes) < 40_000, sizes


def test_a_batch_is_planned_in_small_parts(spark, monkeypatch):
    """Both chain shapes were one plan of 28 stages, and the interacting payloads were found anew for each join."""
    sizes = []

    def cut(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return cut_lineage(df)

    stored, batch = cut_lineage(TD.stored_rows(spark, SF_SMALL)), cut_lineage(TD.incoming_batch(spark, SF_SMALL))
    monkeypatch.setattr(IG, "cut_lineage", cut)
    out = IG.upsert_outcomes(stored, batch, ["from", "with"], ["token"], F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    sizes.append(out._jdf.queryExecution().optimizedPlan().toString().count("Join "))
    assert out.count() == 200
    assert max(sizes) <= 14, sizes
