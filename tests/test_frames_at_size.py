"""Frames of many users: nothing that is exploded is broadcast, which a driver's memory would have to hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import signal
from tidewheel.plans import fixtures as fx
from tidewheel.plans.registry import LOUD, ORACLES, QUERIES

USERS, HOURS = 400, 720


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Few events a user, so that the table is small and its hours are many."""
    d = str(tmp_path_factory.mktemp("many"))
    i = F.col("id")
    ts = F.timestamp_micros(F.lit(3600000000).cast("long") * (F.when(i < 2, i * (HOURS - 1)).otherwise(F.pmod(F.xxhash64(i), F.lit(HOURS)))))
    spark.range(USERS * 6).select(i.alias("event_id"), ts.alias("ts"), (i % USERS).alias("user_id"), (i % 9 * 2.0).alias("value")).write.parquet(f"{d}/events.parquet")
    return d


def broadcast_rows(plan):
    """Rows of every broadcast of a plan that ran."""
    kind = plan.getClass().getSimpleName()
    if kind == "BroadcastExchangeExec":
        yield plan.metrics().apply("numOutputRows").value()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    for p in inner:
        yield from broadcast_rows(p)


@pytest.mark.parametrize("name", ["speech_regions", "empty_blocks", "progress_sample", "skipped_ranges", "speech_totals", "pause_blocks", "ungated_blocks", "gated_blocks"])
def test_no_exploded_table_is_broadcast(spark, many, name):
    df = QUERIES[name](spark, many)
    assert df.collect()
    assert max(broadcast_rows(df._jdf.queryExecution().executedPlan()), default=0) <= USERS * 6  # the table's rows


def test_frames_and_regions_of_odd_events_equal_sql(spark, tmp_path):
    """Users without a time, null users and values, one frame alone, silence at both ends."""
    duckdb = pytest.importorskip("duckdb")
    rng, rows = random.Random(3), [(None, 1, 9.0), (None, None, 9.0), (5, 7, 9.0), (30, None, 8.0), (31, 8, None), (60, 9, 9.0), (0, 10, 1.0), (None, 9, 2.0), (90, 11, 9.0), (0, 12, 9.0)]
    rows += [(rng.randrange(91), rng.randrange(20, 30), float(rng.randrange(12))) for _ in range(80)]
    df = spark.createDataFrame(rows, "hour int, user_id long, value double").select(F.timestamp_micros(F.col("hour").cast("long") * 3600000000 + 5).alias("ts"), "user_id", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    key = lambda r: tuple((x is not None, x) for x in r)
    for name in ("frame_rms", "speech_regions"):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        if name == "frame_rms":
            assert len(got) == 91 * len({u for _, u, _ in rows})
        else:
            assert {r[0] for r in got} >= {7, 9, 12}
        assert sorted(got, key=key) == sorted(con.execute(ORACLES[name]).fetchall(), key=key)
    assert fx.frames(spark, str(tmp_path)).where(F.col("rms") > LOUD).where("rec_id is null").count() == 0


def test_regions_of_one_block_need_no_frames(spark):
    """Only what is longer than a block meets frames; a null recording has none and stays whole."""
    frames = spark.createDataFrame([(1, i, 9.0 + i % 7) for i in range(100)], "rec_id long, frame int, rms double")
    regions = [(1, 0, 0, 29), (1, 1, 40, 100), (2, 0, 5, 34), (2, 1, 50, 51), (2, 2, 60, 60), (None, 0, 0, 90)]
    got = signal.pause_blocks(frames, spark.createDataFrame(regions, "rec_id long, region_no long, f0 long, f1 long"), least=2)
    cuts = signal.cut_points(np.array([9.0 + i % 7 for i in range(40, 100)]), 60, 12, 25, 29)
    ends = [0, *cuts]
    want = {(1, 0, 0, 29), (2, 0, 5, 34), (None, 0, 0, 90)} | {(1, k + 1, 40 + a, 40 + b) for k, (a, b) in enumerate(zip(ends, cuts))}
    assert len(cuts) > 1 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("name", ["gated_blocks", "pause_blocks", "ungated_blocks"])
def test_blocks_of_a_null_user_equal_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    i = F.col("id")
    ts = F.timestamp_micros(F.lit(3600000000).cast("long") * F.pmod(F.xxhash64(i), F.lit(200)))
    spark.range(1500).select(ts.alias("ts"), F.when(i % 4 > 0, i % 4).alias("user_id"), (i % 9 * 2.0).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()], con.execute(ORACLES[name]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[0] is None for r in got) == (name != "gated_blocks")
