"""Streams over several triggers with restarts: alert keys, latest rows, ingest-time lags, repeats in and beyond the delay."""

import os
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocast.operators import windows as W
from aerocast.streaming import ingest as ST

DDL = "k string, ts timestamp, v double, i long"
START = datetime(2024, 1, 1)


def landed(spark, folder, rows):
    ST.land(spark.createDataFrame([(k, START + timedelta(minutes=m), v, i) for k, m, v, i in rows], DDL).coalesce(1), folder)


def paths(*names):
    base = tempfile.mkdtemp(prefix="aerocast-streams-")
    return [f"{base}/{n}" for n in names]


def test_alert_keys_come_out_once_over_restarts(spark):
    """The earliest row of the trigger that brings a key; repeats weeks later stay out; null keys are one key."""
    src, out = paths("src", "out")
    for rows in ([("a", 9, 200.0, 1), ("a", 5, 210.0, 2), ("b", 1, 10.0, 3), (None, 1, 300.0, None)],
                 [("a", 60000, 999.0, 4), ("b", 60001, 170.0, 5), (None, 2, 300.0, 7)], [("b", 90000, 180.0, 6)]):
        landed(spark, src, rows)
        ST.stream_alerts(ST.read_stream(spark, src, DDL), "v", 150, ["k"], out)
    got = sorted(spark.read.parquet(out).select("k", "v", "i").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([("a", 210.0, 2), ("b", 170.0, 5), (None, 300.0, None)], key=str)
    with pytest.raises(ValueError, match="is gone"):
        ST.stream_alerts(ST.read_stream(spark, src, DDL), "v", 150, ["k"], out, checkpoint=out + "-other")


def test_latest_table_merges_deltas(spark):
    """Deltas by trigger, merged on read and compacted by bytes; old folders go one generation late."""
    src, out, ckpt = paths("src", "out", "ckpt")
    rng, newest = np.random.default_rng(5), {}
    for batch in range(6):
        rows = [(f"k{rng.integers(0, 12)}", int(rng.integers(0, 5000)), float(batch), batch * 100 + j) for j in range(8)]
        landed(spark, src, rows)
        for k, m, v, i in rows:
            if k not in newest or m > newest[k][0]:
                newest[k] = (m, v, i)
        sdf = ST.stream_latest(ST.read_stream(spark, src, DDL), "k", "ts", ["v", "i"])
        ST.run_latest(spark, sdf, out, "k", "ts", checkpoint=ckpt)
        got = {r["k"]: r["ts"] for r in ST.read_latest(spark, out, "k", "ts").collect()}
        assert got == {k: START + timedelta(minutes=m) for k, (m, _, _) in newest.items()}
    folders = os.listdir(out)
    assert any(f.startswith("base=") for f in folders) and "batch=0" not in folders
    ST.compact_latest(spark, out, "k", "ts")
    ST.compact_latest(spark, out, "k", "ts")
    assert len(ST._live(spark, out)[1]) == 0 and ST.read_latest(spark, out, "k", "ts").count() == len(newest)


def test_ingest_lags_equal_batch_lags(spark):
    """Four triggers in the order of time, with nulls, NaN, ties and keys that pause: equal to the batch operator."""
    src, out, ckpt = paths("src", "out", "ckpt")
    rng = np.random.default_rng(8)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.integers(0, 4)}", j // 2, None if rng.random() < 0.3 else float(round(rng.random(), 3)), 2**60 + j) for j in range(160)]
    for a in range(0, 160, 40):
        landed(spark, src, rows[a:a + 40])
        ST.run_to_folder(ST.with_ingest_lags(ST.read_stream(spark, src, DDL), "v", "k", ["ts", "i"]), out, checkpoint=ckpt)
    got = spark.read.parquet(out).drop("batch")
    want = W.online_lags(spark.read.schema(DDL).parquet(src), "v", key="k", order=["ts", "i"]).select(*got.columns)
    key = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert got.count() == 160 and key(got) == key(want)


def test_repeats_within_and_beyond_the_delay(spark):
    """A repeat within the allowed lateness goes; rows older than the watermark are dropped; the key may come again after it."""
    src, out, ckpt = paths("src", "out", "ckpt")
    for rows in ([("a", 0, 1.0, 1), ("a", 1, 2.0, 2)], [("a", 30, 3.0, 3)], [("z", 1000, 4.0, 4)], [("a", 20, 5.0, 5)], [("a", 1001, 6.0, 6)]):
        landed(spark, src, rows)
        ST.run_to_folder(ST.stream_dedup(ST.read_stream(spark, src, DDL), ["k"], "ts", "2 hours"), out, checkpoint=ckpt)
    got = [r["i"] for r in spark.read.parquet(out).select("i").orderBy(F.col("i")).collect()]
    assert got[0] in (1, 2) and got[1:] == [4, 6]
