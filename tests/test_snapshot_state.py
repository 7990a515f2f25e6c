"""The snapshot from state against a full rebuild, day by day."""

import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocast.config import LINEITEM_SPEC as SPEC
from aerocast.plans import features as FE

DDL = "series_key string, ts timestamp, y double, x1 double, x2 double, x3 double, x4 double"
DAYS = 34


@pytest.fixture(scope="module")
def raw(spark):
    """Gaps in days, days without a target, a covariate that pauses for longer than the tail, a series that starts late."""
    rng = np.random.default_rng(12)
    rows = []
    for key, start, skip in (("a", 0, 0.0), ("b", 0, 0.25), ("late", 14, 0.0), ("short", 24, 0.0)):
        for day in range(start, DAYS):
            if rng.random() < skip:
                continue
            for hour in (3, 15):
                gap = lambda p: None if rng.random() < p else float(rng.normal())  # noqa: B023, E731
                x4 = None if 5 < day < 27 else gap(0.3)
                rows.append((key, datetime(2024, 1, 1) + timedelta(days=day, hours=hour), None if day % 11 == 7 else float(rng.normal(50, 9)), gap(0.4), gap(0.4), gap(0.1), x4))
    return spark.createDataFrame(rows, DDL).cache()


def rows_of(df):
    return {r["series_key"]: r.asDict() for r in df.collect()}


def test_state_equals_rebuild(spark, raw):
    cols = SPEC.feature_cols()
    days = F.datediff("ts", F.lit("2024-01-01"))
    folder = tempfile.mkdtemp(prefix="aerocast-state-")
    state, at = FE.snapshot_state(raw.where(days < 18), SPEC), 18
    for to in (19, 20, 24, 25, 26, 28, 29, DAYS):  # single days and several at once
        FE.advance_state(state, raw.where((days >= at) & (days < to)), SPEC).write.parquet(f"{folder}/{to}")
        state, at = spark.read.parquet(f"{folder}/{to}"), to
        got = rows_of(FE.state_snapshot(state, SPEC))
        want = rows_of(FE.online_snapshot(raw.where(days < to), raw.limit(0), SPEC))
        assert set(got) == set(want) and ("a" in got)
        for key in want:
            assert got[key]["date"] == want[key]["date"] and got[key]["y"] == pytest.approx(want[key]["y"])
            assert [got[key][c] for c in cols] == pytest.approx([want[key][c] for c in cols], abs=1e-9), (to, key)


def test_state_without_new_rows_and_late_days(spark, raw):
    """No readings leave the state as it is, as do readings of days that are closed; an empty history gives no row."""
    state = FE.snapshot_state(raw, SPEC)
    same = rows_of(FE.state_snapshot(state, SPEC))
    for new in (raw.limit(0), raw.where("ts < '2024-01-20'")):
        assert rows_of(FE.state_snapshot(FE.advance_state(state, new, SPEC), SPEC)) == same
    assert FE.snapshot_state(raw.limit(0), SPEC).count() == 0


def test_readings_are_not_dealt_by_series(spark):
    """Tagging readings with their series' newest day moves no readings: one series may hold a third of them."""
    from aerocast.catalog.models import _history_and_today
    rows = [("a", datetime(2024, 1, d), 1.0) for d in (1, 2, 3, 3)] + [("b", datetime(2024, 1, 1), 2.0), ("c", None, 1.0), (None, datetime(2024, 1, 9), 1.0)]
    raw = spark.createDataFrame(rows, "series_key string, ts timestamp, y double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as the estimate for a large table
    try:
        history, today = _history_and_today(raw)
        assert "SortMergeJoin" not in history._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.series_key, r.ts.day) for r in history.collect()) == [("a", 1), ("a", 2)]
        assert sorted((r.series_key, r.ts.day) for r in today.collect()) == [("a", 3), ("a", 3), ("b", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
