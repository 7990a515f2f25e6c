"""Differential tests of the window operators against pandas formulas
(shift / rolling / ewm / interpolate) on random series with gaps, plus the
leakage property."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerocast.config import FeatureSpec
from aerocast.operators import windows as W
from aerocast.plans import features as FE


def _series(seed=0, n=60, null_frac=0.3):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2024-01-01", periods=n * 2, freq="D")
    days = np.sort(rng.choice(days, n, replace=False))  # gaps between days
    y = rng.normal(100, 20, n)
    x = rng.normal(10, 3, n)
    x[rng.random(n) < null_frac] = np.nan
    x[:2] = np.nan  # leading gap
    x[-1] = np.nan  # trailing gap
    return pd.DataFrame({"series_key": "s", "date": pd.to_datetime(days).date, "y": y, "x": x})


def _to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                 "series_key string, date date, y double, x double")


def _sorted(df):
    return df.toPandas().sort_values("date").reset_index(drop=True)


def test_lags_rolling_ema_match_pandas(spark):
    pdf = _series(1)
    sdf = _to_spark(spark, pdf)
    out = W.lags(sdf, "y", [1, 2, 7], key="series_key", order="date")
    out = W.rolling_mean(out, "y", [3, 7], key="series_key", order="date")
    out = W.rolling_std(out, "y", [3, 7], key="series_key", order="date")
    out = W.ema(out, "y", [3, 7], key="series_key", order="date")
    got = _sorted(out)
    ref = pdf.sort_values("date").reset_index(drop=True)
    lag1 = ref["y"].shift(1)
    for k in (1, 2, 7):
        np.testing.assert_allclose(got[f"y_lag_{k}"].astype(float), ref["y"].shift(k), rtol=0, atol=1e-12)
    for n in (3, 7):
        np.testing.assert_allclose(got[f"y_rolling_mean_{n}"].astype(float), lag1.rolling(n).mean(), atol=1e-9)
        np.testing.assert_allclose(got[f"y_rolling_std_{n}"].astype(float), lag1.rolling(n).std(), atol=1e-9)
    for s in (3, 7):
        np.testing.assert_allclose(got[f"y_ema_{s}"].astype(float), lag1.ewm(span=s, adjust=False).mean(),
                                   atol=1e-9)


def test_interp_time_matches_pandas(spark):
    pdf = _series(2)
    got = _sorted(W.interp_time(_to_spark(spark, pdf), ["x"], key="series_key", order="date"))
    ref = pdf.sort_values("date").set_index(pd.to_datetime(pdf.sort_values("date")["date"]))["x"]
    ref = ref.interpolate(method="time").ffill().bfill().reset_index(drop=True)
    np.testing.assert_allclose(got["x"].astype(float), ref, atol=1e-9)


def test_interp_all_null_column_stays_null(spark):
    pdf = _series(3)
    pdf["x"] = np.nan
    got = _sorted(W.interp_time(_to_spark(spark, pdf), ["x"], key="series_key", order="date"))
    assert got["x"].isna().all()


def test_ffill_bfill(spark):
    pdf = _series(4)
    got = _sorted(W.ffill_bfill(_to_spark(spark, pdf), ["x"], key="series_key", order="date"))
    ref = pdf.sort_values("date")["x"].ffill().bfill().reset_index(drop=True)
    np.testing.assert_allclose(got["x"].astype(float), ref, atol=0)


@pytest.mark.parametrize("lagged", [True, False])
def test_ema_is_the_whole_recursion(spark, lagged):
    """Against the plain recursion over several blocks, with nulls and a null start; a slow EMA (span 2000)
    would show any forgotten history."""
    rng = np.random.default_rng(3)
    n = 3 * W.EMA_BLOCK + 17
    y = [None if i < 3 or rng.random() < 0.1 else float(rng.normal(50, 20)) for i in range(n)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(y)] + [("t", i, None) for i in range(5)], "series_key string, i int, y double")
    got = W.ema(df, "y", (3, 2000), order="i", lagged=lagged).orderBy("series_key", "i").collect()
    for span in (3, 2000):
        a, e, want = 2.0 / (span + 1.0), None, []
        for v in y:
            before = e
            if v is not None:
                e = v if e is None else e * (1 - a) + v * a
            want.append(before if lagged else e)
        for r, w in zip(got, want):
            assert (r[f"y_ema_{span}"] is None) == (w is None) and (w is None or r[f"y_ema_{span}"] == pytest.approx(w, rel=1e-12))
    assert all(r["y_ema_3"] is None for r in got[n:])


def test_interpolation_within_a_day(spark):
    df = spark.createDataFrame([("s", "2024-01-01 00:00:00", 0.0), ("s", "2024-01-01 06:00:00", None), ("s", "2024-01-01 12:00:00", 12.0)],
                               "series_key string, t string, x double").withColumn("ts", F.to_timestamp("t"))
    assert [r["x"] for r in W.interp_time(df, ["x"], order="ts").orderBy("ts").collect()] == [0.0, 6.0, 12.0]
    with pytest.raises(ValueError):
        W.interp_time(df, ["x"], order="t")
    with pytest.raises(ValueError):
        W.live_or_latest(df, "x", order="t")


def test_no_leakage_features_do_not_see_the_future(spark):
    """Changing values after day t must not change any feature at t (except
    interpolated covariates, which by design look at later covariates)."""
    spec = FeatureSpec(target="y", fill_cols=("x",), lag_change_cols=("x",), delta_cols=("x",))
    pdf = _series(5, n=80, null_frac=0.0)
    pdf["ts"] = pd.to_datetime(pdf["date"])
    raw = spark.createDataFrame(pdf[["series_key", "ts", "y", "x"]])
    cut = sorted(pdf["date"])[59]
    pdf2 = pdf.copy()
    pdf2.loc[pdf2["date"] > cut, ["y", "x"]] *= 3.0
    raw2 = spark.createDataFrame(pdf2[["series_key", "ts", "y", "x"]])
    a = FE.build_features(raw, spec).toPandas().set_index("date").sort_index()
    b = FE.build_features(raw2, spec).toPandas().set_index("date").sort_index()
    a, b = a[a.index <= cut], b[b.index <= cut]
    pd.testing.assert_frame_equal(a, b)


def test_single_row_and_short_series(spark):
    spec = FeatureSpec(target="y", fill_cols=("x",), lag_change_cols=("x",), delta_cols=("x",))
    pdf = _series(6, n=10, null_frac=0.0)
    pdf["ts"] = pd.to_datetime(pdf["date"])
    raw = spark.createDataFrame(pdf[["series_key", "ts", "y", "x"]])
    assert FE.build_features(raw, spec).count() == 0  # needs 14 lags of warm-up
    one = raw.limit(1)
    assert FE.build_features(one, spec).count() == 0
    kept = FE.build_features(one, spec, drop_incomplete=False).collect()
    assert len(kept) == 1 and kept[0]["y_lag_1"] is None


def test_online_lags_zero_fallback_and_cascade(spark):
    rows = [("s", i, v) for i, v in enumerate([None, 10.0, None, 20.0, 30.0, 40.0])]
    df = spark.createDataFrame(rows, "series_key string, ts long, v double")
    a = W.online_lags(df, "v", order="ts").orderBy("ts").collect()
    assert [r["v_lag_1"] for r in a] == [0.0, 0.0, 10.0, 10.0, 20.0, 30.0]
    assert [r["v_lag_2"] for r in a] == [0.0, 0.0, 0.0, 0.0, 10.0, 20.0]
    assert a[5]["v_rolling_mean_3"] == pytest.approx(20.0)
    assert a[3]["v_rolling_mean_3"] == 10.0  # fewer than three -> lag 1
    c = W.online_lags_cascade(df, "v", order="ts").orderBy("ts").collect()
    assert c[2]["v_lag_2"] == 10.0 and c[2]["v_lag_3"] == 10.0  # lag2 -> lag1, lag3 -> lag2
    assert c[4]["v_rolling_mean_3"] == pytest.approx(15.0) and c[4]["v_trend"] == 10.0
    assert c[1]["v_trend"] == 0.0


def test_latest_row_and_dedup_hot_key(spark):
    """A key holding most rows still reduces through partial aggregation."""
    from aerocast.operators.setops import dedup_last
    df = spark.range(0, 20000).selectExpr("CASE WHEN id % 3 = 0 THEN 'cold' ELSE 'hot' END AS k", "id AS t",
                                          "id * 2 AS v")
    got = {r["k"]: r["v"] for r in dedup_last(df, ["k"], ["t"]).collect()}
    assert got == {"hot": 2 * 19999, "cold": 2 * 19998}
    lr = {r["k"]: r["t"] for r in W.latest_row(df, key="k", order="t").collect()}
    assert lr["hot"] == 19999


def test_calendar_weekday_monday_zero(spark):
    from aerocast.functions.calendar import calendar, dayname_codes
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",)], "d string").selectExpr("to_date(d) AS date")
    got = calendar(df).orderBy("date").collect()
    assert [r["day_of_week"] for r in got] == [0, 6] and [r["is_weekend"] for r in got] == [0, 1]
    codes = dayname_codes(df).orderBy("date").collect()
    assert [r["day_name_code"] for r in codes] == [1, 3]  # Monday=1, Sunday=3 alphabetically
    assert math.isclose(1.0, 1.0)


def test_bucketed_history_equals_single_window(spark):
    """Per-(key, day) windows with carried-in state must equal one window per
    key, including days without any observation and keys with few rows."""
    rng = np.random.default_rng(7)
    n = 400
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.uniform(0, 60 * 86400, n)), unit="s")
    v = rng.normal(50, 10, n)
    v[rng.random(n) < 0.6] = np.nan  # many gaps, some days without any observation
    keys = np.where(rng.random(n) < 0.8, "hot", "cold")
    pdf = pd.DataFrame({"k": keys, "ts": ts, "i": np.arange(n), "v": v})
    rows = [(k, t.to_pydatetime(), int(i), None if np.isnan(x) else float(x))
            for k, t, i, x in zip(pdf["k"], pdf["ts"], pdf["i"], pdf["v"])]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long, v double")
    for fn, cols in ((W.online_lags, ["v_lag_1", "v_lag_2", "v_lag_3", "v_rolling_mean_3", "v_change"]),
                     (W.online_lags_cascade, ["v_lag_1", "v_lag_2", "v_lag_3", "v_rolling_mean_3", "v_trend"])):
        a = fn(df, "v", key="k", order=["ts", "i"]).select("i", *cols).toPandas().sort_values("i")
        b = fn(df, "v", key="k", order=["ts", "i"], bucket_seconds=None).select("i", *cols).toPandas().sort_values("i")
        pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))
    a = W.live_or_latest(df, "v", key="k", order=["ts", "i"]).select("i", "v_or_latest").toPandas().sort_values("i")
    b = W.live_or_latest(df, "v", key="k", order=["ts", "i"], bucket_seconds=None).select("i", "v_or_latest") \
        .toPandas().sort_values("i")
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))
    ref = pdf.sort_values(["k", "ts"]).groupby("k")["v"].ffill()
    got = a.set_index("i")["v_or_latest"].reindex(pdf.sort_values(["k", "ts"])["i"]).to_numpy()
    np.testing.assert_allclose(got.astype(float), ref.to_numpy(dtype=float))
