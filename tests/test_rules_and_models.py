"""Rules, folds, ridge, quantiles, joins and sinks: edge cases and properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerocast.functions import rules as R
from aerocast.operators import joins as J
from aerocast.plans import folds as FO
from aerocast.plans import ridge as RG
from aerocast.plans import tournament as TN
from aerocast.plans.quantiles import exact_quantiles


def test_band_edges_closed_on_the_right(spark):
    vals = [0.0, 50.0, 50.01, 100.0, 150.0, 200.0, 300.0, 300.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(R.aqi_band("v")).collect()]
    assert got == ["Good", "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy",
                   "Very Unhealthy", "Hazardous"]


def test_range_counts_closed_on_the_left(spark):
    from aerocast.operators.stats import range_counts
    df = spark.createDataFrame([(v,) for v in [19.99, 20.0, 40.0, 60.0, 80.0, 100.0]], "v double")
    r = range_counts(df, "v").collect()[0].asDict()
    assert list(r.values()) == [1, 1, 1, 1, 1, 1]


def test_half_up_rounding(spark):
    df = spark.createDataFrame([(2.25,), (0.35,)], "v double")
    assert [r[0] for r in df.select(F.round("v", 1)).collect()] == [2.3, 0.4]


def test_anchor_limits(spark):
    df = spark.createDataFrame([(10.0, 30.0), (-5.0, None)], "raw double, live double")
    r = df.select(R.anchor("raw", "live", 0.0).alias("a0"), R.anchor("raw", "live", 1.0).alias("a1")).collect()
    assert r[0]["a0"] == 10.0 and r[0]["a1"] == 30.0 and r[1]["a0"] == -5.0
    scored = TN.chain_score(df.withColumns({"d2": F.lit(1.0), "d3": F.lit(2.0)}), "raw", "d2", "d3")
    a = TN.anchor_clamp(scored, "live").orderBy("raw").collect()
    assert a[0]["pred_day1"] == 0.0  # negative raw with no live reading is clamped


def test_folds_partition_the_rows(spark):
    df = spark.range(0, 47).selectExpr("'s' AS series_key", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS date")
    got = FO.ts_folds(df, 5).toPandas().sort_values("date")
    ts = 47 // 6
    assert (got["block"] == 0).sum() == 47 - 5 * ts
    assert all((got["block"] == k).sum() == ts for k in range(1, 6))
    assert got["block"].is_monotonic_increasing


def test_folds_never_train_on_later_dates(spark):
    """Series of different spans share the dates' blocks: training ends before each test block begins."""
    rows = [("a", f"2020-01-{d:02d}") for d in range(1, 25)] + [("b", f"2020-01-{d:02d}") for d in range(10, 32)] + [("c", "2020-01-31")]
    df = spark.createDataFrame(rows, "series_key string, d string").selectExpr("series_key", "to_date(d) AS date")
    got = FO.ts_folds(df, 5).toPandas()
    assert sorted(got["block"].unique()) == list(range(6)) and len(got) == len(rows)
    for k in range(1, 6):
        assert got[got["block"] < k]["date"].max() < got[got["block"] == k]["date"].min()
    with pytest.raises(Exception, match="at least 6 dates"):
        FO.ts_folds(df.where("date < '2020-01-04'"), 5).collect()


def test_quantiles_ignore_nan_and_cut_at_least_once(spark):
    from aerocast.plans.quantiles import exact_quantiles
    df = spark.createDataFrame([(float(v),) for v in range(1, 202)] + [(float("nan"),), (None,)], "v double")
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0], max_candidates=10).collect()}
    assert got == {0.0: 1.0, 0.25: 51.0, 0.5: 101.0, 1.0: 201.0}


def test_daily_mean_ignores_nan(spark):
    from aerocast.operators.stats import daily_mean
    df = spark.createDataFrame([("s", "2024-01-01", 1.0), ("s", "2024-01-01", float("nan"))], "series_key string, ts string, y double")
    assert daily_mean(df, ["y"]).first()["y"] == 1.0


def test_align_schema_keeps_large_integers(spark):
    from aerocast.operators.schema import align_schema
    big = 2**53 + 1
    df = spark.createDataFrame([(big, str(big), "12.9", -3.9)], "a bigint, b string, c string, d double")
    assert tuple(align_schema(df, {c: "bigint" for c in "abcd"}).first()) == (big, big, 12, -3)
    assert align_schema(df, {"c": "decimal(10,2)"}).first()["c"] == __import__("decimal").Decimal("12.90")
    with pytest.raises(ValueError):
        align_schema(df, {"a": "mystery"})
    with pytest.raises(Exception, match="cannot align"):
        align_schema(spark.createDataFrame([("x",)], "a string"), {"a": "bigint"}).collect()


def test_history_keeps_text_keys_and_retries(spark, tmp_path):
    from aerocast.sources import files as IOF
    df = spark.createDataFrame([("007", 1.0)], "series_key string, value double")
    for _ in range(2):
        IOF.append_history(df, f"{tmp_path}/h", 1)
    IOF.append_history(df, f"{tmp_path}/h", 2)
    got = IOF.read_history(spark, f"{tmp_path}/h", "series_key string, value double")
    assert [r["series_key"] for r in got.collect()] == ["007", "007"]


def test_alert_log_grows_by_fresh_alerts_only(spark, tmp_path):
    from aerocast.sources import files as IOF
    path = f"{tmp_path}/log"

    def alerts(*days):
        return spark.createDataFrame([(f"{d} 01:00:00", d, 160.0, 150, "bad") for d in days],
                                     "logged_at string, forecast_date string, predicted_aqi double, threshold long, status string")
    for batch, days in ((1, ["2024-01-01", "2024-01-02"]), (2, ["2024-01-02", "2024-01-03"]), (2, ["2024-01-02", "2024-01-03"]), (3, ["2024-01-01"])):
        IOF.append_alerts(alerts(*days), path, batch)
    assert sorted(r["forecast_date"] for r in IOF.read_alert_log(spark, path).collect()) == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_shapley_with_a_background_larger_than_the_data(spark):
    from aerocast.plans.explain import sampled_shapley
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(10)], "id int, x double, z double")
    phi = sampled_shapley(df, ["id"], ["x", "z"], lambda d, n: d.withColumn(n, 2 * F.col("x") - F.col("z")), n_rows=10, n_background=50, n_samples=40).toPandas()
    assert len(phi) == 20
    x = phi[phi.feature == "x"].sort_values("id")
    assert all(2 * (i - 9) <= a <= 2 * i for i, a in zip(x.id, x.attribution)) and abs(x.attribution.mean()) < 3


def test_recency_weight_half_life(spark):
    df = spark.createDataFrame([("2024-03-16",), ("2024-01-01",)], "d string").selectExpr("to_date(d) AS date")
    w = {str(r["date"]): r["weight"] for r in FO.recency_weights(df, "date", 75.0).collect()}
    assert w["2024-03-16"] == 1.0 and w["2024-01-01"] == pytest.approx(0.5)


def test_ridge_matches_closed_form_weighted_standardised_fit(spark):
    rng = np.random.default_rng(0)
    n, p = 300, 4
    X = rng.normal(size=(n, p)) * [1, 10, 0.1, 5] + [3, -2, 0, 100]
    y = X @ [1.5, -0.2, 4.0, 0.05] + rng.normal(size=n)
    w = rng.uniform(0.2, 1.0, n)
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(p)]).assign(t=y, w=w, block=0)
    stats = RG.block_gramians(spark.createDataFrame(pdf), [f"f{i}" for i in range(p)], "t", "w")
    icpt, beta = RG.fit_ridge(stats, 3.0, p)
    mu, sd = X.mean(0), X.std(0)
    Z = (X - mu) / sd
    zb, yb = np.average(Z, axis=0, weights=w), np.average(y, weights=w)
    Zc, yc = Z - zb, y - yb
    bz = np.linalg.solve((Zc * w[:, None]).T @ Zc + 3.0 * np.eye(p), (Zc * w[:, None]).T @ yc)
    np.testing.assert_allclose(beta, bz / sd, rtol=1e-9)
    xw = np.average(X, axis=0, weights=w)
    np.testing.assert_allclose(icpt, yb - xw @ (bz / sd), rtol=1e-9)


def test_block_merge_equals_single_block(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "t"]).assign(w=rng.uniform(size=200))
    one = RG.block_gramians(spark.createDataFrame(pdf.assign(block=0)), ["a", "b"], "t", "w")
    many = RG.block_gramians(spark.createDataFrame(pdf.assign(block=np.arange(200) % 4)), ["a", "b"], "t", "w")
    m = RG.merged(many, [0, 1, 2, 3], 3)
    np.testing.assert_allclose(m.C, one[0].C, rtol=1e-10)
    np.testing.assert_allclose(m.m2, one[0].m2, rtol=1e-10)


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])  # a third is one value
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": vals}))
    got = {r["p"]: r["q"] for r in exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.9], ["g"], buckets=16).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(vals, p), abs=1e-12)
    # force refinement rounds: ranges larger than 300 rows are cut again
    probs = [0.0, 0.1, 0.333, 0.5, 0.77, 1.0]
    fine = {r["p"]: r["q"] for r in exact_quantiles(df, "v", probs, ["g"], buckets=8, max_candidates=300).collect()}
    for p in probs:
        assert fine[p] == pytest.approx(np.quantile(vals, p), abs=1e-12)


def test_join_asof_across_bucket_boundaries(spark):
    left = spark.createDataFrame([(1, "2024-01-03 10:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-05 00:00:00")],
                                 "k int, t string").selectExpr("k", "to_timestamp(t) AS t")
    right = spark.createDataFrame([(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-03 10:00:00", 7.0),
                                   (2, "2024-01-06 00:00:00", 9.0)], "k int, t string, v double") \
        .selectExpr("k", "to_timestamp(t) AS t", "v")
    got = {(r["k"], str(r["t"])): r["r_v"] for r in J.join_asof(left, right, "k", "t", "t", ["v"]).collect()}
    assert got[(1, "2024-01-01 00:00:01")] == 5.0  # previous bucket carried in
    assert got[(1, "2024-01-03 10:00:00")] == 7.0  # equal time counts
    assert got[(2, "2024-01-05 00:00:00")] is None  # nothing earlier


def test_join_loss_counts_unmatched_rows_without_multiplying(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (1,), (4,)], "k int")
    r = J.join_loss(a, b, "k").collect()[0]
    assert (r["left_unmatched"], r["right_unmatched"], r["left_rows"], r["right_rows"]) == (2, 1, 4, 4)


def test_upsert_is_idempotent(spark):
    from aerocast.session import scratch_path
    from aerocast.sources import feature_table as FT
    rows = spark.createDataFrame([("s", "2024-01-01", 0, 1.0, 1), ("s", "2024-01-01", 0, 2.0, 2),
                                  ("s", "2024-01-02", 3, 5.0, 1)],
                                 "series_key string, date string, hour int, aqi double, ingested_at int")
    path = scratch_path(spark, "test-upsert")
    FT.upsert_features(spark, rows, path)
    first = sorted(map(tuple, FT.read_features(spark, path).select("date", "hour", "aqi").collect()))
    FT.upsert_features(spark, rows, path)
    again = sorted(map(tuple, FT.read_features(spark, path).select("date", "hour", "aqi").collect()))
    import datetime
    assert first == again and len(first) == 2 and ((datetime.date(2024, 1, 1), 0, 2.0) in first)


def test_require_columns_fails_early(spark):
    from aerocast.operators.schema import align_schema, require_columns
    df = spark.createDataFrame([("1.5", "x")], "a string, b string")
    with pytest.raises(ValueError):
        require_columns(df, ["a", "missing"])
    out = align_schema(df, {"a": "bigint", "b": "double"}).collect()[0]
    assert out["a"] == 1 and out["b"] is None  # int truncates, float is lenient


def test_normalize_station_rejects(spark):
    from aerocast.sources.payloads import normalize_station
    rows = [("@A1 ", '{"status":"ok","data":{"aqi":"57","city":{"name":"X"},"iaqi":{"pm25":{"v":3}}}}'),
            ("A2", '{"status":"ok","data":{"aqi":"-"}}'),
            ("A3", '{"status":"error","data":"Unknown station"}'),
            ("A4", '{"status":"ok","data":"oops"}'),
            ("A5", '{"status":"ok","data":{"aqi":"n/a"}}'),
            ("A6", '{"status":"ok","data":{"aqi":42}}')]
    ok, rej = normalize_station(spark.createDataFrame(rows, "station_id string, payload string"))
    okd = {r["station_id"]: r for r in ok.collect()}
    assert set(okd) == {"A1", "A6"} and okd["A1"]["pm25"] == 3.0 and okd["A6"]["station_name"] == "Station A6"
    assert {r["station_id"]: r["reason"] for r in rej.collect()} == {
        "A2": "no_aqi", "A3": "status", "A4": "payload", "A5": "non_numeric"}


def test_bucketed_positions_equal_row_number(spark):
    from datetime import datetime, timedelta
    rng = np.random.default_rng(3)
    rows = [("hot" if rng.random() < 0.7 else "cold", datetime(2024, 1, 1) + timedelta(seconds=float(s)), i)
            for i, s in enumerate(rng.uniform(0, 20 * 86400, 500))]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long")
    a = J.positions(df, "k", ["ts", "i"], F.to_date("ts")).select("i", "pos").toPandas().sort_values("i")
    b = J.positions(df, "k", ["ts", "i"]).select("i", "pos").toPandas().sort_values("i")
    assert a["pos"].tolist() == b["pos"].tolist()


def test_sampled_shapley_is_exact_for_linear_models(spark):
    """With one background row z0, every permutation sample of a linear model
    gives b_j (x_j - z0_j), so the estimate must equal it exactly."""
    from aerocast.operators.setops import sample_seeded
    from aerocast.plans.explain import sampled_shapley
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=["a", "b", "c"]).assign(id=np.arange(300))
    df = spark.createDataFrame(pdf)
    coef = {"a": 2.0, "b": -1.0, "c": 0.5}

    def score(d, name):
        return d.withColumn(name, sum((F.col(c) * w for c, w in coef.items()), F.lit(1.0)))
    phi = sampled_shapley(df, ["id"], list(coef), score, n_rows=20, n_background=1, n_samples=8).toPandas()
    z0 = sample_seeded(df, ["id"], 1, 43).toPandas().iloc[0]
    x = pdf.set_index("id")
    assert len(phi) == 60
    for _, r in phi.iterrows():
        expect = coef[r["feature"]] * (x.loc[r["id"], r["feature"]] - z0[r["feature"]])
        assert r["attribution"] == pytest.approx(expect, abs=1e-9)
