"""Registered queries for the forecasting operators.

Value-checked queries use models whose fit is itself SQL-expressible (AR(1)
regressions via ``regr_slope``/``regr_intercept``, a one-feature closed-form
weighted ridge, persistence baselines), so DuckDB can recompute the whole
chain. The full tournament (forests, boosted trees, 37-feature ridge) is
registered too, with a rows-only check.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerocast import bindings as B
from aerocast.catalog.registry import register, rounded
from aerocast.catalog.series import DAILY_SQL, _daily, features_sql
from aerocast.config import ANCHOR_STRENGTHS, LINEITEM_SPEC, TOURNAMENT_SPEC, FeatureSpec, ForecastSpec
from aerocast.operators import stats as S
from aerocast.operators import windows as W
from aerocast.plans import features as FE
from aerocast.plans import folds as FO
from aerocast.plans import ridge as RG
from aerocast.plans import tournament as TN

_DAILY_ONLY = "WITH " + DAILY_SQL + " "
_P = "PARTITION BY series_key ORDER BY date"
_LN2 = f"CAST({math.log(2)!r} AS DOUBLE)"


def _dsel(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ----------------------------------------------------------------- M1 / A20
_W_SQL = f"""wt AS (SELECT *, exp(-{_LN2} * CAST(date_diff('day', date, (SELECT max(date) FROM daily)) AS DOUBLE) / 75.0) AS weight
FROM daily)"""


@register("recency_weights", _DAILY_ONLY + ", " + _W_SQL + """
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, round(weight, 6) AS weight FROM wt""")
def q_recency_weights(spark, sf):
    d = FO.recency_weights(_daily(spark, sf).select("series_key", "date"), "date", 75.0)
    return rounded(d)


@register("weight_summary", _DAILY_ONLY + ", " + _W_SQL + """
SELECT round(min(weight), 6) AS min_w, round(max(weight), 6) AS max_w, round(avg(weight), 6) AS mean_w FROM wt""")
def q_weight_summary(spark, sf):
    d = FO.recency_weights(_daily(spark, sf).select("series_key", "date"), "date", 75.0)
    return rounded(S.weight_summary(d, "weight"))


# ----------------------------------------------------------------- M2 / M3 / M4 / M20
@register("horizon_targets", _DAILY_ONLY + f"""SELECT series_key, strftime(date, '%Y-%m-%d') AS date,
  round(lead(y, 2) OVER ({_P}), 6) AS true_level, round(lead(y, 1) OVER ({_P}), 6) AS prev_actual,
  round(lead(y, 2) OVER ({_P}) - lead(y, 1) OVER ({_P}), 6) AS target FROM daily""")
def q_horizon_targets(spark, sf):
    d = FO.horizon_targets(_daily(spark, sf).select("series_key", "date", "y"), "y", 2)
    return rounded(d.select("series_key", "date", "true_level", "prev_actual", "target"))


_FOLDS_SQL = f"""fo AS (SELECT *, CASE WHEN n // 6 = 0 OR rn < n - (n // 6) * 5 THEN 0
  ELSE (rn - (n - (n // 6) * 5)) // (n // 6) + 1 END AS block FROM (
  SELECT *, dense_rank() OVER (ORDER BY date) - 1 AS rn, (SELECT count(DISTINCT date) FROM daily) AS n FROM daily))"""


@register("ts_folds", _DAILY_ONLY + ", " + _FOLDS_SQL + """
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, CAST(block AS BIGINT) AS block FROM fo""")
def q_ts_folds(spark, sf):
    d = FO.ts_folds(_daily(spark, sf).select("series_key", "date"), 5)
    return rounded(d)


@register("scale_features", _DAILY_ONLY + ", " + _FOLDS_SQL + """,
st AS (SELECT avg(x1) m1, stddev_pop(x1) s1, avg(x2) m2, stddev_pop(x2) s2, avg(x3) m3, stddev_pop(x3) s3 FROM fo WHERE block < 5)
SELECT series_key, strftime(date, '%Y-%m-%d') AS date,
  round((x1 - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1.0 END, 6) AS x1,
  round((x2 - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1.0 END, 6) AS x2,
  round((x3 - m3) / CASE WHEN s3 > 0 THEN s3 ELSE 1.0 END, 6) AS x3
FROM fo, st""")
def q_scale_features(spark, sf):
    d = FO.ts_folds(_daily(spark, sf).select("series_key", "date", "x1", "x2", "x3"), 5)
    out = FO.scale_features(d.where(F.col("block") < 5), d, ["x1", "x2", "x3"])
    return rounded(out.select("series_key", "date", "x1", "x2", "x3"))


@register("target_scale", _DAILY_ONLY + """, st AS (SELECT avg(y) AS m, CASE WHEN stddev_samp(y) > 1e-6 THEN stddev_samp(y) ELSE 1.0 END AS s FROM daily)
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, round((y - m) / s, 6) AS target_scaled,
  round(((y - m) / s) * s + m, 6) AS target_restored FROM daily, st""")
def q_target_scale(spark, sf):
    d = FO.target_scale(_daily(spark, sf).select("series_key", "date", "y"), "y")
    d = FO.invert_target_scale(d, "target_scaled")
    return rounded(d.select("series_key", "date", "target_scaled", "target_restored"))


# ----------------------------------------------------------------- A23 / M5
_GRAM_COLS = ["x1", "x2"]
_GRAM_T = "x3"


def _gram_frame(spark, sf):
    d = _daily(spark, sf).select("series_key", "date", "x1", "x2", "x3")
    d = FO.recency_weights(d, "date", 75.0)
    return FO.ts_folds(d, 5)


@register("gramian", _DAILY_ONLY + ", " + _W_SQL.replace("FROM daily)", "FROM daily)") + ", " + _FOLDS_SQL.replace(
    "AS n FROM daily))", "AS n FROM wt))") + """,
m AS (SELECT block, sum(weight * x1) / sum(weight) AS m_x1, sum(weight * x2) / sum(weight) AS m_x2,
  sum(weight * x3) / sum(weight) AS m_x3 FROM fo GROUP BY block),
c AS (SELECT f.block, f.weight, f.x1 - m.m_x1 AS x1, f.x2 - m.m_x2 AS x2, f.x3 - m.m_x3 AS x3 FROM fo f JOIN m USING (block)),
g AS (SELECT block, """ + ", ".join(
    f"sum(weight * {a} * {b}) AS {a}__{b}" for a in [*_GRAM_COLS, _GRAM_T] for b in [*_GRAM_COLS, _GRAM_T]) + """
  FROM c GROUP BY block)
SELECT CAST(block AS BIGINT) AS block, split_part(k, '__', 1) AS a, split_part(k, '__', 2) AS b, round(v, 6) AS value
FROM g UNPIVOT (v FOR k IN (""" + ", ".join(
    f"{a}__{b}" for a in [*_GRAM_COLS, _GRAM_T] for b in [*_GRAM_COLS, _GRAM_T]) + "))")
def q_gramian(spark, sf):
    return rounded(RG.gramian_table(_gram_frame(spark, sf), _GRAM_COLS, _GRAM_T, "weight"))


_RIDGE_ALPHA = 10.0


@register("ridge_1f", _DAILY_ONLY + f""", lg AS (SELECT *, lag(y, 1) OVER ({_P}) AS x FROM daily),
{_W_SQL.replace("FROM daily)", "FROM lg WHERE x IS NOT NULL)").replace("(SELECT max(date) FROM daily)", "(SELECT max(date) FROM lg WHERE x IS NOT NULL)")},
s AS (SELECT sum(weight) AS sw, sum(weight * x) / sum(weight) AS xb, sum(weight * y) / sum(weight) AS yb,
  stddev_pop(x) AS sd FROM wt),
c AS (SELECT sum(weight * (x - xb) * (x - xb)) AS cxx, sum(weight * (x - xb) * (y - yb)) AS cxy, any_value(xb) AS xb,
  any_value(yb) AS yb, any_value(sd) AS sd FROM wt, s),
b AS (SELECT ((cxy / sd) / (cxx / (sd * sd) + {_RIDGE_ALPHA})) / sd AS beta, xb, yb FROM c)
SELECT {_RIDGE_ALPHA} AS alpha, round(yb - xb * beta, 6) AS intercept, round(beta, 6) AS coef FROM b""")
def q_ridge_1f(spark, sf):
    d = W.lags(_daily(spark, sf).select("series_key", "date", "y"), "y", [1]).withColumnRenamed("y_lag_1", "x")
    d = d.where(F.col("x").isNotNull())
    d = FO.recency_weights(d, "date", 75.0).withColumn("block", F.lit(0))
    stats = RG.block_gramians(d, ["x"], "y", "weight")
    icpt, beta = RG.fit_ridge(stats, _RIDGE_ALPHA, 1)
    return spark.createDataFrame([(_RIDGE_ALPHA, round(float(icpt), 6), round(float(beta[0]), 6))],
                                 "alpha double, intercept double, coef double")


# ----------------------------------------------------------------- M5 grid / M8 / M10 (rows-only)
def _feats(spark, sf):
    return FE.build_features(B.readings(spark, sf), LINEITEM_SPEC)


@register("ridge")
def q_ridge(spark, sf):
    """Ridge candidate for horizon 1: alpha grid by mean fold MAE, pooled OOF metrics."""
    spec = ForecastSpec()
    # the features are read twice (newest date, rows): cut their lineage first
    df = TN.horizon_frame(_feats(spark, sf).checkpoint(eager=True), spec, 1, None).cache()
    r = TN.run_ridge(df, spec, False)
    df.unpersist()
    return spark.createDataFrame([("day1", r.name, r.params["alpha"], r.mae, r.rmse, r.r2)],
                                 "horizon string, candidate string, alpha double, mae double, rmse double, r2 double")


@dataclass(frozen=True)
class _TwoFeatures(FeatureSpec):
    """The daily frame itself as features, so that a ridge has a closed form in SQL."""

    def feature_cols(self) -> list[str]:
        return ["x1", "x2"]


_SPEC_2F = ForecastSpec(features=_TwoFeatures(target="y", fill_cols=("x1", "x2")))
_RIDGE_SQL = _DAILY_ONLY + ", " + _W_SQL + ", " + _FOLDS_SQL.replace("AS n FROM daily))", "AS n FROM wt))") + f""",
ks AS (SELECT unnest(range(1, 6)) AS k), al AS (SELECT unnest({[float(a) for a in _SPEC_2F.alphas]}) AS alpha, unnest(range({len(_SPEC_2F.alphas)})) AS ai),
tr AS (SELECT k, sum(weight * x1) / sum(weight) AS m1, sum(weight * x2) / sum(weight) AS m2, sum(weight * y) / sum(weight) AS my,
  stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM fo JOIN ks ON block < k GROUP BY k),
c AS (SELECT tr.k, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my, any_value(s1) AS s1, any_value(s2) AS s2,
  sum(weight * (x1 - m1) * (x1 - m1)) / any_value(s1 * s1) AS a11, sum(weight * (x2 - m2) * (x2 - m2)) / any_value(s2 * s2) AS a22,
  sum(weight * (x1 - m1) * (x2 - m2)) / any_value(s1 * s2) AS a12, sum(weight * (x1 - m1) * (y - my)) / any_value(s1) AS b1,
  sum(weight * (x2 - m2) * (y - my)) / any_value(s2) AS b2 FROM fo JOIN tr ON block < tr.k GROUP BY tr.k),
z AS (SELECT *, (b1 * (a22 + alpha) - a12 * b2) / ((a11 + alpha) * (a22 + alpha) - a12 * a12) / s1 AS w1,
  ((a11 + alpha) * b2 - a12 * b1) / ((a11 + alpha) * (a22 + alpha) - a12 * a12) / s2 AS w2 FROM c, al),
p AS (SELECT fo.series_key, fo.date, fo.y, k, ai, alpha, my + (x1 - m1) * w1 + (x2 - m2) * w2 AS level FROM fo JOIN z ON fo.block = z.k),
best AS (SELECT ai FROM (SELECT ai, k, avg(abs(level - y)) AS m FROM p GROUP BY ai, k) GROUP BY ai ORDER BY avg(m), ai LIMIT 1),
o AS (SELECT * FROM p WHERE ai = (SELECT ai FROM best))"""


def _ridge_2f(spark, sf):
    d = _daily(spark, sf).select("series_key", "date", "y", "x1", "x2")
    d = d.withColumns({"target": F.col("y"), "true_level": F.col("y"), "base_pred": F.lit(0.0)})
    d = FO.ts_folds(FO.recency_weights(d, "date", 75.0, "weight"), 5).cache()
    r = TN.run_ridge(d, _SPEC_2F, False)
    d.unpersist()
    return r


@register("ridge_grid", _RIDGE_SQL + """
SELECT any_value(alpha) AS alpha, round(avg(abs(level - y)), 3) AS mae, round(sqrt(avg((level - y) * (level - y))), 3) AS rmse,
  round(1 - avg((level - y) * (level - y)) / var_pop(y), 6) AS r2 FROM o""")
def q_ridge_grid(spark, sf):
    """The ridge candidate itself (alpha grid, folds, pooled metrics) on two features."""
    r = _ridge_2f(spark, sf)
    return rounded(spark.createDataFrame([(float(r.params["alpha"]), round(r.mae, 3), round(r.rmse, 3), r.r2)], "alpha double, mae double, rmse double, r2 double"))


@register("ridge_oof", _RIDGE_SQL + """
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, round(level, 3) AS oof_level FROM o""")
def q_ridge_oof(spark, sf):
    """Its out-of-fold levels, row by row."""
    return rounded(_ridge_2f(spark, sf).oof.select("series_key", "date", F.round("oof_level", 3).alias("oof_level")))


@register("oof_predict")
def q_oof_predict(spark, sf):
    """Out-of-fold predictions of the ridge candidate (first block NULL-free: absent)."""
    spec = ForecastSpec()
    # the features are read twice (newest date, rows): cut their lineage first
    df = TN.horizon_frame(_feats(spark, sf).checkpoint(eager=True), spec, 1, None).cache()
    r = TN.run_ridge(df, spec, False)
    oof = r.oof.select("series_key", "date", "oof_level")
    df.unpersist()
    return rounded(oof)


@register("tournament")
def q_tournament(spark, sf):
    return spark.read.parquet(f"{champion_store(spark, sf)}/comparison")


# ----------------------------------------------------------------- M9 reconstruct (persistence base + momentum delta)
@register("reconstruct", _DAILY_ONLY + f""", r AS (SELECT series_key, date, y AS base_pred,
  y - lag(y, 1) OVER ({_P}) AS delta_pred, lead(y, 2) OVER ({_P}) AS true_level FROM daily),
e AS (SELECT series_key, true_level, base_pred + delta_pred AS level FROM r
  WHERE base_pred IS NOT NULL AND delta_pred IS NOT NULL AND true_level IS NOT NULL)
SELECT series_key, count(*) AS n, round(avg(abs(true_level - level)), 6) AS mae,
  round(sqrt(avg((true_level - level) * (true_level - level))), 6) AS rmse,
  round(1 - avg((true_level - level) * (true_level - level)) / var_pop(true_level), 6) AS r2 FROM e GROUP BY series_key""")
def q_reconstruct(spark, sf):
    d = _daily(spark, sf).select("series_key", "date", "y")
    d = W.diff(d, "y", name="pred").withColumn("base_pred", F.col("y"))
    d = TN.reconstruct(FO.horizon_targets(d, "y", 2), True)
    return rounded(S.regression_metrics(d, "true_level", "oof_level", ["series_key"]))


# ----------------------------------------------------------------- M12 / M13 / M14 / M15 / M17 (AR(1) models)
_AR_SQL = f"""ar AS (SELECT series_key, date, y, lead(y, 1) OVER ({_P}) AS l1, lead(y, 2) OVER ({_P}) AS l2,
  lead(y, 3) OVER ({_P}) AS l3 FROM daily),
m AS (SELECT series_key, regr_intercept(l1, y) AS a1, regr_slope(l1, y) AS b1,
  regr_intercept(l2 - l1, y) AS a2, regr_slope(l2 - l1, y) AS b2,
  regr_intercept(l3 - l2, y) AS a3, regr_slope(l3 - l2, y) AS b3 FROM ar GROUP BY series_key),
lt AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY date DESC) = 1),
sc AS (SELECT lt.series_key, lt.date, lt.y AS live, m.a1 + m.b1 * lt.y AS raw_day1,
  m.a1 + m.b1 * lt.y + (m.a2 + m.b2 * lt.y) AS raw_day2,
  m.a1 + m.b1 * lt.y + (m.a2 + m.b2 * lt.y) + (m.a3 + m.b3 * lt.y) AS raw_day3 FROM lt JOIN m USING (series_key)),
an AS (SELECT *, greatest(0.0, raw_day1 * CAST({1 - ANCHOR_STRENGTHS['day1']!r} AS DOUBLE) + live * CAST({ANCHOR_STRENGTHS['day1']!r} AS DOUBLE)) AS pred_day1,
  greatest(0.0, raw_day2 * CAST({1 - ANCHOR_STRENGTHS['day2']!r} AS DOUBLE) + live * CAST({ANCHOR_STRENGTHS['day2']!r} AS DOUBLE)) AS pred_day2,
  greatest(0.0, raw_day3 * CAST({1 - ANCHOR_STRENGTHS['day3']!r} AS DOUBLE) + live * CAST({ANCHOR_STRENGTHS['day3']!r} AS DOUBLE)) AS pred_day3 FROM sc)"""


def ar_models(daily, x="y"):
    """Per-series regressions of the next levels on ``x`` for the three horizons (aggregates only)."""
    w = Window.partitionBy("series_key").orderBy("date")
    ar = daily.withColumns({f"l{h}": F.lead("y", h).over(w) for h in (1, 2, 3)})
    steps = (F.col("l1"), F.col("l2") - F.col("l1"), F.col("l3") - F.col("l2"))
    fits = [f(step, F.col(x)).alias(f"{n}{h}") for h, step in enumerate(steps, 1)
            for f, n in ((F.regr_intercept, "a"), (F.regr_slope, "b"))]
    return ar.groupBy("series_key").agg(*fits)


def _ar_scored(daily, latest, x="y"):
    j = latest.join(ar_models(daily, x), "series_key")
    j = j.withColumns({"live": F.col("y"), **{n: F.col(f"a{h}") + F.col(f"b{h}") * F.col(x) for n, h in (("raw1", 1), ("d2", 2), ("d3", 3))}})
    return TN.chain_score(j, "raw1", "d2", "d3")


def _ar_latest(spark, sf):
    daily = _daily(spark, sf).select("series_key", "date", "y")
    return _ar_scored(daily, W.latest_row(daily))


@register("chain_score", _DAILY_ONLY + ", " + _AR_SQL + """
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, round(raw_day1, 6) AS raw_day1, round(raw_day2, 6) AS raw_day2,
  round(raw_day3, 6) AS raw_day3 FROM sc""")
def q_chain_score(spark, sf):
    return rounded(_ar_latest(spark, sf).select("series_key", "date", "raw_day1", "raw_day2", "raw_day3"))


@register("anchor_clamp", _DAILY_ONLY + ", " + _AR_SQL + """
SELECT series_key, round(pred_day1, 6) AS pred_day1, round(pred_day2, 6) AS pred_day2, round(pred_day3, 6) AS pred_day3,
  round((pred_day1 + pred_day2 + pred_day3) / 3.0, 6) AS average_pred FROM an""")
def q_anchor_clamp(spark, sf):
    a = TN.anchor_clamp(_ar_latest(spark, sf), "live")
    return rounded(a.select("series_key", "pred_day1", "pred_day2", "pred_day3", "average_pred"))


# forecasts made three days before the last one, so that the covariates of the forecast days are known
_EARLIER_SQL = _AR_SQL.replace("QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY date DESC) = 1)",
                               "QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY date DESC) = 4)")


@register("forecast_rows", _DAILY_ONLY + ", " + _EARLIER_SQL + """
SELECT f.series_key, horizon, strftime(forecast_date, '%Y-%m-%d') AS forecast_date, round(predicted, 6) AS predicted,
  'ar1' AS model_used, round(d.x1, 6) AS x1, round(d.x2, 6) AS x2, round(d.x3, 6) AS x3, round(d.x4, 6) AS x4 FROM (
  SELECT series_key, date + 1 AS forecast_date, 'day1' AS horizon, pred_day1 AS predicted FROM an UNION ALL
  SELECT series_key, date + 2, 'day2', pred_day2 FROM an UNION ALL
  SELECT series_key, date + 3, 'day3', pred_day3 FROM an) f
LEFT JOIN daily d ON d.series_key = f.series_key AND d.date = f.forecast_date""")
def q_forecast_rows(spark, sf):
    daily = _daily(spark, sf)
    levels = daily.select("series_key", "date", "y")
    w = Window.partitionBy("series_key").orderBy(F.desc("date"))
    earlier = levels.withColumn("_r", F.row_number().over(w)).where("_r = 4").drop("_r")
    a = TN.anchor_clamp(_ar_scored(levels, earlier), "live")
    rows = TN.forecast_rows(a, "series_key", "date", {"day1": "ar1", "day2": "ar1", "day3": "ar1"},
                            covariates=daily, covariate_cols=("x1", "x2", "x3", "x4"))
    return rounded(rows)


# a scenario overrides a covariate (the mean of its last seven days) and keeps the level
_SCEN_SQL = """ov AS (SELECT series_key, avg(x1) AS x1 FROM (SELECT series_key, x1 FROM daily
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY date DESC) <= 7) GROUP BY series_key)"""
_SCEN_AR_SQL = _AR_SQL
for _h in (1, 2, 3):
    _SCEN_AR_SQL = _SCEN_AR_SQL.replace(f"m.b{_h} * lt.y", f"m.b{_h} * lt.x1")
_SCEN_AR_SQL = (_SCEN_AR_SQL.replace("SELECT series_key, date, y, lead(y, 1)", "SELECT series_key, date, y, x1, lead(y, 1)")
                .replace("(l1, y)", "(l1, x1)").replace("(l2 - l1, y)", "(l2 - l1, x1)").replace("(l3 - l2, y)", "(l3 - l2, x1)")
                .replace("lt AS (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY date DESC) = 1)",
                         "lt AS (SELECT d.series_key, d.date, d.y, coalesce(ov.x1, d.x1) AS x1 FROM daily d LEFT JOIN ov USING (series_key) "
                         "QUALIFY row_number() OVER (PARTITION BY d.series_key ORDER BY d.date DESC) = 1)"))


@register("scenario_score", _DAILY_ONLY + ", " + _SCEN_SQL + ", " + _SCEN_AR_SQL + """
SELECT series_key, round(pred_day1, 6) AS pred_day1, round(pred_day2, 6) AS pred_day2, round(pred_day3, 6) AS pred_day3 FROM an""")
def q_scenario_score(spark, sf):
    daily = _daily(spark, sf).select("series_key", "date", "y", "x1")
    w = Window.partitionBy("series_key").orderBy(F.desc("date"))
    last7 = daily.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 7)
    ov = last7.groupBy("series_key").agg(F.avg("x1").alias("x1"))
    latest = TN.scenario_inputs(W.latest_row(daily), ov, "series_key", ["x1"])
    a = TN.anchor_clamp(_ar_scored(daily, latest, "x1"), "live")
    return rounded(a.select("series_key", "pred_day1", "pred_day2", "pred_day3"))


@register("linear_attribution", _DAILY_ONLY + ", " + _AR_SQL + """, mu AS (SELECT series_key, avg(y) AS my FROM daily GROUP BY series_key)
SELECT d.series_key, strftime(d.date, '%Y-%m-%d') AS date, 'y' AS feature, round(m.b1 * (d.y - mu.my), 6) AS attribution
FROM daily d JOIN m USING (series_key) JOIN mu USING (series_key)""")
def q_linear_attribution(spark, sf):
    daily = _daily(spark, sf).select("series_key", "date", "y")
    m = ar_models(daily).select("series_key", "b1")
    mu = daily.groupBy("series_key").agg(F.avg("y").alias("_my"))
    j = daily.join(m, "series_key").join(mu, "series_key")
    return rounded(TN.linear_attribution(j, {"y": F.col("b1")}, {"y": F.col("_my")}, ["series_key", "date"]))


@register("attribution_rank", _DAILY_ONLY + ", " + _AR_SQL + """, mu AS (SELECT series_key, avg(y) AS my FROM daily GROUP BY series_key),
atr AS (SELECT d.series_key AS feature, m.b1 * (d.y - mu.my) AS attribution FROM daily d JOIN m USING (series_key) JOIN mu USING (series_key))
SELECT feature, round(avg(abs(attribution)), 6) AS mean_abs FROM atr GROUP BY feature ORDER BY mean_abs DESC""")
def q_attribution_rank(spark, sf):
    daily = _daily(spark, sf).select("series_key", "date", "y")
    m = ar_models(daily).select("series_key", "b1")
    mu = daily.groupBy("series_key").agg(F.avg("y").alias("_my"))
    j = daily.join(m, "series_key").join(mu, "series_key")
    at = TN.linear_attribution(j, {"y": F.col("b1")}, {"y": F.col("_my")}, ["series_key"])
    return rounded(S.attribution_rank(at.select(F.col("series_key").alias("feature"), "attribution")))


# ----------------------------------------------------------------- M16
@register("holdout_split", f"""SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN substring(md5(l_orderkey || '|' || l_linenumber || '|42'), 1, 8) < '{int(0.2 * 16**8):08x}' THEN 'test' ELSE 'train' END AS split
FROM lineitem""")
def q_holdout_split(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return FO.holdout_split(li, ["l_orderkey", "l_linenumber"], 0.2, 42)


# ----------------------------------------------------------------- W18 online snapshot
_SNAPSHOT_SQL = features_sql(final_select=(
    "SELECT series_key, strftime(date, '%Y-%m-%d') AS date, " + ", ".join(
        f"round({c}, 6) AS {c}" if c not in ("month", "day", "day_of_week", "is_weekend") else f"CAST({c} AS BIGINT) AS {c}"
        for c in ["y", *LINEITEM_SPEC.feature_cols()])
    + " FROM clean QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY date DESC) = 1"))


def _history_and_today(raw):
    """The readings before each series' newest day, and those of that day. The days go to every task (a row a series):
    readings dealt by series would put a third of them in one task."""
    last_day = raw.groupBy("series_key").agg(F.max(F.to_date("ts")).alias("_last"))
    tagged = raw.join(F.broadcast(last_day), "series_key")
    day = F.to_date("ts")
    return tagged.where(day < F.col("_last")).drop("_last"), tagged.where(day == F.col("_last")).drop("_last")


@register("online_snapshot", _SNAPSHOT_SQL)
def q_online_snapshot(spark, sf):
    history, today = _history_and_today(B.readings(spark, sf))
    today = today.select(*reversed(today.columns))  # appended by name, not by position
    snap = FE.online_snapshot(history, today, LINEITEM_SPEC)
    return rounded(snap.select("series_key", "date", "y", *LINEITEM_SPEC.feature_cols()))


@register("online_snapshot_state", _SNAPSHOT_SQL)
def q_online_snapshot_state(spark, sf):
    """The same from a stored state of every series, folded forward by the newest day."""
    from aerocast.session import scratch_path
    history, today = _history_and_today(B.readings(spark, sf))
    path = scratch_path(spark, "snapshot-state")
    FE.snapshot_state(history, LINEITEM_SPEC).write.parquet(path)
    state = FE.advance_state(spark.read.parquet(path), today, LINEITEM_SPEC)
    return rounded(FE.state_snapshot(state, LINEITEM_SPEC).select("series_key", "date", "y", *LINEITEM_SPEC.feature_cols()))


# ----------------------------------------------------------------- M6 / M7 (rows-only)
def _candidate(spark, sf, name):
    spec = ForecastSpec()
    df = TN.horizon_frame(_feats(spark, sf).checkpoint(eager=True), spec, 1, None).cache()
    r = TN.RUNNERS[name](df, spec, False)
    df.unpersist()
    return spark.createDataFrame([("day1", r.name, r.mae, r.rmse, r.r2)],
                                 "horizon string, candidate string, mae double, rmse double, r2 double")


@register("random_forest")
def q_random_forest(spark, sf):
    return _candidate(spark, sf, "RandomForest")


@register("boosted_trees")
def q_boosted_trees(spark, sf):
    return _candidate(spark, sf, "boosted_trees")


# ----------------------------------------------------------------- end-to-end serving (rows-only)
def serve(feats, spec: ForecastSpec, champions: dict, deltas: dict):
    """Stored champions -> newest feature row per series -> raw outputs -> chained levels -> anchored to the live (latest)
    level, clamped -> three forecast rows per series. Nothing is trained."""
    fs = spec.features
    scored = W.latest_row(feats.select(fs.key, fs.date, fs.target, *fs.feature_cols()), key=fs.key, order=fs.date)
    for i, (hname, _) in enumerate(spec.horizons, start=1):
        scored = TN.raw_prediction(champions[hname], scored, fs.feature_cols(), f"_raw{i}")
    scored = TN.chain_score(scored, "_raw1", "_raw2", "_raw3", deltas["day2"], deltas["day3"])
    anchored = TN.anchor_clamp(scored.withColumn("live", F.col(fs.target)), "live")
    models = {h: champions[h].name for h, _ in spec.horizons}
    return TN.forecast_rows(anchored, fs.key, fs.date, models)


#: Stored champions by session and table folder: training is the tournament's work, serving reads what it left.
_STORES: dict = {}


def champion_store(spark, sf) -> str:
    """The folder of the champions trained on these tables; the first call of a session trains and stores them."""
    from aerocast.session import scratch_path
    from aerocast.sources.models_io import save_champions
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        result = TN.run_tournament(_feats(spark, sf), TOURNAMENT_SPEC)
        path = scratch_path(spark, "champions")
        save_champions(result.champions, result.deltas, path)
        result.comparison.write.parquet(f"{path}/comparison")
        _STORES[key] = path
    return _STORES[key]


@register("serve_forecast")
def q_serve_forecast(spark, sf):
    from aerocast.sources.models_io import load_champions
    return rounded(serve(_feats(spark, sf), TOURNAMENT_SPEC, *load_champions(spark, champion_store(spark, sf))))


# ----------------------------------------------------------------- M18 / J8
_SHAP_COEF = {"x1": 1.5, "x2": -20.0, "x3": 7.25}


@register("shapley_linear", _DAILY_ONLY + ", " + """f AS (SELECT series_key, date, x1, x2, x3, series_key || '|' || date AS id FROM daily),
r AS (SELECT * FROM f ORDER BY md5(id || '|42'), series_key, date LIMIT 150),
z AS (SELECT *, row_number() OVER (ORDER BY series_key, date) - 1 AS k FROM (SELECT * FROM f ORDER BY md5(id || '|43'), series_key, date LIMIT 50)),
d AS (SELECT r.*, CAST('0x' || substring(md5(id || '|' || m || '|42'), 1, 8) AS BIGINT) % (SELECT count(*) FROM z) AS k
      FROM r, (SELECT unnest(range(10)) AS m)),
""" + "p AS (" + " UNION ALL ".join(
    f"SELECT d.series_key, d.date, '{c}' AS feature, avg(CAST({b!r} AS DOUBLE) * (d.{c} - z.{c})) AS attribution FROM d JOIN z USING (k) GROUP BY ALL"
    for c, b in _SHAP_COEF.items()) + """)
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, feature, round(attribution, 6) AS attribution FROM p""")
def q_shapley_linear(spark, sf):
    """Sampled attributions of a fixed linear model: the draws are md5-based, so the oracle repeats them."""
    from aerocast.plans.explain import sampled_shapley

    def score(d, name):
        return d.withColumn(name, sum((F.col(c) * b for c, b in _SHAP_COEF.items()), F.lit(3.0)))
    d = _daily(spark, sf).select("series_key", "date", *_SHAP_COEF)
    return rounded(sampled_shapley(d, ["series_key", "date"], list(_SHAP_COEF), score))


# a tree on (x1, x2) whose splits are means, so that SQL can grow it; Shapley values of two features spelt out
@register("tree_shapley", _DAILY_ONLY + """,
s AS (SELECT *, x1 <= avg(x1) OVER () AS a FROM daily),
t AS (SELECT *, avg(x2) OVER (PARTITION BY a) AS c FROM s),
g AS (SELECT a, x2 <= c AS b, avg(y) AS v, count(*) AS n, min(c) AS c FROM t GROUP BY ALL),
p AS (SELECT sum(n) AS n, sum(n * v) / sum(n) AS f0, sum(n) FILTER (a) AS na, sum(n) FILTER (NOT a) AS nb,
  sum(n * v) FILTER (a) / sum(n) FILTER (a) AS fa, sum(n * v) FILTER (NOT a) / sum(n) FILTER (NOT a) AS fb,
  max(c) FILTER (a) AS ca, max(c) FILTER (NOT a) AS cb, max(v) FILTER (a AND b) AS vab, max(v) FILTER (a AND NOT b) AS va,
  max(v) FILTER (NOT a AND b) AS vb, max(v) FILTER (NOT a AND NOT b) AS v0 FROM g),
w AS (SELECT t.series_key, t.date, f0, CASE WHEN a THEN fa ELSE fb END AS f1,
  (na * CASE WHEN x2 <= ca THEN vab ELSE va END + nb * CASE WHEN x2 <= cb THEN vb ELSE v0 END) / n AS f2,
  CASE WHEN a THEN CASE WHEN x2 <= ca THEN vab ELSE va END ELSE CASE WHEN x2 <= cb THEN vb ELSE v0 END END AS f12 FROM t, p)
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, 'x1' AS feature, round((f1 - f0 + f12 - f2) / 2, 6) AS attribution FROM w
UNION ALL
SELECT series_key, strftime(date, '%Y-%m-%d'), 'x2', round((f2 - f0 + f12 - f1) / 2, 6) FROM w""".replace("WITH ,", "WITH"))
def q_tree_shapley(spark, sf):
    from aerocast.plans import trees as TR
    d = _daily(spark, sf).select("series_key", "date", "x1", "x2", "y")
    top = d.agg(F.avg("x1")).first()[0]
    low = F.col("x1") <= top
    side = {r["a"]: r["c"] for r in d.groupBy(low.alias("a")).agg(F.avg("x2").alias("c")).collect()}  # two rows
    cut = F.when(low, F.lit(side[True])).otherwise(F.lit(side[False]))
    leaf = {(r["a"], r["b"]): (r["v"], float(r["n"])) for r in
            d.groupBy(low.alias("a"), (F.col("x2") <= cut).alias("b")).agg(F.avg("y").alias("v"), F.count(F.lit(1)).alias("n")).collect()}  # four rows
    rows = [(0, 0, 0, 0, top, 1, 2, 0.0, sum(n for _, n in leaf.values()))]
    for node, a in ((1, True), (2, False)):
        rows.append((0, node, 1, 1, side[a], 2 * node + 1, 2 * node + 2, 0.0, sum(leaf[a, b][1] for b in (True, False))))
    rows += [(0, 2 * node + 1 + k, 2, -1, 0.0, -1, -1, *leaf[a, b]) for node, a in ((1, True), (2, False)) for k, b in enumerate((True, False))]
    return rounded(TR.tree_shapley(d, ["series_key", "date"], spark.createDataFrame(rows, TR.NODES_DDL), ["x1", "x2"]))


@register("sampled_shapley")
def q_sampled_shapley(spark, sf):
    """Permutation-sampling Shapley attributions of a 37-feature ridge for
    150 sampled days against 50 sampled background days."""
    from aerocast.plans.explain import sampled_shapley
    spec = ForecastSpec()
    fs = spec.features
    df = TN.horizon_frame(_feats(spark, sf), spec, 1, None).cache()
    cols = fs.feature_cols()
    icpt, beta = RG.fit_ridge(RG.block_gramians(df, cols, "target", "weight"), 10.0, len(cols))
    champ = TN.CandidateResult("Ridge", "ridge", 0.0, 0.0, 0.0, None,
                               {"intercept": icpt, "coef": list(beta), "features": cols})
    phi = sampled_shapley(df, [fs.key, fs.date], cols,
                          lambda d, name: TN.raw_prediction(champ, d, cols, name)).checkpoint(eager=True)
    df.unpersist()
    return rounded(phi)
