"""Registered queries for statistics and profiling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aerocast import bindings as B
from aerocast.catalog.registry import register, rounded
from aerocast.catalog.series import DAILY_SQL, _daily
from aerocast.config import RANGE_EDGES
from aerocast.operators import stats as S

_DAILY_ONLY = "WITH " + DAILY_SQL + " "
_DCOLS = ["y", "x1", "x2", "x3", "x4"]


# ----------------------------------------------------------------- A2 / A4
@register("describe", """SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean,
  round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(max(l_extendedprice), 6) AS max
FROM lineitem GROUP BY l_returnflag""")
def q_describe(spark, sf):
    return rounded(S.describe(B.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@register("describe_all", """SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM events""")
def q_describe_all(spark, sf):
    return rounded(S.describe(B.table(spark, sf, "events"), "value"))


@register("kpi_stats", """SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events GROUP BY event_type""")
def q_kpi_stats(spark, sf):
    return rounded(S.kpi_stats(B.table(spark, sf, "events"), "value", ["event_type"]))


# ----------------------------------------------------------------- A3
_E = RANGE_EDGES


@register("range_counts", "SELECT " + ", ".join(
    [f"count(*) FILTER (WHERE value < {_E[0]}) AS n_lt_{_E[0]}"]
    + [f"count(*) FILTER (WHERE value >= {lo} AND value < {hi}) AS n_{lo}_{hi}" for lo, hi in zip(_E, _E[1:])]
    + [f"count(*) FILTER (WHERE value >= {_E[-1]}) AS n_{_E[-1]}_plus"]) + " FROM events")
def q_range_counts(spark, sf):
    return S.range_counts(B.table(spark, sf, "events"), "value")


# ----------------------------------------------------------------- A5
_HIST_COLS = ["value", "k"]
_EVK = "(SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"


@register("histogram", f"""WITH long AS (UNPIVOT {_EVK} ON value, k INTO NAME feature VALUE value),
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
b AS (SELECT l.feature, l.value, r.lo, r.hi, (r.hi - r.lo) / 30 AS width,
  CAST(CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor((l.value - r.lo) / ((r.hi - r.lo) / 30)), 29) END AS BIGINT) AS bin
  FROM long l JOIN rng r USING (feature) WHERE l.value IS NOT NULL)
SELECT feature, bin, count(*) AS count, round(any_value(lo + bin * width), 6) AS lo,
  round(any_value(lo + (bin + 1) * width), 6) AS hi FROM b GROUP BY feature, bin""")
def q_histogram(spark, sf):
    ev = B.table(spark, sf, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rounded(S.histogram(ev, _HIST_COLS, 30))


# ----------------------------------------------------------------- A6
@register("kde", f"""WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL),
st AS (SELECT count(v) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM v),
p AS (SELECT n, sd * pow(n, -0.2) AS bw, lo, (hi - lo) / 199 AS step FROM st),
g AS (SELECT CAST(range AS BIGINT) AS g FROM range(200))
SELECT g.g AS grid, round(any_value(p.lo + g.g * p.step), 6) AS x,
  round(sum(exp(-0.5 * ((p.lo + g.g * p.step - v.v) / p.bw) * ((p.lo + g.g * p.step - v.v) / p.bw)))
        / (any_value(p.n) * any_value(p.bw) * CAST({math.sqrt(2 * math.pi)!r} AS DOUBLE)), 6) AS density
FROM v, p, g GROUP BY g.g""")
def q_kde(spark, sf):
    return rounded(S.kde(B.table(spark, sf, "events"), "value", 200))


# ----------------------------------------------------------------- A7 / A8
_BOX_SRC = "(SELECT p_partkey AS id, p_retailprice, CAST(p_size AS DOUBLE) AS p_size FROM part)"
_BOX_SQL = f"""long AS (UNPIVOT {_BOX_SRC} ON p_retailprice, p_size INTO NAME feature VALUE value),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM long GROUP BY feature),
w AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)"""


@register("box_stats", f"""WITH {_BOX_SQL}
SELECT w.feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lower, 6) AS lower, round(upper, 6) AS upper,
  count(*) FILTER (WHERE l.value < w.lower OR l.value > w.upper) AS outliers, count(*) AS n
FROM w JOIN long l USING (feature) GROUP BY ALL""")
def q_box_stats(spark, sf):
    pt = B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    return rounded(S.box_stats(pt, ["p_retailprice", "p_size"]))


@register("box_stats_customer", """WITH long AS (SELECT 'c_acctbal' AS feature, c_acctbal AS value FROM customer),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM long GROUP BY feature),
w AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT w.feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lower, 6) AS lower, round(upper, 6) AS upper,
  count(*) FILTER (WHERE l.value < w.lower OR l.value > w.upper) AS outliers, count(*) AS n
FROM w JOIN long l USING (feature) GROUP BY ALL""")
def q_box_stats_customer(spark, sf):
    return rounded(S.box_stats(B.table(spark, sf, "customer"), ["c_acctbal"]))


@register("outlier_rows", """WITH long AS (SELECT event_id, 'value' AS feature, value FROM events),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long)
SELECT event_id, feature, round(value, 6) AS value FROM long, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def q_outlier_rows(spark, sf):
    ev = B.table(spark, sf, "events").select("event_id", "value")
    return rounded(S.outlier_rows(ev, ["event_id"], ["value"]))


# ----------------------------------------------------------------- A9 / A10 / A11 / A12 / A14
@register("missing_counts", _DAILY_ONLY + "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing FROM daily"
     for c in ["series_key", "date", *_DCOLS]]
    + ["SELECT '__total__' AS column, CAST(" + " + ".join(
        f"count(*) FILTER (WHERE {c} IS NULL)" for c in ["series_key", "date", *_DCOLS]) + " AS BIGINT) AS missing FROM daily"])
    + ")")
def q_missing_counts(spark, sf):
    return S.missing_counts(_daily(spark, sf))


@register("profile", """SELECT column_name AS column,
  CASE WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'BIGINT' THEN 'bigint'
       WHEN column_type = 'INTEGER' THEN 'int' WHEN column_type = 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS dtype,
  column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AS is_numeric,
  (SELECT count(*) FROM customer) AS rows, CAST(5 AS BIGINT) AS n_columns,
  CAST(3 AS BIGINT) AS n_numeric
FROM (DESCRIBE customer)""")
def q_profile(spark, sf):
    return S.profile(B.table(spark, sf, "customer"))


_CORR_PAIRS = [(a, b) for i, a in enumerate(_DCOLS) for b in _DCOLS[i:]]


@register("corr_matrix", _DAILY_ONLY + "SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM daily" for a, b in _CORR_PAIRS]
    + [f"SELECT '{b}' AS a, '{a}' AS b, round(corr({a}, {b}), 6) AS corr FROM daily" for a, b in _CORR_PAIRS if a != b])
    + ")")
def q_corr_matrix(spark, sf):
    return rounded(S.corr_matrix(_daily(spark, sf), _DCOLS))


@register("corr_rank", _DAILY_ONLY + "SELECT feature, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, y) AS corr FROM daily" for c in ["x1", "x2", "x3", "x4"]) + ") ORDER BY abs_corr DESC")
def q_corr_rank(spark, sf):
    return rounded(S.corr_rank(_daily(spark, sf), ["x1", "x2", "x3", "x4"], "y"))


# ----------------------------------------------------------------- A2-A5, A7-A9, A11, A12 on columns with NaN
# Spark sees NaN where the oracle sees NULL: two columns of lineitem lose a third of their values each
_NAN_SQL = """WITH n AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END AS a,
  CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS b, l_tax AS c FROM lineitem)"""


def _with_nan(spark, sf):
    nan, k = F.lit(float("nan")), F.col("l_linenumber") % 3
    li = B.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", F.when(k == 0, nan).otherwise(F.col("l_extendedprice")).alias("a"),
                     F.when(k == 1, nan).otherwise(F.col("l_quantity").cast("double")).alias("b"), F.col("l_tax").alias("c"))


def _describe_sql(names):
    return ", ".join({"count": "count(a) AS count", "mean": "round(avg(a), 6) AS mean", "std": "round(stddev_samp(a), 6) AS std", "min": "round(min(a), 6) AS min",
                      "p25": "round(quantile_cont(a, 0.25), 6) AS p25", "p50": "round(quantile_cont(a, 0.5), 6) AS p50", "median": "round(quantile_cont(a, 0.5), 6) AS median",
                      "p75": "round(quantile_cont(a, 0.75), 6) AS p75", "max": "round(max(a), 6) AS max"}[x] for x in names)


@register("describe_nan", f"{_NAN_SQL} SELECT l_returnflag, {_describe_sql(['count', 'mean', 'std', 'min', 'p25', 'p50', 'p75', 'max'])} FROM n GROUP BY l_returnflag")
def q_describe_nan(spark, sf):
    return rounded(S.describe(_with_nan(spark, sf), "a", ["l_returnflag"]))


@register("kpi_stats_nan", f"{_NAN_SQL} SELECT {_describe_sql(['mean', 'median', 'std', 'min', 'max'])} FROM n")
def q_kpi_stats_nan(spark, sf):
    return rounded(S.kpi_stats(_with_nan(spark, sf), "a"))


@register("range_counts_nan", _NAN_SQL + " SELECT " + ", ".join(
    [f"count(*) FILTER (WHERE b < {_E[0]}) AS n_lt_{_E[0]}"] + [f"count(*) FILTER (WHERE b >= {lo} AND b < {hi}) AS n_{lo}_{hi}" for lo, hi in zip(_E, _E[1:])]
    + [f"count(*) FILTER (WHERE b >= {_E[-1]}) AS n_{_E[-1]}_plus"]) + " FROM n")
def q_range_counts_nan(spark, sf):
    return S.range_counts(_with_nan(spark, sf), "b")


@register("histogram_nan", _NAN_SQL + """, long AS (UNPIVOT (SELECT a, b FROM n) ON a, b INTO NAME feature VALUE value),
rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY feature),
x AS (SELECT l.feature, r.lo, (r.hi - r.lo) / 10 AS width, CAST(least(floor((l.value - r.lo) / ((r.hi - r.lo) / 10)), 9) AS BIGINT) AS bin
  FROM long l JOIN rng r USING (feature) WHERE l.value IS NOT NULL)
SELECT feature, bin, count(*) AS count, round(any_value(lo + bin * width), 6) AS lo, round(any_value(lo + (bin + 1) * width), 6) AS hi FROM x GROUP BY feature, bin""")
def q_histogram_nan(spark, sf):
    return rounded(S.histogram(_with_nan(spark, sf), ["a", "b"], 10))


@register("box_stats_nan", _NAN_SQL + """, long AS (SELECT feature, value FROM (UNPIVOT (SELECT a, b FROM n) ON a, b INTO NAME feature VALUE value) WHERE value IS NOT NULL),
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY feature),
w AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT w.feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower, 6) AS lower, round(upper, 6) AS upper,
  count(*) FILTER (WHERE l.value < w.lower OR l.value > w.upper) AS outliers, count(*) AS n FROM w JOIN long l USING (feature) GROUP BY ALL""")
def q_box_stats_nan(spark, sf):
    return rounded(S.box_stats(_with_nan(spark, sf), ["a", "b"]))


@register("outlier_rows_nan", _NAN_SQL + """, q AS (SELECT quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.75) AS q3 FROM n)
SELECT l_orderkey, l_linenumber, 'a' AS feature, round(a, 6) AS value FROM n, q WHERE a < q1 - 1.5 * (q3 - q1) OR a > q3 + 1.5 * (q3 - q1)""")
def q_outlier_rows_nan(spark, sf):
    return rounded(S.outlier_rows(_with_nan(spark, sf), ["l_orderkey", "l_linenumber"], ["a"]), exclude=("l_linenumber",))


@register("missing_counts_nan", _NAN_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM n" for c in ("a", "b", "c")]
    + ["SELECT '__total__' AS column, count(*) FILTER (WHERE a IS NULL) + count(*) FILTER (WHERE b IS NULL) + count(*) FILTER (WHERE c IS NULL) AS missing FROM n"]) + ")")
def q_missing_counts_nan(spark, sf):
    return S.missing_counts(_with_nan(spark, sf), ["a", "b", "c"])


@register("corr_matrix_nan", _NAN_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 6) AS corr FROM n" for x in "abc" for y in "abc") + ")")
def q_corr_matrix_nan(spark, sf):
    return rounded(S.corr_matrix(_with_nan(spark, sf), ["a", "b", "c"]))


@register("corr_rank_nan", _NAN_SQL + " SELECT feature, round(corr, 6) AS corr, round(abs(corr), 6) AS abs_corr FROM (" + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, corr({x}, a) AS corr FROM n" for x in "bc") + ")")
def q_corr_rank_nan(spark, sf):
    return rounded(S.corr_rank(_with_nan(spark, sf), ["b", "c"], "a"))


@register("scatter_sample", """SELECT l_orderkey, l_linenumber, feature, round(value, 6) AS value, round(l_extendedprice, 6) AS target
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_quantity AS DOUBLE) AS l_quantity,
  CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem)
UNPIVOT (value FOR feature IN (l_quantity, l_discount, l_tax)) WHERE l_extendedprice IS NOT NULL""")
def q_scatter_sample(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return rounded(S.scatter_pairs(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_orderkey", "l_linenumber"]))


@register("unpivot_long", _DAILY_ONLY + """SELECT series_key, strftime(date, '%Y-%m-%d') AS date, feature, round(value, 6) AS value
FROM daily UNPIVOT INCLUDE NULLS (value FOR feature IN (y, x1, x2, x3, x4))""")
def q_unpivot_long(spark, sf):
    return rounded(S.unpivot_long(_daily(spark, sf), ["series_key", "date"], _DCOLS))


# ----------------------------------------------------------------- A15 / A16 / A18 / A19 / A20 / A21
@register("forecast_summary", _DAILY_ONLY + """SELECT series_key, round(avg(y), 6) AS mean_pred, round(max(y), 6) AS max_pred,
  round(min(y), 6) AS min_pred FROM daily GROUP BY series_key""")
def q_forecast_summary(spark, sf):
    return rounded(S.forecast_summary(_daily(spark, sf), "y", ["series_key"]))


@register("worst_day", _DAILY_ONLY + """SELECT series_key, strftime(date, '%Y-%m-%d') AS date, round(y, 6) AS y,
  round(x1, 6) AS x1 FROM daily WHERE y >= 50000
QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY y DESC, date) = 1""")
def q_worst_day(spark, sf):
    d = _daily(spark, sf).select("series_key", "date", "y", "x1")
    return rounded(S.worst_day(d, 50000, "y", "date", ["series_key"]))


_NAIVE = """naive AS (SELECT series_key, date, y, lag(y, 1) OVER (PARTITION BY series_key ORDER BY date) AS pred FROM daily)"""


@register("regression_metrics", _DAILY_ONLY + ", " + _NAIVE + """
SELECT series_key, count(*) AS n, round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
  round(1 - avg((y - pred) * (y - pred)) / var_pop(y), 6) AS r2
FROM naive WHERE pred IS NOT NULL GROUP BY series_key""")
def q_regression_metrics(spark, sf):
    from aerocast.operators import windows as W
    d = W.lags(_daily(spark, sf), "y", [1], key="series_key", order="date").withColumnRenamed("y_lag_1", "pred")
    return rounded(S.regression_metrics(d, "y", "pred", ["series_key"]))


@register("metric_avg", _DAILY_ONLY + ", " + _NAIVE + """, m AS (
SELECT series_key, avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse,
  1 - avg((y - pred) * (y - pred)) / var_pop(y) AS r2 FROM naive WHERE pred IS NOT NULL GROUP BY series_key)
SELECT round(avg(mae), 6) AS avg_mae, round(avg(rmse), 6) AS avg_rmse, round(avg(r2), 6) AS avg_r2 FROM m""")
def q_metric_avg(spark, sf):
    from aerocast.operators import windows as W
    d = W.lags(_daily(spark, sf), "y", [1], key="series_key", order="date").withColumnRenamed("y_lag_1", "pred")
    return rounded(S.metric_avg(S.regression_metrics(d, "y", "pred", ["series_key"])))


@register("alert_count", """SELECT CASE WHEN value <= 50 THEN 'Good' WHEN value <= 100 THEN 'Moderate'
  WHEN value <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN value <= 200 THEN 'Unhealthy'
  WHEN value <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS status, count(*) AS alerts
FROM events WHERE value >= 100 GROUP BY 1""")
def q_alert_count(spark, sf):
    from aerocast.functions import rules as R
    ev = B.table(spark, sf, "events").where(F.col("value") >= 100).withColumn("status", R.aqi_band("value"))
    return S.alert_count(ev, "status")
