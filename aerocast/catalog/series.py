"""Registered queries over the lineitem daily series: daily mean, window
operators and the composite feature build."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aerocast import bindings as B
from aerocast.catalog.registry import register, rounded
from aerocast.config import LINEITEM_SPEC as SPEC
from aerocast.operators import stats as S
from aerocast.operators import windows as W
from aerocast.plans import features as FE

K, D, T = SPEC.key, SPEC.date, SPEC.target
COV = list(SPEC.fill_cols)
PART = f"PARTITION BY {K} ORDER BY {D}"

DAILY_SQL = f"""daily AS (
  SELECT {K}, CAST(ts AS DATE) AS {D}, avg({T}) AS {T},
         {", ".join(f"avg({c}) AS {c}" for c in COV)}
  FROM ({B.READINGS_SQL}) GROUP BY 1, 2)"""


def _daily(spark, sf):
    return FE.daily_frame(B.readings(spark, sf), SPEC)


def _with(sql_body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([DAILY_SQL, *ctes]) + "\n" + sql_body


def _sel(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _frame(lo, hi):
    def b(v):
        if v == 0:
            return "CURRENT ROW"
        return f"{abs(v)} PRECEDING" if v < 0 else f"{v} FOLLOWING"
    return f"OVER ({PART} ROWS BETWEEN {b(lo)} AND {b(hi)})"


def _roll_sql(col, n, fn, lagged=True):
    fr = _frame(-n, -1) if lagged else _frame(-(n - 1), 0)
    return f"CASE WHEN count({col}) {fr} = {n} THEN {fn}({col}) {fr} END"


def _ema_sql(col, span, lagged=True):
    """The recursion itself, folded over the whole history of each row."""
    a = 2.0 / (span + 1.0)
    fr = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND {'1 PRECEDING' if lagged else 'CURRENT ROW'})"
    return (f"CASE WHEN count({col}) {fr} > 0 THEN list_reduce(list({col}) FILTER ({col} IS NOT NULL) {fr}, "
            f"lambda acc, x: acc * CAST({1.0 - a!r} AS DOUBLE) + x * CAST({a!r} AS DOUBLE)) END")


def _interp_sql(c, t="day_num"):
    back = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fwd = f"OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    x0 = f"last_value({c} IGNORE NULLS) {back}"
    t0 = f"last_value(CASE WHEN {c} IS NOT NULL THEN {t} END IGNORE NULLS) {back}"
    x1 = f"first_value({c} IGNORE NULLS) {fwd}"
    t1 = f"first_value(CASE WHEN {c} IS NOT NULL THEN {t} END IGNORE NULLS) {fwd}"
    inner = f"({x0}) + (({x1}) - ({x0})) * ({t} - ({t0})) / (({t1}) - ({t0}))"
    return (f"coalesce(CASE WHEN {c} IS NOT NULL THEN {c} WHEN ({t1}) > ({t0}) THEN {inner} END, "
            f"{x0}, {x1}) AS {c}")


# --- A1 daily_mean -----------------------------------------------------------
@register("daily_mean", _with(f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, {_sel([T, *COV])} FROM daily"))
def q_daily_mean(spark, sf):
    d = S.daily_mean(B.readings(spark, sf), [T, *COV], key=K, time="ts", date=D)
    return rounded(d)


# --- W1 lags / W2 leads --------------------------------------------------------
_LAG_COLS = [f"{T}_lag_{k}" for k in SPEC.lags]


@register("lags", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    + ", ".join(f"round(lag({T}, {k}) OVER ({PART}), 6) AS {T}_lag_{k}" for k in SPEC.lags)
    + " FROM daily"))
def q_lags(spark, sf):
    d = W.lags(_daily(spark, sf), T, SPEC.lags, key=K, order=D)
    return rounded(d.select(K, D, *_LAG_COLS))


@register("leads", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    + ", ".join(f"round(lead({T}, {h}) OVER ({PART}), 6) AS {T}_lead_{h}" for h in (1, 2, 3))
    + " FROM daily"))
def q_leads(spark, sf):
    d = W.leads(_daily(spark, sf), T, (1, 2, 3), key=K, order=D)
    return rounded(d.select(K, D, *[f"{T}_lead_{h}" for h in (1, 2, 3)]))


# --- W3 / W4 / W11 rolling --------------------------------------------------------
@register("rolling_mean", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    + ", ".join(f"round({_roll_sql(T, n, 'avg')}, 6) AS {T}_rolling_mean_{n}" for n in SPEC.windows)
    + " FROM daily"))
def q_rolling_mean(spark, sf):
    d = W.rolling_mean(_daily(spark, sf), T, SPEC.windows, key=K, order=D)
    return rounded(d.select(K, D, *[f"{T}_rolling_mean_{n}" for n in SPEC.windows]))


@register("rolling_std", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    + ", ".join(f"round({_roll_sql(T, n, 'stddev_samp')}, 6) AS {T}_rolling_std_{n}" for n in SPEC.windows)
    + " FROM daily"))
def q_rolling_std(spark, sf):
    d = W.rolling_std(_daily(spark, sf), T, SPEC.windows, key=K, order=D)
    return rounded(d.select(K, D, *[f"{T}_rolling_std_{n}" for n in SPEC.windows]))


@register("rolling_mean_incl", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    + ", ".join(f"round({_roll_sql('x1', n, 'avg', lagged=False)}, 6) AS x1_rolling_mean_{n}"
                for n in SPEC.windows)
    + " FROM daily"))
def q_rolling_mean_incl(spark, sf):
    d = W.rolling_mean_incl(_daily(spark, sf), "x1", SPEC.windows, key=K, order=D)
    return rounded(d.select(K, D, *[f"x1_rolling_mean_{n}" for n in SPEC.windows]))


# --- W5 ema --------------------------------------------------------------------------
@register("ema", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    + ", ".join(f"round({_ema_sql(T, s)}, 6) AS {T}_ema_{s}" for s in SPEC.spans)
    + " FROM daily"))
def q_ema(spark, sf):
    d = W.ema(_daily(spark, sf), T, SPEC.spans, key=K, order=D)
    return rounded(d.select(K, D, *[f"{T}_ema_{s}" for s in SPEC.spans]))


# --- W6 / W7 / W8 / W12 changes ---------------------------------------------------------
@register("target_change", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    f"round(lag({T},1) OVER ({PART}) - lag({T},2) OVER ({PART}), 6) AS {T}_change, "
    f"round(lag({T},1) OVER ({PART}) - lag({T},3) OVER ({PART}), 6) AS {T}_change_3, "
    f"round(lag({T},1) OVER ({PART}) - lag({T},7) OVER ({PART}), 6) AS {T}_change_7 FROM daily"))
def q_target_change(spark, sf):
    d = W.target_change(W.lags(_daily(spark, sf), T, SPEC.lags, key=K, order=D), T)
    return rounded(d.select(K, D, f"{T}_change", f"{T}_change_3", f"{T}_change_7"))


@register("covariate_lag_change", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    + ", ".join(f"round(lag({c},1) OVER ({PART}), 6) AS {c}_lag_1, "
                f"round({c} - lag({c},1) OVER ({PART}), 6) AS {c}_change_1" for c in SPEC.lag_change_cols)
    + " FROM daily"))
def q_covariate_lag_change(spark, sf):
    d = W.covariate_lag_change(_daily(spark, sf), SPEC.lag_change_cols, key=K, order=D)
    cols = [f"{c}_{s}" for c in SPEC.lag_change_cols for s in ("lag_1", "change_1")]
    return rounded(d.select(K, D, *cols))


@register("covariate_change", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
    + ", ".join(f"round({c} - lag({c},{k}) OVER ({PART}), 6) AS {c}_change_{k}"
                for c in SPEC.delta_cols for k in (1, 3))
    + " FROM daily"))
def q_covariate_change(spark, sf):
    d = W.covariate_change(_daily(spark, sf), SPEC.delta_cols, (1, 3), key=K, order=D)
    return rounded(d.select(K, D, *[f"{c}_change_{k}" for c in SPEC.delta_cols for k in (1, 3)]))


@register("diff", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, round({T} - lag({T},1) OVER ({PART}), 6) AS {T}_diff FROM daily"))
def q_diff(spark, sf):
    d = W.diff(_daily(spark, sf), T, key=K, order=D)
    return rounded(d.select(K, D, f"{T}_diff"))


# --- W9 / W10 interpolation ---------------------------------------------------------
@register("interp_time", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, round(x4, 6) AS x4, round(x4_raw, 6) AS x4_raw FROM ("
    f"SELECT {K}, {D}, x4 AS x4_raw, {_interp_sql('x4')} FROM "
    f"(SELECT *, CAST({D} - DATE '1970-01-01' AS BIGINT) AS day_num FROM daily))"))
def q_interp_time(spark, sf):
    d = _daily(spark, sf).withColumn("x4_raw", F.col("x4"))
    d = W.interp_time(d, ["x4"], key=K, order=D)
    return rounded(d.select(K, D, "x4", "x4_raw"))


@register("ffill_bfill", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, round(coalesce(x4, "
    f"last_value(x4 IGNORE NULLS) OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value(x4 IGNORE NULLS) OVER ({PART} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS x4 "
    f"FROM daily"))
def q_ffill_bfill(spark, sf):
    d = W.ffill_bfill(_daily(spark, sf), ["x4"], key=K, order=D)
    return rounded(d.select(K, D, "x4"))


# --- W13 latest_row ----------------------------------------------------------------
@register("latest_row", _with(
    f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, {_sel([T, *COV])} FROM daily "
    f"QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY {D} DESC) = 1"))
def q_latest_row(spark, sf):
    return rounded(W.latest_row(_daily(spark, sf), key=K, order=D))


# --- F10 build_features --------------------------------------------------------------
def features_sql(spec=SPEC, final_select: str | None = None) -> str:
    t = spec.target
    calendar = (f"CAST(month({D}) AS INTEGER) AS month, CAST(day({D}) AS INTEGER) AS day, "
                f"CAST(isodow({D}) - 1 AS INTEGER) AS day_of_week")
    tp = f"CAST({2 * math.pi!r} AS DOUBLE)"
    cyc = (f"sin({tp} * month / 12) AS month_sin, cos({tp} * month / 12) AS month_cos, "
           f"sin({tp} * day_of_week / 7) AS dow_sin, cos({tp} * day_of_week / 7) AS dow_cos")
    parts = [f"lag({t}, {k}) OVER ({PART}) AS {t}_lag_{k}" for k in spec.lags]
    for n in spec.windows:
        parts.append(f"{_roll_sql(t, n, 'avg')} AS {t}_rolling_mean_{n}")
        parts.append(f"{_roll_sql(t, n, 'stddev_samp')} AS {t}_rolling_std_{n}")
    parts += [f"{_ema_sql(t, s)} AS {t}_ema_{s}" for s in spec.spans]
    parts += [f"lag({c}, 1) OVER ({PART}) AS {c}_lag_1" for c in spec.lag_change_cols]
    parts += [f"{c} - lag({c}, 1) OVER ({PART}) AS {c}_change_1" for c in spec.lag_change_cols]
    parts += [f"{c} - lag({c}, 1) OVER ({PART}) AS {c}_change_1" for c in spec.delta_cols]
    parts += [f"{c} - lag({c}, 3) OVER ({PART}) AS {c}_change_3" for c in spec.delta_cols]
    changes = (f"{t}_lag_1 - {t}_lag_2 AS {t}_change, {t}_lag_1 - {t}_lag_3 AS {t}_change_3, "
               f"{t}_lag_1 - {t}_lag_7 AS {t}_change_7")
    feats = spec.feature_cols()
    ctes = [
        f"filled AS (SELECT {K}, {D}, {t}, {', '.join(_interp_sql(c) for c in spec.fill_cols)} FROM "
        f"(SELECT *, CAST({D} - DATE '1970-01-01' AS BIGINT) AS day_num FROM daily WHERE {t} IS NOT NULL))",
        f"cal AS (SELECT *, CAST(CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend, {cyc} "
        f"FROM (SELECT *, {calendar} FROM filled))",
        f"win AS (SELECT *, {', '.join(parts)} FROM cal)",
        f"feat AS (SELECT *, {changes} FROM win)",
        f"clean AS (SELECT {K}, {D}, {t}, {', '.join(feats)} FROM feat WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in [t, *feats]) + ")",
    ]
    body = final_select or (f"SELECT {K}, strftime({D}, '%Y-%m-%d') AS {D}, "
                            + ", ".join(f"round({c}, 6) AS {c}" if c not in ("month", "day", "day_of_week", "is_weekend")
                                        else f"CAST({c} AS BIGINT) AS {c}" for c in [t, *feats])
                            + " FROM clean")
    return _with(body, *ctes)


@register("build_features", features_sql())
def q_build_features(spark, sf):
    return rounded(FE.build_features(B.readings(spark, sf), SPEC))


# --- P11 require_history / A19 date_range on the daily frame ----------------------------
@register("date_range", _with(
    f"SELECT {K}, strftime(min({D}), '%Y-%m-%d') AS min_date, strftime(max({D}), '%Y-%m-%d') AS max_date, "
    f"count(*) AS rows FROM daily GROUP BY {K}"))
def q_date_range(spark, sf):
    return rounded(S.date_range(_daily(spark, sf), D, [K]))
