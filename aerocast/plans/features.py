"""Composite feature build and the online snapshot.

raw readings -> daily mean per (series, day) -> drop days without a target ->
time interpolation + edge hold of covariates -> calendar + cyclic ->
target lags / rolling mean+std / EMA / changes -> covariate lags and changes ->
drop rows null in declared feature+target columns.

Physical plan: one partial+final HashAggregate for the daily mean, then ONE
Exchange (hash on series key) + ONE Sort feeding all Window nodes, since every
window shares ``partitionBy(key).orderBy(date)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerocast.config import FeatureSpec
from aerocast.functions.calendar import calendar, cyclic
from aerocast.operators import windows as W
from aerocast.operators.stats import daily_mean


def daily_frame(raw: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Daily means of target and covariates; days without a target dropped."""
    value_cols = [spec.target, *spec.fill_cols]
    daily = daily_mean(raw, value_cols, key=spec.key, time=spec.time, date=spec.date)
    return daily.where(F.col(spec.target).isNotNull())


def engineer(daily: DataFrame, spec: FeatureSpec, drop_incomplete: bool = True) -> DataFrame:
    """Feature columns on a daily frame (key, date, target, fill cols)."""
    k, d, t = spec.key, spec.date, spec.target
    df = W.interp_time(daily, spec.fill_cols, key=k, order=d)
    df = cyclic(calendar(df, d))
    df = W.lags(df, t, spec.lags, key=k, order=d)
    df = W.rolling_mean(df, t, spec.windows, key=k, order=d)
    df = W.rolling_std(df, t, spec.windows, key=k, order=d)
    df = W.ema(df, t, spec.spans, key=k, order=d)
    df = W.target_change(df, t)
    df = W.covariate_lag_change(df, spec.lag_change_cols, key=k, order=d)
    df = W.covariate_change(df, spec.delta_cols, (1, 3), key=k, order=d)
    cols = [k, d, t, *spec.feature_cols()]
    df = df.select(*cols)
    if drop_incomplete:
        df = df.dropna(subset=[t, *spec.feature_cols()])
    return df


def build_features(raw: DataFrame, spec: FeatureSpec, drop_incomplete: bool = True) -> DataFrame:
    return engineer(daily_frame(raw, spec), spec, drop_incomplete)


def online_snapshot(history: DataFrame, today: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Append today's raw rows to the history (missing columns NULL), rebuild
    features and keep the newest engineered row of every series; missing
    feature values become 0.0 (the serving fallback)."""
    combined = history.unionByName(today, allowMissingColumns=True)
    feats = build_features(combined, spec)
    newest = W.latest_row(feats, key=spec.key, order=spec.date)
    return newest.fillna(0.0, subset=spec.feature_cols())


# --- W18 from state: one row a series, folded forward by the days that come ------
def _tail_rows(spec: FeatureSpec) -> int:
    """Daily rows that the newest row's lags, windows and changes look back on, itself included."""
    return max(*spec.lags, *spec.windows, 3) + 2


def _day(spec: FeatureSpec):
    return F.struct(F.col(spec.date).alias("d"), *[F.col(c).cast("double").alias(c) for c in (spec.target, *spec.fill_cols)])


def _folded(days, start, span: int, target: str):
    a = 2.0 / (span + 1.0)
    return F.aggregate(days, start, lambda e, x: F.when(e.isNull(), x[target]).otherwise(e * (1.0 - a) + x[target] * a))


def _with(days, c: str):
    return F.filter(days, lambda x: x[c].isNotNull())


def snapshot_state(history: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The state of every series after its history, one row each: ``tail`` (its last daily rows, oldest first),
    ``known`` (each covariate's last value before the tail, with its date) and, for every span, the average before and
    after the last row. It is what ``advance_state`` keeps up; only this first build reads the history."""
    k, d, t, n = spec.key, spec.date, spec.target, _tail_rows(spec)
    daily = daily_frame(history, spec)
    daily = W.ema(daily, t, spec.spans, key=k, order=d, fmt="_before_{s}")
    daily = W.ema(daily, t, spec.spans, key=k, order=d, lagged=False, fmt="_after_{s}")
    daily = daily.withColumn("_r", F.row_number().over(Window.partitionBy(k).orderBy(F.desc(d))))
    known = [F.max(F.when((F.col("_r") > n) & F.col(c).isNotNull(), F.struct(F.col(d).alias("d"), F.col(c).cast("double").alias("v")))).alias(c) for c in spec.fill_cols]
    averages = [F.max_by(c, d).alias(c) for s in spec.spans for c in (f"_before_{s}", f"_after_{s}")]
    tail = F.sort_array(F.collect_list(F.when(F.col("_r") <= n, _day(spec)))).alias("tail")
    rows = daily.groupBy(k).agg(tail, *known, *averages)
    return _state(rows, spec)


def _state(rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    return rows.select(spec.key, "tail", F.struct(*spec.fill_cols).alias("known"),
                       *[c for s in spec.spans for c in (f"_before_{s}", f"_after_{s}")])


def advance_state(state: DataFrame, new: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The state after the raw readings ``new``: whole days, each after the last day of its series (earlier ones are
    left out; they need a new build). A series may be new, or have no reading. Reads the new readings and the state."""
    k, t, n = spec.key, spec.target, _tail_rows(spec)
    empty = F.array().cast(state.schema["tail"].dataType)
    days = daily_frame(new.select(k, spec.time, t, *spec.fill_cols), spec).groupBy(k).agg(F.sort_array(F.collect_list(_day(spec))).alias("_new"))
    both = state.join(days, k, "full_outer").withColumns({"tail": F.coalesce("tail", empty), "_new": F.coalesce("_new", empty)})
    last = F.try_element_at("tail", F.lit(-1))["d"]
    both = both.withColumn("_last", last).withColumn("_new", F.filter("_new", lambda x: F.col("_last").isNull() | (x["d"] > F.col("_last"))))
    both = both.withColumn("_all", F.concat("tail", "_new"))
    gone = F.slice("_all", F.lit(1), F.greatest(F.size("_all") - n, F.lit(0)))
    known = []
    for c in spec.fill_cols:
        newest = F.try_element_at(_with(gone, c), F.lit(-1))
        known.append(F.when(newest.isNotNull(), F.struct(newest["d"].alias("d"), newest[c].alias("v"))).otherwise(F.col(f"known.{c}")).alias(c))
    averages = []
    for s in spec.spans:
        earlier = _folded(F.slice("_new", F.lit(1), F.greatest(F.size("_new") - 1, F.lit(0))), F.col(f"_after_{s}"), s, t)
        averages += [F.when(F.size("_new") > 0, earlier).otherwise(F.col(f"_before_{s}")).alias(f"_before_{s}"),
                     _folded(F.col("_new"), F.col(f"_after_{s}"), s, t).alias(f"_after_{s}")]
    tail = F.slice("_all", F.greatest(F.size("_all") - n + 1, F.lit(1)), F.lit(n)).alias("tail")
    return _state(both.select(k, tail, *known, *averages), spec)


def state_snapshot(state: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The newest feature row of every series, as ``online_snapshot`` gives it, from the state alone. Series with too few
    rows, or with a covariate that was never known, have none."""
    k, d, t = spec.key, spec.date, spec.target
    cols = [t, *spec.fill_cols]
    rows = state.select(k, F.explode("tail").alias("x")).select(k, F.col("x.d").alias(d), *[F.col(f"x.{c}").alias(c) for c in cols], F.lit(True).alias("_row"))
    before = [F.when(F.col(f"known.{c}").isNotNull(), F.struct(F.col(f"known.{c}.d").alias("d"), *[(F.col(f"known.{c}.v") if x == c else F.lit(None).cast("double")).alias(x) for x in cols]))
              for c in spec.fill_cols]
    known = state.select(k, F.explode(F.array_compact(F.array(*before))).alias("x")).select(
        k, F.col("x.d").alias(d), *[F.col(f"x.{c}").alias(c) for c in cols], F.lit(False).alias("_row"))
    filled = W.interp_time(rows.union(known), spec.fill_cols, key=k, order=d).where("_row").drop("_row")
    newest = W.latest_row(engineer(filled, spec), key=k, order=d).drop(*[f"{t}_ema_{s}" for s in spec.spans])
    averages = state.select(k, *[F.col(f"_before_{s}").alias(f"{t}_ema_{s}") for s in spec.spans])
    return newest.join(averages, k).select(k, d, t, *spec.feature_cols()).fillna(0.0, subset=spec.feature_cols())
