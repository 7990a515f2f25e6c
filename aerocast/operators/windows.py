"""Window / time-series operators.

All of them use the same ``Window.partitionBy(key).orderBy(order)`` spec, so a
chain of them plans as one Exchange + one Sort followed by Window nodes. Frames
are row frames: lags count rows (days that carry a target), not calendar days.

Scale note: these run on *daily* rows (one per series and day, produced by a
partially-aggregated ``daily_mean``), so a series holds at most its number of
days, however many raw readings a hot series has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding
UNF = Window.unboundedFollowing


def _keys(key) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)


def series_window(key="series_key", order="date"):
    order_cols = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*_keys(key)).orderBy(*order_cols)


# --- W1 / W2 -----------------------------------------------------------------
def lags(df: DataFrame, col: str, ks: Sequence[int], key="series_key", order="date",
         fmt: str = "{c}_lag_{k}") -> DataFrame:
    w = series_window(key, order)
    return df.withColumns({fmt.format(c=col, k=k): F.lag(col, k).over(w) for k in ks})


def leads(df: DataFrame, col: str, hs: Sequence[int], key="series_key", order="date",
          fmt: str = "{c}_lead_{k}") -> DataFrame:
    w = series_window(key, order)
    return df.withColumns({fmt.format(c=col, k=h): F.lead(col, h).over(w) for h in hs})


# --- W3 / W4 / W11 -----------------------------------------------------------
def _rolling(df, col, windows, agg, name_fmt, lagged, key, order):
    w = series_window(key, order)
    out = {}
    for n in windows:
        # rolling(n) over lag1 == frame [t-n, t-1] of the column itself
        lo, hi = (-n, -1) if lagged else (-(n - 1), 0)
        frame = w.rowsBetween(lo, hi)
        full = F.count(col).over(frame) == n  # NULL until the window is full
        out[name_fmt.format(c=col, n=n)] = F.when(full, agg(col).over(frame))
    return df.withColumns(out)


def rolling_mean(df: DataFrame, col: str, windows: Sequence[int], key="series_key",
                 order="date", lagged: bool = True, fmt: str = "{c}_rolling_mean_{n}") -> DataFrame:
    """Mean over the previous ``n`` rows (excludes the current one), full windows only."""
    return _rolling(df, col, windows, F.avg, fmt, lagged, key, order)


def rolling_std(df: DataFrame, col: str, windows: Sequence[int], key="series_key",
                order="date", lagged: bool = True, fmt: str = "{c}_rolling_std_{n}") -> DataFrame:
    """Sample standard deviation over the previous ``n`` rows, full windows only."""
    return _rolling(df, col, windows, F.stddev_samp, fmt, lagged, key, order)


def rolling_mean_incl(df: DataFrame, col: str, windows: Sequence[int], key="series_key",
                      order="date", fmt: str = "{c}_rolling_mean_{n}") -> DataFrame:
    """Legacy variant: the window includes the current row."""
    return _rolling(df, col, windows, F.avg, fmt, False, key, order)


# --- W5 ----------------------------------------------------------------------
EMA_BLOCK = 128


def ema(df: DataFrame, col: str, spans: Sequence[int], key="series_key", order="date",
        lagged: bool = True, fmt: str = "{c}_ema_{s}") -> DataFrame:
    """Recursive EMA (adjust=False) seeded at the first non-null value; a null
    value leaves it as it is.

    The recursion e -> (1-a) e + a x is affine, so a run of rows is summed up by
    its count of values and its fold from zero. Rows are cut into blocks of
    ``EMA_BLOCK``; the state at a block's start is the composition of the blocks
    before it, and within the block the fold runs over its own rows. All history
    counts, with at most EMA_BLOCK + n / EMA_BLOCK values per row held.
    """
    keys = _keys(key)
    w = series_window(key, order)
    order_cols = [order] if isinstance(order, str) else list(order)
    d = df.withColumn("_eb", F.floor((F.row_number().over(w) - 1) / EMA_BLOCK))
    within = Window.partitionBy(*keys, "_eb").orderBy(*order_cols)
    d = d.withColumns({"_eh": F.collect_list(col).over(within.rowsBetween(UNB, 0)),
                       "_el": F.lead(F.lit(1)).over(within).isNull()})
    # a block's values stand at its last row; the blocks before a row are those with a smaller number
    before = Window.partitionBy(*keys).orderBy("_eb").rangeBetween(UNB, -1)

    def fold(values, start, a):
        return F.aggregate(values, start, lambda acc, x: acc * (1.0 - a) + x * a)

    out = {}
    for s in spans:
        a = 2.0 / (s + 1.0)
        hist = F.col("_eh")
        if lagged:
            hist = F.when(F.col(col).isNull(), hist).otherwise(F.slice(hist, 1, F.size(hist) - 1))
        rest = F.slice(F.col("_eh"), 2, EMA_BLOCK)
        seeded = F.when(F.size("_eh") > 0, fold(rest, F.col("_eh")[0], a))
        block = F.struct(F.size("_eh").cast("double").alias("m"), seeded.alias("s"), fold(F.col("_eh"), F.lit(0.0), a).alias("b"))
        d = d.withColumn("_es", F.collect_list(F.when(F.col("_el"), block)).over(before))
        carry = F.aggregate("_es", F.lit(None).cast("double"), lambda acc, x: F.when(x["m"] == 0, acc).when(
            acc.isNull(), x["s"]).otherwise(acc * F.pow(F.lit(1.0 - a), x["m"]) + x["b"]))
        d = d.withColumns({"_ec": carry, "_ew": hist})
        own = F.when(F.size("_ew") > 0, fold(F.slice(F.col("_ew"), 2, EMA_BLOCK), F.col("_ew")[0], a))
        d = d.withColumn(fmt.format(c=col, s=s), F.when(F.col("_ec").isNull(), own).otherwise(fold(F.col("_ew"), F.col("_ec"), a)))
    return d.drop("_eb", "_eh", "_el", "_es", "_ec", "_ew")


# --- W6 / W7 / W8 / W12 ------------------------------------------------------
def target_change(df: DataFrame, target: str) -> DataFrame:
    """lag1-lag2, lag1-lag3, lag1-lag7 (needs the lag columns)."""
    l1 = F.col(f"{target}_lag_1")
    return df.withColumns({
        f"{target}_change": l1 - F.col(f"{target}_lag_2"),
        f"{target}_change_3": l1 - F.col(f"{target}_lag_3"),
        f"{target}_change_7": l1 - F.col(f"{target}_lag_7"),
    })


def covariate_lag_change(df: DataFrame, cols: Sequence[str], key="series_key", order="date") -> DataFrame:
    w = series_window(key, order)
    out = {}
    for c in cols:
        out[f"{c}_lag_1"] = F.lag(c, 1).over(w)
    for c in cols:
        out[f"{c}_change_1"] = F.col(c) - F.lag(c, 1).over(w)
    return df.withColumns(out)


def covariate_change(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = (1, 3),
                     key="series_key", order="date") -> DataFrame:
    w = series_window(key, order)
    return df.withColumns({f"{c}_change_{k}": F.col(c) - F.lag(c, k).over(w)
                           for k in ks for c in cols})


def diff(df: DataFrame, col: str, key="series_key", order="date", name: str | None = None) -> DataFrame:
    w = series_window(key, order)
    return df.withColumn(name or f"{col}_diff", F.col(col) - F.lag(col, 1).over(w))


# --- W9 / W10 ----------------------------------------------------------------
def interp_time(df: DataFrame, cols: Sequence[str], key="series_key", order="date",
                hold_edges: bool = True) -> DataFrame:
    """Linear interpolation in elapsed time between the nearest non-null
    neighbours; with ``hold_edges`` leading/trailing gaps take the nearest value.
    """
    w = series_window(key, order)
    back = w.rowsBetween(UNB, 0)
    # "next non-null" as a running frame over the reversed order: O(n) per
    # series, where an unbounded-following frame is recomputed for every row.
    fwd = _reversed_window(key, order).rowsBetween(UNB, 0)
    last = order if isinstance(order, str) else list(order)[-1]
    kind = df.schema[last].dataType.simpleString()
    if kind != "date" and not kind.startswith("timestamp"):
        raise ValueError(f"interp_time needs a date or timestamp order, {last} is {kind}")
    t = F.unix_date(last) if kind == "date" else F.unix_micros(F.col(last).cast("timestamp"))
    out = {}
    for c in cols:
        tc = F.when(F.col(c).isNotNull(), t)
        x0 = F.last(c, ignorenulls=True).over(back)
        t0 = F.last(tc, ignorenulls=True).over(back)
        x1 = F.last(c, ignorenulls=True).over(fwd)
        t1 = F.last(tc, ignorenulls=True).over(fwd)
        inner = x0 + (x1 - x0) * (t - t0) / (t1 - t0)
        filled = F.when(F.col(c).isNotNull(), F.col(c)).when(t1 > t0, inner)
        if hold_edges:
            filled = F.coalesce(filled, x0, x1)
        out[c] = filled
    return df.withColumns(out)


def ffill_bfill(df: DataFrame, cols: Sequence[str], key="series_key", order="date") -> DataFrame:
    w = series_window(key, order)
    rw = _reversed_window(key, order)
    return df.withColumns({
        c: F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(w.rowsBetween(UNB, 0)),
                      F.last(c, ignorenulls=True).over(rw.rowsBetween(UNB, 0)))
        for c in cols})


def _reversed_window(key, order):
    order_cols = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*_keys(key)).orderBy(*[F.col(o).desc() for o in order_cols])


# --- W13 ---------------------------------------------------------------------
def latest_row(df: DataFrame, key="series_key", order="date") -> DataFrame:
    """Newest row per series as an aggregate (``max_by``): partial aggregation,
    no sort of the series, safe for a hot key."""
    keys = _keys(key)
    order_cols = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c not in keys]
    ordering = F.struct(*order_cols) if len(order_cols) > 1 else F.col(order_cols[0])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), ordering).alias("_r"))
    return picked.select(*keys, "_r.*")


# --- W14 / W15 ---------------------------------------------------------------
def _time_bucket(df: DataFrame, order, bucket_seconds: int | None):
    """Bucket id monotone in the first order column: day buckets for
    timestamps/dates; None asks for one bucket (a plain per-key window)."""
    first = ([order] if isinstance(order, str) else list(order))[0]
    t = df.schema[first].dataType.simpleString()
    if not bucket_seconds:
        return F.lit(0)
    if t.startswith("timestamp"):
        return F.floor(F.unix_micros(F.col(first).cast("timestamp")) / (bucket_seconds * 1_000_000))
    if t == "date":
        return F.floor(F.unix_date(F.col(first)) * 86400 / bucket_seconds)
    if t in ("tinyint", "smallint", "int", "bigint"):  # counted in seconds
        return F.floor(F.col(first) / bucket_seconds)
    raise ValueError(f"{first} is {t}: time buckets need a date, timestamp or integer; bucket_seconds=None runs one window per key")


def _history_lags(df: DataFrame, value: str, key, order, bucket_seconds: int | None = 86400):
    """Previous 1..3 non-null observations before each row (``_p1.._p3``,
    NULL if none) and their count ``_n``.

    Skew-safe: the running windows run per (key, time bucket); the last three
    observations of earlier buckets are carried in from a small per-bucket
    table (a bucket's state depends on at most the three latest non-empty
    buckets before it), so a key holding a third of all rows is still split
    into many tasks.
    """
    keys = _keys(key)
    order_cols = [order] if isinstance(order, str) else list(order)
    d = df.withColumn("_bk", _time_bucket(df, order, bucket_seconds))
    wb = Window.partitionBy(*keys, "_bk").orderBy(*order_cols)
    before, upto = wb.rowsBetween(UNB, -1), wb.rowsBetween(UNB, 0)
    obs = F.col(value).isNotNull()
    d = d.withColumn("_i1", F.last(value, ignorenulls=True).over(before))
    d = d.withColumn("_i2", F.last(F.when(obs, F.col("_i1")), ignorenulls=True).over(before))
    d = d.withColumn("_i3", F.last(F.when(obs, F.col("_i2")), ignorenulls=True).over(before))
    d = d.withColumn("_in", F.count(value).over(before))
    # state at the end of each bucket: its last three observations, oldest first
    last3 = F.filter(F.array(F.when(obs, F.col("_i2")).otherwise(F.col("_i3")),
                             F.when(obs, F.col("_i1")).otherwise(F.col("_i2")),
                             F.when(obs, F.col(value)).otherwise(F.col("_i1"))), lambda x: x.isNotNull())
    ordering = F.struct(*order_cols)
    summ = d.groupBy(*keys, "_bk").agg(F.max_by(last3, ordering).alias("_own"), F.count(value).alias("_cnt"))
    wk = Window.partitionBy(*keys).orderBy("_bk")
    ne = summ.where(F.col("_cnt") > 0)
    ne = ne.withColumn("_st", F.flatten(F.collect_list("_own").over(wk.rowsBetween(-2, 0))))
    ne = ne.withColumn("_st", F.slice("_st", F.greatest(F.size("_st") - 2, F.lit(1)), 3))
    allb = summ.join(ne.select(*keys, "_bk", "_st"), [*keys, "_bk"], "left")
    carry = allb.select(*keys, "_bk",
                        F.last("_st", ignorenulls=True).over(wk.rowsBetween(UNB, -1)).alias("_carry"),
                        F.coalesce(F.sum("_cnt").over(wk.rowsBetween(UNB, -1)), F.lit(0)).alias("_cn"))
    d = d.join(carry, [*keys, "_bk"], "left")
    inb = F.filter(F.array("_i3", "_i2", "_i1"), lambda x: x.isNotNull())
    hist = F.concat(F.coalesce(F.col("_carry"), F.array().cast("array<double>")), inb)
    d = d.withColumn("_h", hist)
    d = d.withColumns({"_p1": F.try_element_at("_h", F.lit(-1)), "_p2": F.try_element_at("_h", F.lit(-2)),
                       "_p3": F.try_element_at("_h", F.lit(-3)), "_n": F.col("_cn") + F.col("_in")})
    return d.drop("_bk", "_i1", "_i2", "_i3", "_in", "_carry", "_cn", "_h")


def online_lags(df: DataFrame, value: str, key="series_key", order="ts",
                bucket_seconds: int | None = 86400) -> DataFrame:
    """Ingest-time lag features from the observation history, zero fallback:
    lag_k = k-th previous observation or 0; rolling_3 = mean of the last three
    if three exist else lag_1; change = lag_1 - lag_2.
    """
    d = _history_lags(df, value, key, order, bucket_seconds)
    l1, l2, l3 = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("_p1", "_p2", "_p3"))
    d = d.withColumns({
        f"{value}_lag_1": l1, f"{value}_lag_2": l2, f"{value}_lag_3": l3,
        f"{value}_rolling_mean_3": F.when(F.col("_n") >= 3, (F.col("_p1") + F.col("_p2") + F.col("_p3")) / 3.0)
                                    .otherwise(l1),
        f"{value}_change": l1 - l2,
    })
    return d.drop("_p1", "_p2", "_p3", "_n")


def online_lags_cascade(df: DataFrame, value: str, key="series_key", order="ts",
                        bucket_seconds: int | None = 86400) -> DataFrame:
    """Variant: lag2 falls back to lag1, lag3 to lag2; rolling mean over what
    exists (0 if nothing); trend 0 with fewer than two observations."""
    d = _history_lags(df, value, key, order, bucket_seconds)
    n = F.col("_n")
    l1 = F.coalesce(F.col("_p1"), F.lit(0.0))
    l2 = F.when(n >= 2, F.col("_p2")).otherwise(l1)
    d = d.withColumns({f"{value}_lag_1": l1, f"{value}_lag_2": l2})
    l2c = F.col(f"{value}_lag_2")
    d = d.withColumns({
        f"{value}_lag_3": F.when(n >= 3, F.col("_p3")).otherwise(l2c),
        f"{value}_rolling_mean_3": F.when(n == 0, F.lit(0.0))
        .when(n == 1, F.col("_p1"))
        .when(n == 2, (F.col("_p1") + F.col("_p2")) / 2.0)
        .otherwise((F.col("_p1") + F.col("_p2") + F.col("_p3")) / 3.0),
        f"{value}_trend": F.when(n < 2, F.lit(0.0)).otherwise(l1 - l2c),
    })
    return d.drop("_p1", "_p2", "_p3", "_n")


# --- W16 / W17 ---------------------------------------------------------------
def fallback_priority(df: DataFrame, group, priority: str, usable: Column | str,
                      order: str = "ts", tiebreak: str | None = None) -> DataFrame:
    """Per group, the newest usable reading of the best-priority source.

    An aggregate (``min_by`` over a (priority, -time) key): partially
    aggregated, so a group holding a third of all rows still reduces map-side.
    """
    keys = _keys(group)
    ok = F.col(usable) if isinstance(usable, str) else usable
    others = [c for c in df.columns if c not in keys]
    # best = lowest priority number, then newest time, then highest tiebreak
    rank_key = [-F.col(priority), F.col(order)] + ([F.col(tiebreak)] if tiebreak else [])
    picked = (df.where(ok).groupBy(*keys)
              .agg(F.max_by(F.struct(*others), F.struct(*rank_key)).alias("_r")))
    return picked.select(*keys, "_r.*")


def live_or_latest(df: DataFrame, live: str, key="series_key", order="ts",
                   name: str | None = None, bucket_seconds: int | None = 86400) -> DataFrame:
    """Live value where present, else the last known value of the series.

    Skew-safe like ``online_lags``: a running window per (key, time bucket)
    plus the last value of earlier buckets carried in from a per-bucket table.
    """
    keys = _keys(key)
    order_cols = [order] if isinstance(order, str) else list(order)
    d = df.withColumn("_bk", _time_bucket(df, order, bucket_seconds))
    w = Window.partitionBy(*keys, "_bk").orderBy(*order_cols).rowsBetween(UNB, 0)
    d = d.withColumn("_inb", F.last(live, ignorenulls=True).over(w))
    last_obs = F.max_by(F.col(live), F.when(F.col(live).isNotNull(), F.struct(*order_cols)))
    summ = d.groupBy(*keys, "_bk").agg(last_obs.alias("_lb"))
    wk = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(UNB, -1)
    carry = summ.select(*keys, "_bk", F.last("_lb", ignorenulls=True).over(wk).alias("_carry"))
    d = d.join(carry, [*keys, "_bk"], "left")
    return d.withColumn(name or f"{live}_or_latest", F.coalesce("_inb", "_carry")).drop("_bk", "_inb", "_carry")
