"""Aggregations and profiling.

Everything here is a hash aggregation (partial + final, so a hot key is
reduced map-side) or a generator followed by one; exact quantiles go through
``aerocast.plans.quantiles`` which never holds a whole group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerocast.config import RANGE_EDGES
from aerocast.operators.schema import nan_to_null

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns whose type is numeric (read from the schema, no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def _clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN -> NULL in the fractional ones of ``cols``: to every profile a NaN is a missing value, as to pandas."""
    fractional = [c for c in cols if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return nan_to_null(df, fractional) if fractional else df


def _present(c: str):
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


# --- A1 ------------------------------------------------------------------------
def daily_mean(df: DataFrame, cols: Sequence[str], key="series_key", time="ts", date="date") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    # NaN counts as missing, or one reading would poison the whole day
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return (df.groupBy(*keys, F.to_date(time).alias(date))
            .agg(*[F.avg(value(c)).alias(c) for c in cols]))


# --- A2 / A4 -------------------------------------------------------------------
def describe(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    from aerocast.plans.quantiles import quantile_columns
    by = list(by)
    keys = by or ["_g"]
    d = _clean(df, [col])
    d = d if by else d.withColumn("_g", F.lit(0))
    base = d.groupBy(*keys).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    q = quantile_columns(d, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys)
    out = base.join(q, keys, "left")
    return out.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def kpi_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    d = describe(df, col, by)
    return d.select(*by, "mean", F.col("p50").alias("median"), "std", "min", "max")


# --- A3 ------------------------------------------------------------------------
def range_counts(df: DataFrame, col: str, edges: Sequence[float] = RANGE_EDGES) -> DataFrame:
    """Counts in [-inf, e1), [e1, e2), ..., [ek, inf) (closed on the left); NULL and NaN are in none."""
    df = _clean(df, [col])
    c = F.col(col)
    aggs = [F.count_if(c < edges[0]).alias(f"n_lt_{edges[0]}")]
    for lo, hi in zip(edges, edges[1:]):
        aggs.append(F.count_if((c >= lo) & (c < hi)).alias(f"n_{lo}_{hi}"))
    aggs.append(F.count_if(c >= edges[-1]).alias(f"n_{edges[-1]}_plus"))
    return df.agg(*aggs)


# --- A14 -----------------------------------------------------------------------
def unpivot_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                 var: str = "feature", value: str = "value") -> DataFrame:
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(list(ids), list(cols), var, value)


# --- A5 ------------------------------------------------------------------------
def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] per column, last bin closed.
    Rows (feature, bin, lo, hi, count) for non-empty bins."""
    long = unpivot_long(df, [], cols).where(_present("value"))
    rng = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = long.join(F.broadcast(rng), "feature")  # one row per listed column: bounded by len(cols)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)))
    j = j.withColumn("bin", b.cast("bigint"))
    return (j.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.first(F.col("_lo") + F.col("bin") * width).alias("lo"),
        F.first(F.col("_lo") + (F.col("bin") + 1) * width).alias("hi")))


# --- A6 ------------------------------------------------------------------------
def kde(df: DataFrame, col: str, grid_points: int = 200) -> DataFrame:
    """Gaussian density on an evenly spaced grid over [min, max] with
    bandwidth std * n^(-1/5). Every task adds up its rows' contributions to the
    grid with NumPy and sends ``grid_points`` sums; nothing is fanned out."""
    v = df.select(F.col(col).cast("double").alias("v")).where(_present("v"))
    # four numbers, whatever the data
    st = v.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    schema = "grid bigint, s double"
    if not st["n"] or not st["sd"]:
        return df.sparkSession.createDataFrame([], "grid bigint, x double, density double")
    n, bw, lo = st["n"], st["sd"] * st["n"] ** -0.2, st["lo"]
    step = (st["hi"] - lo) / (grid_points - 1)

    def partial(batches):
        x = lo + np.arange(grid_points) * step
        sums = np.zeros(grid_points)
        for pdf in batches:
            values = pdf["v"].to_numpy()
            for at in range(0, len(values), 4096):
                z = (x[:, None] - values[None, at:at + 4096]) / bw
                sums += np.exp(-0.5 * z * z).sum(axis=1)
        yield pd.DataFrame({"grid": np.arange(grid_points), "s": sums})

    total = v.mapInPandas(partial, schema).groupBy("grid").agg(F.sum("s").alias("s"))
    return total.select("grid", (F.lit(lo) + F.col("grid") * F.lit(step)).alias("x"),
                        (F.col("s") / (n * bw * math.sqrt(2 * math.pi))).alias("density"))


# --- A7 / A8 -------------------------------------------------------------------
def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """q1/median/q3, 1.5 IQR whiskers and the outlier count per feature."""
    from aerocast.plans.quantiles import quantile_columns
    long = unpivot_long(df, [], cols).where(_present("value"))
    q = quantile_columns(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["feature"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumns({"lower": F.col("q1") - 1.5 * F.col("iqr"), "upper": F.col("q3") + 1.5 * F.col("iqr")})
    cnt = (long.join(F.broadcast(q.select("feature", "lower", "upper")), "feature")  # len(cols) rows
           .groupBy("feature").agg(F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
                                   .alias("outliers"), F.count(F.lit(1)).alias("n")))
    return q.join(cnt, "feature")


def outlier_rows(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The (ids, feature, value) cells outside the 1.5 IQR whiskers."""
    bs = box_stats(df, cols).select("feature", "lower", "upper")
    long = unpivot_long(df, ids, cols).where(_present("value"))
    j = long.join(F.broadcast(bs), "feature")  # one row per listed column
    return j.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).select(
        *ids, "feature", "value")


# --- A9 / A10 ------------------------------------------------------------------
def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing) per column plus a ``__total__`` row; one pass. NaN is missing."""
    cols = list(cols or df.columns)
    df = _clean(df, cols)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "missing")
    total = wide.select(F.lit("__total__").alias("column"),
                        sum((F.col(c) for c in cols), F.lit(0)).alias("missing"))
    return long.unionByName(total).withColumn("missing", F.col("missing").cast("bigint"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: (column, dtype, is_numeric) plus table-level
    row/column/numeric counts repeated on each row."""
    spark = df.sparkSession
    fields = [(f.name, f.dataType.simpleString(), isinstance(f.dataType, NUMERIC)) for f in df.schema.fields]
    meta = spark.createDataFrame(fields, "column string, dtype string, is_numeric boolean")
    n = df.groupBy(F.lit(0).alias("_g")).agg(F.count(F.lit(1)).alias("rows"))
    out = meta.withColumn("_g", F.lit(0)).join(F.broadcast(n), "_g").drop("_g")
    return out.withColumns({"n_columns": F.lit(len(fields)).cast("bigint"),
                            "n_numeric": F.lit(sum(1 for f in fields if f[2])).cast("bigint")})


# --- A11 / A12 -----------------------------------------------------------------
def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form (a, b, corr); one
    aggregation pass computes every pair."""
    cols = list(cols)
    df = _clean(df, cols)  # a pair counts where both are there
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
                    for i, (a, b) in enumerate(pairs)])
    cells = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    stack = ", ".join(f"'{a}', '{b}', `{i}`" for a, b, i in cells)
    # both halves of the symmetric matrix come from the same one-row aggregate
    return wide.selectExpr(f"stack({len(cells)}, {stack}) AS (a, b, corr)")


def corr_rank(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pairwise-complete correlation of every column with the target, ordered by |corr| desc."""
    df = _clean(df, [*cols, target])
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "feature", "corr")
    return long.withColumn("abs_corr", F.abs("corr")).orderBy(F.desc("abs_corr"), "feature")


# --- A13 -----------------------------------------------------------------------
def scatter_pairs(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str]) -> DataFrame:
    """Every (key, feature, value, target) pair of a scatter plot; pairs with a
    missing value or target are left out. Narrow: one generator, no shuffle."""
    wide = df.select(*key, F.col(target).cast("double").alias("target"), *[F.col(c).cast("double").alias(c) for c in features])
    long = wide.unpivot([*key, "target"], list(features), "feature", "value")
    return long.where(_present("value") & _present("target")).select(*key, "feature", "value", "target")


# --- A15-A21 -------------------------------------------------------------------
def forecast_summary(df: DataFrame, col: str = "predicted_aqi", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias("mean_pred"), F.max(col).alias("max_pred"),
                               F.min(col).alias("min_pred"))


def worst_day(df: DataFrame, threshold: float, col: str = "predicted_aqi", date: str = "date",
              by: Sequence[str] = ()) -> DataFrame:
    """Row with the highest forecast among those >= threshold; ties -> earliest date."""
    others = [c for c in df.columns if c not in by]
    exceeding = df.where(F.col(col) >= threshold)
    key = F.struct(F.col(col), F.unix_date(F.to_date(date)) * -1)
    return exceeding.groupBy(*by).agg(F.max_by(F.struct(*others), key).alias("_w")).select(*by, "_w.*")


def metric_avg(df: DataFrame, cols: Sequence[str] = ("mae", "rmse", "r2")) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


def regression_metrics(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 per group in a single pass (sst from sum and sum of squares
    would lose precision, so R2 uses the variance aggregate)."""
    e = F.col(actual) - F.col(pred)
    g = df.where(F.col(actual).isNotNull() & F.col(pred).isNotNull()).groupBy(*by)
    m = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
              F.var_pop(actual).alias("_var"))
    return m.select(*by, "n", "mae", F.sqrt("mse").alias("rmse"),
                    (1 - F.col("mse") / F.col("_var")).alias("r2"))


def date_range(df: DataFrame, date: str = "date", by: Sequence[str] = ("series_key",)) -> DataFrame:
    return df.groupBy(*by).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"),
                               F.count(F.lit(1)).alias("rows"))


def weight_summary(df: DataFrame, col: str = "weight", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias("min_w"), F.max(col).alias("max_w"), F.avg(col).alias("mean_w"))


def alert_count(df: DataFrame, by: str = "status") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("alerts"))


def attribution_rank(df: DataFrame, feature: str = "feature", value: str = "attribution") -> DataFrame:
    return (df.groupBy(feature).agg(F.avg(F.abs(value)).alias("mean_abs"))
            .orderBy(F.desc("mean_abs"), feature))
