"""Training-frame preparation for the forecast tournament."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerocast.config import HOLDOUT_FRACTION, HOLDOUT_SEED
from aerocast.operators.setops import key_hash


def recency_weights(df: DataFrame, date: str = "date", half_life_days: float = 75.0,
                    name: str = "weight") -> DataFrame:
    """M1: exp(-ln2 * age_days / half_life) with age measured from the newest
    date of the frame (one global max, joined back on a constant key)."""
    newest = df.groupBy(F.lit(0).alias("_g")).agg(F.max(date).alias("_newest"))
    j = df.withColumn("_g", F.lit(0)).join(F.broadcast(newest), "_g")
    age = F.datediff(F.col("_newest"), F.col(date)).cast("double")
    return j.withColumn(name, F.exp(-math.log(2) * age / half_life_days)).drop("_g", "_newest")


def horizon_targets(df: DataFrame, target: str, h: int, key: str = "series_key",
                    date: str = "date") -> DataFrame:
    """M2: true_level = y(t+h); h=1 -> target = level; h>1 -> delta
    y(t+h) - y(t+h-1). Adds ``true_level``, ``target``, ``prev_actual``."""
    w = Window.partitionBy(key).orderBy(date)
    df = df.withColumn("true_level", F.lead(target, h).over(w))
    if h == 1:
        return df.withColumns({"target": F.col("true_level"), "prev_actual": F.lit(None).cast("double")})
    df = df.withColumn("prev_actual", F.lead(target, h - 1).over(w))
    return df.withColumn("target", F.col("true_level") - F.col("prev_actual"))


def ts_folds(df: DataFrame, n_splits: int = 5, key: str = "series_key", date: str = "date",
             name: str = "block") -> DataFrame:
    """M3: forward-chaining blocks over the dates of all series together, as the
    models pool them: every row of a date is in one block, so a fold never trains
    on a date of its test block or later. With n distinct dates, a test block
    has n // (n_splits + 1) dates; the last n_splits blocks of that size are
    blocks 1..n_splits and everything before is block 0. Fold k trains on
    blocks < k and tests on block k. Fewer than n_splits + 1 dates give no test
    block: the job fails with a message rather than train without scoring.
    ``key`` is kept for callers; series of any length share the dates' blocks.
    """
    days = df.select(F.col(date).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    # one row per day of the calendar: bounded by the time span, whatever the number of readings
    w = Window.orderBy("_d")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    days = days.select("_d", (F.row_number().over(w) - 1).alias("_rn"), n.alias("_n"))
    ts = F.floor(F.col("_n") / (n_splits + 1))
    first = F.col("_n") - ts * n_splits
    block = (F.when(ts == 0, F.raise_error(F.concat(F.lit(f"{n_splits} folds need at least {n_splits + 1} dates, there are "), F.col("_n").cast("string"))).cast("int"))
             .when(F.col("_rn") < first, F.lit(0)).otherwise(F.floor((F.col("_rn") - first) / ts) + 1))
    days = days.select("_d", block.cast("int").alias(name))
    return df.join(days, F.col(date) == F.col("_d"), "left").drop("_d")


def scale_features(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M4: standardise with the *population* std of ``train`` (unweighted);
    a zero std scales by 1 (as a standard scaler does)."""
    stats = train.groupBy(F.lit(0).alias("_g")).agg(
        *[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"_s_{i}") for i, c in enumerate(cols)])
    j = df.withColumn("_g", F.lit(0)).join(F.broadcast(stats), "_g")
    out = {}
    for i, c in enumerate(cols):
        s = F.col(f"_s_{i}")
        out[c] = (F.col(c) - F.col(f"_m_{i}")) / F.when(s > 0, s).otherwise(F.lit(1.0))
    j = j.withColumns(out)
    return j.drop("_g", *[f"_m_{i}" for i in range(len(cols))], *[f"_s_{i}" for i in range(len(cols))])


def target_scale(df: DataFrame, target: str, name: str = "target_scaled") -> DataFrame:
    """Standardise the target with its sample std (1.0 if <= 1e-6);
    adds the mean/std used so predictions can be inverted."""
    stats = df.groupBy(F.lit(0).alias("_g")).agg(F.avg(target).alias("target_mean"),
                                                 F.stddev_samp(target).alias("_sd"))
    stats = stats.withColumn("target_std", F.when(F.col("_sd") > 1e-6, F.col("_sd")).otherwise(F.lit(1.0)))
    j = df.withColumn("_g", F.lit(0)).join(F.broadcast(stats.drop("_sd")), "_g").drop("_g")
    return j.withColumn(name, (F.col(target) - F.col("target_mean")) / F.col("target_std"))


def invert_target_scale(df: DataFrame, scaled: str, name: str = "target_restored") -> DataFrame:
    return df.withColumn(name, F.col(scaled) * F.col("target_std") + F.col("target_mean"))


def holdout_split(df: DataFrame, key: Sequence[str], fraction: float = HOLDOUT_FRACTION, seed: int = HOLDOUT_SEED,
                  name: str = "split") -> DataFrame:
    """Stable random split by the md5 of the key: the same row lands on the
    same side on any partitioning, any rerun and in any engine. Its first 32 bits,
    as hex text, are compared with the fraction of their range."""
    limit = min(max(fraction, 0.0), 1.0) * 16**8
    below = F.substring(key_hash(key, seed), 1, 8) < F.lit(f"{int(limit):08x}") if limit < 16**8 else F.lit(True)
    return df.withColumn(name, F.when(below, F.lit("test")).otherwise(F.lit("train")))
