"""Joins.

No join carries a broadcast hint: Spark picks a broadcast by its own size limit
in bytes, from statistics or, with AQE, from the sizes measured at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerocast.operators.windows import UNB


def _on(on):
    return [on] if isinstance(on, str) else list(on)


# --- J1 / J3 / J7 ------------------------------------------------------------
def join_daily(left: DataFrame, right: DataFrame, on="date") -> DataFrame:
    return left.join(right, _on(on), "inner")


def map_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], value: str,
               name: str | None = None) -> DataFrame:
    """Attach ``value`` from ``lookup`` by key, NULL where absent (left join)."""
    lk = lookup.select(*_on(on), F.col(value).alias(name or value))
    return df.join(lk, _on(on), "left")


def enrich(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Dimension enrichment."""
    return df.join(dim, _on(on), "left")


# --- J2 ------------------------------------------------------------------------
def join_loss(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of each side without a partner. Both sides are first reduced to
    (key, rows) so a hot key never multiplies; one full-outer join over the
    distinct keys then counts the unmatched rows of each side."""
    keys = _on(on)
    lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    j = lc.join(rc, keys, "full_outer")
    return j.agg(
        F.coalesce(F.sum(F.when(F.col("_r").isNull(), F.col("_l"))), F.lit(0)).cast("bigint").alias("left_unmatched"),
        F.coalesce(F.sum(F.when(F.col("_l").isNull(), F.col("_r"))), F.lit(0)).cast("bigint").alias("right_unmatched"),
        F.coalesce(F.sum("_l"), F.lit(0)).cast("bigint").alias("left_rows"),
        F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("right_rows"))


# --- J4 ------------------------------------------------------------------------
def positions(df: DataFrame, key, order, bucket=None, name: str = "pos") -> DataFrame:
    """1-based position of each row within its key in ``order``.

    With ``bucket`` (a column non-decreasing in ``order``, e.g. the day of a
    timestamp) the numbering runs per (key, bucket) and is offset by the row
    count of earlier buckets from a small per-bucket table, so a key holding a
    third of all rows is numbered by many tasks instead of one.
    """
    keys = _on(key)
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_on(order))))
    d = df.withColumn("_bk", bucket)
    d = d.withColumn("_rb", F.row_number().over(Window.partitionBy(*keys, "_bk").orderBy(*_on(order))))
    cnt = d.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    off = cnt.select(*keys, "_bk", F.coalesce(F.sum("_c").over(
        Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    d = d.join(off, [*keys, "_bk"])
    return d.withColumn(name, F.col("_off") + F.col("_rb")).drop("_bk", "_rb", "_off")


def zip_positional(left: DataFrame, right: DataFrame, key, left_order, right_order,
                   left_bucket=None, right_bucket=None) -> DataFrame:
    """Pair the i-th row of each side within a key (join on (key, position);
    positions are unique per side, so the join itself never skews)."""
    keys = _on(key)
    return (positions(left, keys, left_order, left_bucket)
            .join(positions(right, keys, right_order, right_bucket), [*keys, "pos"], "inner"))


# --- J5 ------------------------------------------------------------------------
def join_asof(left: DataFrame, right: DataFrame, key, left_time: str, right_time: str,
              right_cols: Sequence[str], bucket_seconds: int = 86400, prefix: str = "r_") -> DataFrame:
    """Each left row with the latest right row at or before its time (same key).

    Skew-safe: matching runs per (key, time bucket) instead of per key; a left
    row whose bucket has no earlier right row takes the last right row of the
    latest earlier bucket, found on a small per-bucket table.
    """
    keys = _on(key)
    lt = F.unix_micros(F.col(left_time).cast("timestamp"))
    rt = F.unix_micros(F.col(right_time).cast("timestamp"))
    per = bucket_seconds * 1_000_000
    payload = [F.col(c).alias(prefix + c) for c in right_cols]
    rpay = F.struct(F.col(right_time).alias(prefix + right_time), *payload)
    L = left.withColumns({"_t": lt, "_b": F.floor(lt / per), "_side": F.lit(1)})
    R = right.select(*keys, rt.alias("_t"), F.floor(rt / per).alias("_b"), F.lit(0).alias("_side"),
                     rpay.alias("_rp"))
    U = L.unionByName(R, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(UNB, 0)
    U = U.withColumn("_m", F.last("_rp", ignorenulls=True).over(w))
    matched = U.where(F.col("_side") == 1).drop("_rp", "_side")
    # carry-in: last right row of each earlier bucket, per key (one row per bucket)
    rb = R.groupBy(*keys, "_b").agg(F.max_by("_rp", F.struct("_t")).alias("_last"))
    lb = matched.where(F.col("_m").isNull()).select(*keys, "_b").distinct().withColumn("_o", F.lit(0))
    cb = lb.unionByName(rb.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    # a left bucket sorts before the right rows of the same bucket (all later than it)
    wc = Window.partitionBy(*keys).orderBy("_b", "_o").rowsBetween(UNB, -1)
    carry = (cb.withColumn("_carry", F.last("_last", ignorenulls=True).over(wc))
             .where(F.col("_last").isNull()).select(*keys, "_b", "_carry"))
    out = (matched.join(carry, [*keys, "_b"], "left")
           .withColumn("_m", F.coalesce("_m", "_carry")))
    return out.select(*left.columns, "_m.*")


# --- J6 ------------------------------------------------------------------------
def alert_antijoin(new_alerts: DataFrame, log: DataFrame,
                   keys: Sequence[str] = ("forecast_date", "predicted_aqi"),
                   first_by: str = "logged_at") -> DataFrame:
    """Append alerts whose key is not yet logged (threshold is not part of the
    key); a key arriving twice in one batch is logged once (its earliest row)."""
    fresh = fresh_alerts(new_alerts, log, keys, first_by)
    return log.unionByName(fresh.select(*log.columns))


def fresh_alerts(new_alerts: DataFrame, log: DataFrame, keys: Sequence[str], first_by: str) -> DataFrame:
    """The earliest row of each key that the log does not hold."""
    keys = list(keys)
    others = [c for c in new_alerts.columns if c not in keys]
    fresh = (new_alerts.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(first_by)).alias("_a"))
             .select(*keys, "_a.*"))
    return fresh.join(log.select(*keys).distinct(), keys, "left_anti")
