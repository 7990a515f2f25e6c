"""Exact, distributed quantiles (linear interpolation, ``quantile_cont``).

Spark's exact ``percentile`` keeps every distinct value of a group in one
final task. This plan keeps every step bounded instead:

1. a bounded sketch (``percentile_approx``) cuts each group's current value
   range into ``buckets`` sub-ranges;
2. exact per-bucket counts (a small table) + prefix sums locate the bucket and
   the in-bucket rank of every wanted order statistic;
3. while a located range still holds more than ``max_candidates`` rows (and
   more than one value), steps 1-2 repeat on the rows inside that value range only (each round divides the
   range population by about ``buckets``);
4. the rows inside the final ranges (a range filter against a broadcast table
   of groups x probabilities x 2 rows) are pre-aggregated to (value, count) - a
   hot value collapses to one row - and ranked inside their range.

Every row is counted exactly, so the result equals the exact quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RUNNING = (Window.unboundedPreceding, 0)


_NEG, _POS = float("-inf"), float("inf")


def _inside():
    """Value in the open-closed range (lo, hi]; lo = -inf admits everything."""
    return (((F.col("_lo") == _NEG) | (F.col("_v") > F.col("_lo"))) & (F.col("_v") <= F.col("_hi")))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    buckets: int = 64, accuracy: int = 1000, max_candidates: int = 2_000_000) -> DataFrame:
    """Rows (by..., p, q): the linear-interpolated quantile of ``value``; NULL and
    NaN do not count. Ranges are cut at least once, and on until each holds at most
    ``max_candidates`` rows or a single value."""
    keys = list(by) or ["_g"]
    v = df.select(*(list(by) or [F.lit(0).alias("_g")]), F.col(value).cast("double").alias("_v"))
    v = v.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    n = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # wanted 0-based ranks: floor and ceil of p*(n-1); each starts in the range (-inf, +inf]
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    targets = n.select(*keys, "_n", ps).withColumn("_h", F.col("p") * (F.col("_n") - 1))
    targets = targets.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
    targets = targets.select(*keys, "p", "_h", "_r", F.lit(_NEG).alias("_lo"),
                             F.lit(_POS).alias("_hi"), F.lit(0).cast("long").alias("_c0"),
                             F.col("_n").alias("_size"))
    edge_probs = [i / buckets for i in range(1, buckets)]
    limit = 0  # the first round cuts every range
    while True:
        big = targets.where(F.col("_size") > limit)
        if not big.limit(1).collect():  # the target table is groups x probabilities x 2 rows
            break
        ranges = big.select(*keys, "_lo", "_hi").distinct()
        inr = v.join(F.broadcast(ranges), keys).where(_inside())  # only rows of still-large ranges
        sk = inr.groupBy(*keys, "_lo", "_hi").agg(F.percentile_approx("_v", edge_probs, accuracy).alias("_e"))
        rb = (inr.join(F.broadcast(sk), [*keys, "_lo", "_hi"])
              .withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("_v")))))
        cnt = rb.groupBy(*keys, "_lo", "_hi", "_b").agg(F.count(F.lit(1)).alias("_c"))
        wb = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_b").rowsBetween(*_RUNNING)
        cnt = cnt.withColumn("_ce", F.sum("_c").over(wb)).withColumn("_cs", F.col("_ce") - F.col("_c"))
        cnt = cnt.join(F.broadcast(sk), [*keys, "_lo", "_hi"])
        nlo = F.when(F.col("_b") > 0, F.try_element_at("_e", F.col("_b"))).otherwise(F.col("_lo"))
        nhi = F.when(F.col("_b") < buckets - 1, F.try_element_at("_e", F.col("_b") + 1)).otherwise(F.col("_hi"))
        local = F.col("_r") - F.col("_c0")
        moved = (big.join(cnt, [*keys, "_lo", "_hi"])
                 .where((local >= F.col("_cs")) & (local < F.col("_ce")))
                 .select(*keys, "p", "_h", "_r", nlo.alias("_lo"), nhi.alias("_hi"),
                         (F.col("_c0") + F.col("_cs")).alias("_c0"),
                         # no progress (one hot value fills the range): stop refining it
                         F.when(F.col("_c") == F.col("_size"), F.lit(0)).otherwise(F.col("_c")).alias("_size")))
        # small table; a reliable checkpoint keeps the loop's lineage flat
        targets = targets.where(F.col("_size") <= limit).unionByName(moved).checkpoint(eager=True)
        limit = max_candidates
    # final ranking inside each (now small) range
    ranges = targets.select(*keys, "_lo", "_hi").distinct()
    cand = (v.join(F.broadcast(ranges), keys).where(_inside())
            .groupBy(*keys, "_lo", "_hi", "_v").agg(F.count(F.lit(1)).alias("_k")))
    wv = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v").rowsBetween(*_RUNNING)
    cand = cand.withColumn("_ke", F.sum("_k").over(wv)).withColumn("_ks", F.col("_ke") - F.col("_k"))
    local = F.col("_r") - F.col("_c0")
    picked = (targets.join(cand, [*keys, "_lo", "_hi"])
              .where((local >= F.col("_ks")) & (local < F.col("_ke"))))
    agg = picked.groupBy(*keys, "p", "_h").agg(F.min_by("_v", "_r").alias("_qlo"), F.max_by("_v", "_r").alias("_qhi"))
    q = F.col("_qlo") + (F.col("_h") - F.floor("_h")) * (F.col("_qhi") - F.col("_qlo"))
    return agg.select(*list(by), "p", q.alias("q"))


def quantile_columns(df: DataFrame, value: str, probs: dict[str, float],
                     by: Sequence[str] = ()) -> DataFrame:
    """Wide form: one column per named probability, one row per group."""
    by = list(by)
    long = exact_quantiles(df, value, list(probs.values()), by)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(name) for name, p in probs.items()]
    return long.groupBy(*by).agg(*aggs)
