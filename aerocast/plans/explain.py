"""Monte-Carlo (permutation-sampling) Shapley attributions for any champion
(SURVEY M18, J8).

For a sampled row x, feature j and sample m: draw a permutation and a
background row z; x+ takes x on the features before j and on j, z elsewhere;
x- is the same with z on j. phi_j is the mean of f(x+) - f(x-) over m.

Spark plan: the explained rows and the background are seeded hash samples
(bounded by their sizes, the feature of this operator); each explained row
fans out to features x samples (a bounded generator), picks its background row
by a hashed index from the background, one array of at most n_background rows, and
all hybrid rows are scored in one bulk ``transform`` - no cross join, nothing
proportional to the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast.operators.setops import key_hash, sample_seeded


def sampled_shapley(feats: DataFrame, id_cols: Sequence[str], feature_cols: Sequence[str], score,
                    n_rows: int = 150, n_background: int = 50, n_samples: int = 10,
                    seed: int = 42) -> DataFrame:
    """(id_cols..., feature, attribution). ``score(df, name)`` must add a
    prediction column ``name`` computed from ``feature_cols``."""
    ids, cols = list(id_cols), list(feature_cols)
    rows = sample_seeded(feats.select(*ids, *cols), ids, n_rows, seed)
    bg = sample_seeded(feats.select(*ids, *cols), ids, n_background, seed + 1)
    # at most n_background rows, held as one array that every task gets
    bg = bg.orderBy(*ids).groupBy(F.lit(0).alias("_g")).agg(
        F.sort_array(F.collect_list(F.struct(*ids, *[F.col(c).alias(f"_z_{c}") for c in cols]))).alias("_bg"))
    pairs = F.explode(F.arrays_zip(
        F.flatten(F.array_repeat(F.sequence(F.lit(0), F.lit(len(cols) - 1)), n_samples)).alias("j"),
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)),
                              lambda m: F.array_repeat(m, len(cols)))).alias("m")))
    fan = rows.select(*ids, *cols, pairs.alias("_jm")).select(*ids, *cols, "_jm.j", "_jm.m")
    j = fan.withColumn("_g", F.lit(0)).join(F.broadcast(bg), "_g")
    # draws are taken modulo the rows that are there, which may be fewer than asked for
    draw = F.conv(F.substring(key_hash([*ids, "m"], seed), 1, 8), 16, 10).cast("long")
    z = F.element_at("_bg", (F.pmod(draw, F.size("_bg")) + 1).cast("int"))
    j = j.withColumn("_z", z).select(*ids, *cols, "j", "m", *[F.col(f"_z._z_{c}").alias(f"_z_{c}") for c in cols])

    def rank(k):
        return F.xxhash64(*[F.col(i) for i in ids], F.col("m"), F.lit(k), F.lit(seed + 2))
    rj = F.element_at(F.array(*[rank(k) for k in range(len(cols))]), F.col("j") + 1)
    plus, minus = {}, {}
    for k, c in enumerate(cols):
        before = rank(k) < rj
        plus[c] = F.when(before | (F.col("j") == k), F.col(c)).otherwise(F.col(f"_z_{c}"))
        minus[c] = F.when(before & (F.col("j") != k), F.col(c)).otherwise(F.col(f"_z_{c}"))
    both = (j.select(*ids, "j", "m", F.lit(1.0).alias("_sign"), *[plus[c].alias(c) for c in cols])
            .unionByName(j.select(*ids, "j", "m", F.lit(-1.0).alias("_sign"), *[minus[c].alias(c) for c in cols])))
    scored = score(both, "_f")
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("j") + 1)
    return (scored.groupBy(*ids, "j").agg((F.sum(F.col("_sign") * F.col("_f")) / n_samples).alias("attribution"))
            .select(*ids, names.alias("feature"), "attribution"))
