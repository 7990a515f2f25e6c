"""Weighted ridge on per-block Gramians.

Data never reaches the driver: each block's weighted mean is one aggregation,
then ``mapInPandas`` folds every partition into centred cross-products with
NumPy and Spark sums them per block (a few thousand small rows, whatever the
row count). The driver merges blocks with the parallel-combination formula
(numerically stable: centred, no raw sum-of-squares cancellation) and solves
(p x p) systems for every fold and every alpha. One more Spark pass scores all
folds x alphas at once.

Model per fold (standard scaler fit on the training rows, then weighted ridge
with intercept): with train weighted means (xbar, ybar), population std ``sd``
and weighted centred Gramian C,
    b_z = (D C_xx D + alpha I)^-1 D C_xy,  D = diag(1/sd)
    pred = ybar + ((x - xbar) / sd) . b_z
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class BlockStats:
    """Sufficient statistics of one set of rows over columns [x..., y]."""
    w: float          # sum of weights
    n: float          # row count
    wmean: np.ndarray  # weighted means
    C: np.ndarray     # weighted centred cross-products
    mean: np.ndarray  # unweighted means
    m2: np.ndarray    # unweighted centred sums of squares (diagonal only)

    def merge(self, o: "BlockStats") -> "BlockStats":
        if self.w == 0:
            return o
        if o.w == 0:
            return self
        w = self.w + o.w
        d = o.wmean - self.wmean
        C = self.C + o.C + np.outer(d, d) * (self.w * o.w / w)
        n = self.n + o.n
        du = o.mean - self.mean
        m2 = self.m2 + o.m2 + du * du * (self.n * o.n / n)
        return BlockStats(w, n, self.wmean + d * (o.w / w), C, self.mean + du * (o.n / n), m2)


def _empty(p):
    return BlockStats(0.0, 0.0, np.zeros(p), np.zeros((p, p)), np.zeros(p), np.zeros(p))


def block_gramians(df: DataFrame, cols: Sequence[str], target: str, weight: str,
                   block: str = "block") -> dict[int, BlockStats]:
    """Per-block weighted centred Gramian of [cols..., target] plus the
    unweighted moments a scaler needs. Rows with any NULL are skipped."""
    allc = [*cols, target]
    p = len(allc)
    src = df.select(F.col(block).cast("int").alias("_b"), F.col(weight).cast("double").alias("_w"),
                    *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(allc)]).dropna()
    means = src.groupBy("_b").agg(
        F.sum("_w").alias("_sw"), F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col("_w") * F.col(f"c{i}")).alias(f"w{i}") for i in range(p)],
        *[F.avg(f"c{i}").alias(f"u{i}") for i in range(p)]).collect()
    info = {}
    for r in means:
        sw = r["_sw"]
        info[int(r["_b"])] = (sw, int(r["_n"]), np.array([r[f"w{i}"] / sw for i in range(p)]),
                              np.array([r[f"u{i}"] for i in range(p)]))
    centres = {b: (v[2], v[3]) for b, v in info.items()}
    cnames = [f"c{i}" for i in range(p)]

    def partial(it):
        acc = {}
        for pdf in it:
            for b, g in pdf.groupby("_b"):
                wm, um = centres[int(b)]
                X = g[cnames].to_numpy(dtype=np.float64)
                w = g["_w"].to_numpy(dtype=np.float64)
                Xc = X - wm
                C = (Xc * w[:, None]).T @ Xc
                U = ((X - um) ** 2).sum(axis=0)
                a = acc.get(int(b))
                acc[int(b)] = (C, U) if a is None else (a[0] + C, a[1] + U)
        rows = []
        for b, (C, U) in acc.items():
            ii, jj = np.triu_indices(p)
            rows.append(pd.DataFrame({"_b": b, "kind": "c", "i": ii, "j": jj, "v": C[ii, jj]}))
            rows.append(pd.DataFrame({"_b": b, "kind": "u", "i": np.arange(p), "j": np.arange(p), "v": U}))
        if rows:
            yield pd.concat(rows, ignore_index=True)

    schema = "_b int, kind string, i long, j long, v double"
    sums = (src.mapInPandas(partial, schema).groupBy("_b", "kind", "i", "j").agg(F.sum("v").alias("v"))
            .collect())
    out = {}
    for b, (sw, n, wm, um) in info.items():
        out[b] = BlockStats(sw, float(n), wm, np.zeros((p, p)), um, np.zeros(p))
    for r in sums:
        st = out[int(r["_b"])]
        i, j = int(r["i"]), int(r["j"])
        if r["kind"] == "c":
            st.C[i, j] = r["v"]
            st.C[j, i] = r["v"]
        else:
            st.m2[i] = r["v"]
    return out


def gramian_table(df: DataFrame, cols: Sequence[str], target: str, weight: str, block: str = "block") -> DataFrame:
    """A23 as a DataFrame: (block, a, b, value) of the weighted centred Gramian."""
    stats = block_gramians(df, cols, target, weight, block)
    names = [*cols, target]
    rows = [(int(b), names[i], names[j], float(st.C[i, j]))
            for b, st in sorted(stats.items()) for i in range(len(names)) for j in range(len(names))]
    return df.sparkSession.createDataFrame(rows, "block int, a string, b string, value double")


def merged(stats: dict[int, BlockStats], blocks: Sequence[int], p: int) -> BlockStats:
    acc = _empty(p)
    for b in sorted(blocks):
        if b in stats:
            acc = acc.merge(stats[b])
    return acc


def solve(st: BlockStats, alpha: float) -> tuple[float, np.ndarray]:
    """Ridge on standardised features -> (intercept, coef) in the raw x space."""
    p = len(st.wmean) - 1
    sd = np.sqrt(st.m2[:p] / max(st.n, 1.0))
    sd = np.where(sd < 10 * np.finfo(np.float64).eps, 1.0, sd)
    D = 1.0 / sd
    Czz = st.C[:p, :p] * np.outer(D, D)
    Czy = st.C[:p, p] * D
    bz = np.linalg.solve(Czz + alpha * np.eye(p), Czy)
    beta = bz * D
    intercept = st.wmean[p] - float(st.wmean[:p] @ beta)
    return intercept, beta


def predict_expr(cols: Sequence[str], intercept_col: str = "_icpt", coef_col: str = "_coef"):
    expr = F.col(intercept_col)
    for i, c in enumerate(cols):
        expr = expr + F.col(c) * F.element_at(F.col(coef_col), i + 1)
    return expr


def fit_ridge(stats: dict[int, BlockStats], alpha: float, p: int) -> tuple[float, np.ndarray]:
    return solve(merged(stats, list(stats), p + 1), alpha)


def ridge_fold_predictions(df: DataFrame, cols: Sequence[str], target: str, weight: str,
                           alphas: Sequence[float], n_splits: int, block: str = "block"):
    """Fit every (fold, alpha) from the Gramians and score every test block in
    one pass. Returns (preds DataFrame with columns [block, alpha_idx, pred] +
    df columns, stats)."""
    stats = block_gramians(df, cols, target, weight, block)
    p = len(cols)
    coef_rows = []
    for k in range(1, n_splits + 1):
        if k not in stats:
            continue
        train = merged(stats, [b for b in stats if b < k], p + 1)
        if train.n == 0:
            continue
        for ai, a in enumerate(alphas):
            icpt, beta = solve(train, a)
            coef_rows.append((k, ai, float(icpt), [float(x) for x in beta]))
    spark = df.sparkSession
    coefs = spark.createDataFrame(coef_rows, "block int, alpha_idx int, _icpt double, _coef array<double>")
    # bounded: n_splits x len(alphas) rows
    scored = df.join(F.broadcast(coefs), block).withColumn("pred", predict_expr(cols)).drop("_icpt", "_coef")
    return scored, stats
