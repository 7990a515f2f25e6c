"""Chained multi-horizon tournament.

Per horizon h = 1..3 the candidates (random forest, ridge, boosted trees) are
fitted with forward-chaining folds as Spark jobs. Horizon h>1 learns the
delta y(t+h) - y(t+h-1) and is reconstructed on the *upstream champion's*
out-of-fold level, never on the true previous value; rows without an upstream
prediction (its first block) are trained on but not scored. The champion
(lowest pooled MAE, first candidate on ties) feeds the next horizon.

Scale: the feature frame is cached once for all horizons; every champion OOF
frame is cut from its lineage with a reliable ``checkpoint()`` under
``spark.checkpoint.dir`` so a lost executor recomputes one horizon, not three.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocast.config import ANCHOR_STRENGTHS, ForecastSpec
from aerocast.operators.stats import regression_metrics
from aerocast.plans import folds as FO
from aerocast.plans import ridge as RG
from aerocast.plans import trees as TR
from aerocast.operators.schema import require_history
from aerocast.session import ensure_checkpoint_dir, scratch_path


@dataclass
class CandidateResult:
    name: str
    kind: str
    mae: float
    rmse: float
    r2: float
    oof: DataFrame            # key, date, oof_level
    model: Any = None
    params: dict = field(default_factory=dict)


def horizon_frame(feats: DataFrame, spec: ForecastSpec, h: int, upstream: DataFrame | None) -> DataFrame:
    fs = spec.features
    k, d = fs.key, fs.date
    df = FO.horizon_targets(feats, fs.target, h, k, d)
    df = df.dropna(subset=[*fs.feature_cols(), "target", "true_level"])
    if h == 1 or upstream is None:
        df = df.withColumn("base_pred", F.lit(0.0))
    else:
        df = df.join(upstream.select(k, d, F.col("oof_level").alias("base_pred")), [k, d], "left")
    df = FO.recency_weights(df, d, spec.half_life_days, "weight")
    return FO.ts_folds(df, spec.n_splits, k, d, "block")


def reconstruct(df: DataFrame, is_delta: bool) -> DataFrame:
    """M9: out-of-fold level; a delta is added to the upstream level (NULL where that is missing)."""
    lvl = F.col("base_pred") + F.col("pred") if is_delta else F.col("pred")
    return df.withColumn("oof_level", lvl)


def pooled_metrics(oof: DataFrame, is_delta: bool) -> tuple[float, float, float]:
    """MAE, RMSE and R2 on levels over all folds; rows without an upstream level are trained on but not scored."""
    ev = oof.where(F.col("oof_level").isNotNull())
    if is_delta:
        ev = ev.where(F.col("base_pred").isNotNull())
    r = regression_metrics(ev, "true_level", "oof_level").collect()
    if not r or r[0]["n"] == 0:
        return float("nan"), float("nan"), float("nan")
    return float(r[0]["mae"]), float(r[0]["rmse"]), float(r[0]["r2"])


def _frame(df: DataFrame, spec: ForecastSpec) -> TR.Frame:
    fs = spec.features
    return TR.training_frame(df, fs.key, fs.date, fs.feature_cols(), spec.fit_rows, spec.seed)


def run_ridge(df: DataFrame, spec: ForecastSpec, is_delta: bool, frame: TR.Frame | None = None) -> CandidateResult:
    fs = spec.features
    cols = fs.feature_cols()
    scored, stats = RG.ridge_fold_predictions(df, cols, "target", "weight", spec.alphas, spec.n_splits)
    scored = scored.cache()
    fold_mae = (scored.groupBy("alpha_idx", "block").agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("m"))
                .groupBy("alpha_idx").agg(F.avg("m").alias("score")).collect())
    scores = {int(r["alpha_idx"]): float(r["score"]) for r in fold_mae}
    best = min(sorted(scores), key=lambda i: (scores[i], i))
    # checkpointed while the scores are cached, so nothing is scored again later
    oof = reconstruct(scored.where(F.col("alpha_idx") == best), is_delta).checkpoint(eager=True)
    mae, rmse, r2 = pooled_metrics(oof, is_delta)
    scored.unpersist()
    icpt, beta = RG.fit_ridge(stats, spec.alphas[best], len(cols))
    model = {"intercept": icpt, "coef": [float(b) for b in beta], "features": cols, "alpha": spec.alphas[best]}
    return CandidateResult("Ridge", "ridge", mae, rmse, r2, oof.select(fs.key, fs.date, "oof_level", "base_pred"),
                           model, {"alpha": spec.alphas[best]})


def _scored_blocks(df: DataFrame, spec: ForecastSpec, models: dict) -> DataFrame:
    """Rows of the test blocks with the predictions of each name's fold models: block k is scored by the trees that were
    grown on the blocks before it."""
    fs = spec.features
    rows = TR.score_blocks(df.where(F.col("block").between(1, spec.n_splits)), models, fs.feature_cols())
    return rows.select(fs.key, fs.date, *models, "target", "true_level", "base_pred", "block")


def _stored(nodes: DataFrame, name: str) -> DataFrame:
    """Node tables written once to the shared folder: they are read several times and cost a fit."""
    path = scratch_path(nodes.sparkSession, name)
    nodes.write.parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)


def run_forest(df: DataFrame, spec: ForecastSpec, is_delta: bool, frame: TR.Frame | None = None) -> CandidateResult:
    """M6: the grid by mean fold MAE on the target, the first best point; fold forests of it score every row, and the
    forest on all rows is the model (a node table). The frame holds every row, so the fold forests have scored them in the
    search and are not grown again; after a fit on a sample (``fit_rows``) their node tables score all rows."""
    fs = spec.features
    spark, last = df.sparkSession, spec.n_splits + 1
    frame = frame or _frame(df, spec)
    params, sums = spec.rf_grid[0], None
    if frame.whole or len(spec.rf_grid) > 1:
        sums = _stored(TR.forest_sums(frame, spark, spec.rf_grid, spec.n_splits, spec.seed), "forest-search")
    if len(spec.rf_grid) > 1:
        searched = TR.search_errors(sums, spec.rf_grid)
        params = min(enumerate(searched), key=lambda x: (x[1][0], x[0]))[1][1]
    nodes = _stored(TR.forest_nodes(frame, spark, params, [last] if frame.whole else range(1, last + 1), spec.seed), "forest")
    if frame.whole:
        rows = TR.fold_predictions(sums, frame, params, "pred").select(fs.key, fs.date, "pred", "target", "true_level", "base_pred", "block")
    else:
        rows = _scored_blocks(df, spec, {"pred": {k: TR.Packed(nodes.where(F.col("fold") == k)) for k in range(1, last)}})
    oof = reconstruct(rows, is_delta).checkpoint(eager=True)
    mae, rmse, r2 = pooled_metrics(oof, is_delta)
    return CandidateResult("RandomForest", "trees", mae, rmse, r2, oof.select(fs.key, fs.date, "oof_level", "base_pred"),
                           nodes.where(F.col("fold") == last), params)


def run_boosted(df: DataFrame, spec: ForecastSpec, is_delta: bool, frame: TR.Frame | None = None) -> CandidateResult:
    """M7: every setting is fitted with early stopping inside each fold; pooled MAE on levels decides, the first best
    setting wins, and its fit on all rows is the model (a node table). One pass scores all settings."""
    fs = spec.features
    spark, last = df.sparkSession, spec.n_splits + 1
    frame = frame or _frame(df, spec)
    nodes = _stored(TR.boosted_nodes(frame, spark, spec.gbt_grid, range(1, last + 1), spec.seed), "boosted")
    packed = TR.packed_by(nodes.where(F.col("fold") < last), ["setting", "fold"])
    names = [f"_pred{i}" for i in range(len(spec.gbt_grid))]
    scored = _scored_blocks(df, spec, {name: {k: packed[i, k] for k in range(1, last)} for i, name in enumerate(names)}).checkpoint(eager=True)
    best = None
    for i, params in enumerate(spec.gbt_grid):
        oof = reconstruct(scored.withColumn("pred", F.col(names[i])).drop(*names), is_delta)
        metrics = pooled_metrics(oof, is_delta)
        if best is None or metrics[0] < best[0][0]:
            best = (metrics, params, oof, nodes.where(F.col("setting") == i))
    (mae, rmse, r2), params, oof, mine = best
    return CandidateResult("boosted_trees", "trees", mae, rmse, r2, oof.select(fs.key, fs.date, "oof_level", "base_pred"),
                           mine.where(F.col("fold") == last), params)


RUNNERS = {"RandomForest": run_forest, "Ridge": run_ridge, "boosted_trees": run_boosted}


@dataclass
class TournamentResult:
    comparison: DataFrame
    manifest: DataFrame
    champions: dict[str, CandidateResult]
    deltas: dict[str, bool]


def run_tournament(feats: DataFrame, spec: ForecastSpec) -> TournamentResult:
    spark = feats.sparkSession
    ensure_checkpoint_dir(spark)
    fs = spec.features
    feats = feats.select(fs.key, fs.date, fs.target, *fs.feature_cols())
    # the history gate: a series too short to train on would only add rows that no fold scores
    feats = require_history(feats, fs.key, max(1, spec.min_history_days - max(fs.lags)), fs.date).cache()
    upstream = None
    comp_rows, man_rows = [], []
    champions, deltas = {}, {}
    for hname, h in spec.horizons:
        is_delta = h > 1
        df = horizon_frame(feats, spec, h, upstream).cache()
        # each search fills the cluster by itself, so the candidates run one after the other
        frame = _frame(df, spec) if {"RandomForest", "boosted_trees"} & set(spec.candidates) else None
        results = [RUNNERS[c](df, spec, is_delta, frame) for c in spec.candidates]
        best = min(range(len(results)), key=lambda i: (np.inf if np.isnan(results[i].mae) else results[i].mae, i))
        champ = results[best]
        for r in results:
            comp_rows.append((hname, r.name, r.mae, r.rmse, r.r2, r.name == champ.name))
        man_rows.append((hname, champ.name, champ.kind, is_delta, champ.mae, champ.rmse, champ.r2,
                         "Day1 = absolute. Day2/3 = delta on the upstream champion's out-of-fold level. "
                         "Metrics on reconstructed levels."))
        champions[hname], deltas[hname] = champ, is_delta
        upstream = champ.oof.select(fs.key, fs.date, "oof_level").checkpoint(eager=True)
        df.unpersist()
    feats.unpersist()
    comparison = spark.createDataFrame(
        comp_rows, "horizon string, candidate string, mae double, rmse double, r2 double, is_champion boolean")
    manifest = spark.createDataFrame(
        man_rows, "horizon string, model_type string, kind string, is_delta boolean, mae double, rmse double, "
                  "r2 double, evaluation string")
    return TournamentResult(comparison, manifest, champions, deltas)


# --------------------------------------------------------------------- serving
def raw_prediction(champ: CandidateResult, rows: DataFrame, feature_cols, name: str) -> DataFrame:
    """Apply one champion to feature rows (node table / coefficient expression)."""
    if champ.kind == "ridge":
        m = champ.model
        expr = F.lit(float(m["intercept"]))
        for c, b in zip(m["features"], m["coef"]):
            expr = expr + F.col(c) * F.lit(float(b))
        return rows.withColumn(name, expr)
    return TR.score_trees(rows, champ.model, feature_cols, name)


def chain_score(df: DataFrame, raw1: str, d2: str, d3: str, delta2: bool = True, delta3: bool = True) -> DataFrame:
    """Raw levels from per-horizon raw outputs: day2 = day1 + delta2 when
    horizon 2 is a delta model, likewise day3 on day2."""
    r2 = F.col(raw1) + F.col(d2) if delta2 else F.col(d2)
    df = df.withColumns({"raw_day1": F.col(raw1), "raw_day2": r2})
    r3 = F.col("raw_day2") + F.col(d3) if delta3 else F.col(d3)
    return df.withColumn("raw_day3", r3)


def anchor_clamp(df: DataFrame, live: str, strengths: dict = ANCHOR_STRENGTHS) -> DataFrame:
    """Pull each raw level toward the live reading with the horizon's
    strength (unchanged without a live reading), clamp at 0, average."""
    from aerocast.functions.rules import anchor
    out = {}
    for i, hname in enumerate(("day1", "day2", "day3"), start=1):
        out[f"pred_{hname}"] = F.greatest(F.lit(0.0), anchor(f"raw_day{i}", live, strengths[hname]))
    df = df.withColumns(out)
    return df.withColumn("average_pred", (F.col("pred_day1") + F.col("pred_day2") + F.col("pred_day3")) / 3.0)


def forecast_rows(scored: DataFrame, key: str, date: str, models: dict[str, str] | None = None,
                  carry: tuple = (), covariates: DataFrame | None = None, covariate_cols: tuple = ()) -> DataFrame:
    """Three rows per series - forecast date (t+1..t+3), horizon,
    prediction, model - via an ``inline`` of a 3-element array. With
    ``covariates`` (key, date, columns) each row is paired with the expected
    covariates of its day, NULL where there are none."""
    models = models or {}
    items = [F.struct(F.lit(h).alias("horizon"), F.date_add(F.col(date), i).alias("forecast_date"),
                      F.col(f"pred_day{i}").alias("predicted"), F.lit(models.get(h)).cast("string").alias("model_used"))
             for i, h in enumerate(("day1", "day2", "day3"), start=1)]
    rows = scored.select(key, *carry, F.inline(F.array(*items)))
    if covariates is None:
        return rows
    day = covariates.select(F.col(key), F.to_date(date).alias("forecast_date"), *covariate_cols)
    return rows.join(day, [key, "forecast_date"], "left")


def scenario_inputs(baseline: DataFrame, overrides: DataFrame, key: str, cols) -> DataFrame:
    """Take override values where given, keep the baseline elsewhere
    (lag features are never overridden)."""
    ov = overrides.select(key, *[F.col(c).alias(f"_ov_{c}") for c in cols])
    j = baseline.join(ov, key, "left")
    return j.withColumns({c: F.coalesce(F.col(f"_ov_{c}"), F.col(c)) for c in cols}).drop(
        *[f"_ov_{c}" for c in cols])


def horizon_view(manifest: DataFrame, comparison: DataFrame) -> DataFrame:
    """One metric card per horizon - the champion's metrics next to the
    number of candidates it beat."""
    n = comparison.groupBy("horizon").agg(F.count(F.lit(1)).alias("candidates"))
    return manifest.select("horizon", "model_type", "mae", "rmse", "r2").join(n, "horizon")


def linear_attribution(rows: DataFrame, coefs: dict, means: dict, id_cols) -> DataFrame:
    """Exact contributions coef * (x - mean) of a linear model, long form; coefficients and means are numbers
    or, for models that differ by row, columns."""
    def value(x):
        return x if isinstance(x, Column) else F.lit(float(x))
    items = [F.struct(F.lit(c).alias("feature"), ((F.col(c) - value(means[c])) * value(b))
                      .alias("attribution")) for c, b in coefs.items()]
    return rows.select(*id_cols, F.inline(F.array(*items)))
