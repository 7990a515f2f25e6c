"""Model artefacts and run records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerocast.plans.trees import load_trees, save_trees
from aerocast.sources.files import _exists, append_batch


def write_manifest(doc: DataFrame, path: str) -> None:
    """IO13: write a one-row JSON document (``value`` column) as text."""
    doc.select("value").coalesce(1).write.mode("overwrite").text(path)


def read_doc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def append_run(runs: DataFrame, path: str, run_id: str | int) -> None:
    """IO15: append the records of one run (name, params json, metrics, logged_at);
    a retry of the run replaces them, so it makes no new version."""
    append_batch(runs, path, run_id)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """IO15: every run with its version per model name (1, 2, ... in log order)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "name string, version int, mae double, rmse double, r2 double, "
                                         "logged_at string, run_id bigint")
    log = spark.read.parquet(path)
    w = Window.partitionBy("name").orderBy("logged_at", "run_id")
    return log.withColumn("version", F.row_number().over(w))


def save_ridge(spark: SparkSession, model: dict, path: str) -> None:
    """IO16: a linear champion as a coefficient table."""
    rows = [("__intercept__", float(model["intercept"]))] + list(zip(model["features"], map(float, model["coef"])))
    spark.createDataFrame(rows, "feature string, coef double").coalesce(1).write.mode("overwrite").parquet(path)
    spark.createDataFrame([(json.dumps({k: v for k, v in model.items() if k not in ("coef", "features")}),)],
                          "meta string").coalesce(1).write.mode("overwrite").json(path + "_meta")


def load_ridge(spark: SparkSession, path: str) -> dict:
    rows = {r["feature"]: r["coef"] for r in spark.read.parquet(path).collect()}  # bounded: one row per feature
    icpt = rows.pop("__intercept__")
    return {"intercept": icpt, "features": list(rows), "coef": [rows[f] for f in rows]}


def save_champions(champions: dict, deltas: dict, path: str) -> None:
    """IO16: every horizon's champion (linear: coefficients, trees: nodes) under ``path``, and the list of them last."""
    rows = []
    spark = None
    for horizon, c in champions.items():
        spark = spark or c.oof.sparkSession
        if c.kind == "ridge":
            save_ridge(spark, c.model, f"{path}/{horizon}")
        else:
            save_trees(c.model, f"{path}/{horizon}")
        rows.append((horizon, c.name, c.kind, bool(deltas[horizon])))
    spark.createDataFrame(rows, "horizon string, name string, kind string, is_delta boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/champions")


def load_champions(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(horizon -> champion, horizon -> whether it predicts a change), as stored."""
    from aerocast.plans.tournament import CandidateResult
    champions, deltas = {}, {}
    for r in spark.read.parquet(f"{path}/champions").collect():  # one row a horizon
        model = load_ridge(spark, f"{path}/{r['horizon']}") if r["kind"] == "ridge" else load_trees(spark, f"{path}/{r['horizon']}")
        champions[r["horizon"]] = CandidateResult(r["name"], r["kind"], float("nan"), float("nan"), float("nan"), None, model)
        deltas[r["horizon"]] = r["is_delta"]
    return champions, deltas
