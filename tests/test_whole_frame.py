"""Tree fits on every row and every value of a training frame, and models too large for one task."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocast.config import REFERENCE_RF_GRID, TOURNAMENT_SPEC, ForecastSpec, grid_points
from aerocast.plans import tournament as TN
from aerocast.plans import trees as TR

POINT = {"numTrees": 3, "maxDepth": 2, "minInstancesPerNode": 1, "featureSubsetStrategy": "all"}


def many_rows(spark, n=20_600, series=6):
    """``n`` rows of a few series; ``a`` steps the target at 137 of its 500 values, ``b`` is noise."""
    df = spark.range(n).select(F.concat(F.lit("s"), F.col("id") % series).alias("series_key"), F.date_add(F.lit("2015-01-01"), (F.col("id") / series).cast("int")).alias("date"),
                               (F.xxhash64("id") % 500).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 1000).cast("double").alias("b"))
    df = df.withColumns({"a": F.abs("a"), "target": F.when(F.abs("a") <= 137, 1.0).otherwise(5.0), "weight": F.lit(1.0), "base_pred": F.lit(0.0)})
    days = (n - 1) // series + 1
    block = F.floor(F.datediff("date", F.lit("2015-01-01")) * 6 / days).cast("int")
    return df.withColumns({"true_level": F.col("target"), "block": block})


def two_features(monkeypatch, **kw):
    spec = dataclasses.replace(ForecastSpec(), features=dataclasses.replace(ForecastSpec().features, target="target"), **kw)
    monkeypatch.setattr(type(spec.features), "feature_cols", lambda self: ["a", "b"])
    return spec


def test_fits_see_every_row(spark, monkeypatch):
    df = many_rows(spark).cache()
    spec = two_features(monkeypatch, rf_grid=(POINT,))
    f = TN._frame(df, spec)
    assert f.whole and len(f.target) == df.count() == 20_600 and spec.fit_rows is None
    # a bagged tree draws as many rows as there are, so that is its root's weight
    roots = TR.forest_nodes(f, spark, POINT, [6], 42).where("node = 0").select("weight").collect()
    assert [r.weight for r in roots] == [20_600.0] * 3
    found = TN.run_forest(df, spec, False)
    tested = df.where("block > 0")
    assert found.oof.count() == tested.count() and found.oof.join(tested, ["series_key", "date"]).where("abs(oof_level - target) > 1e-9").count() == 0
    assert found.mae == pytest.approx(0, abs=1e-9)
    first = TR.boosted(f, np.arange(20_600), {"maxIter": 1, "maxDepth": 1, "stepSize": 1.0, "minInstancesPerNode": 1, "patience": 9}, 42)[1][0]
    assert first.weight[0] == (f.order <= np.unique(f.order)[int(0.9 * len(np.unique(f.order))) - 1]).sum()


def test_a_feature_is_cut_between_any_two_values(spark):
    df = many_rows(spark, 3_000)
    f = TR.training_frame(df, "series_key", "date", ["a", "b"])
    values = sorted(r.a for r in df.select("a").distinct().collect())
    assert f.edges[0].tolist() == values[:-1] and f.bins[:, 0].max() == len(values) - 1
    node = TR.forest_nodes(f, spark, {**POINT, "numTrees": 1, "maxDepth": 1}, [6], 42).where("node = 0").first()
    assert node.feature == 0 and max(v for v in values if v <= node.threshold) <= 137 < min(v for v in values if v > node.threshold)


def test_columns_read_apart_give_the_same_frame(spark, monkeypatch):
    df = many_rows(spark, 900).cache()
    f = TR.training_frame(df, "series_key", "date", ["a", "b"])
    monkeypatch.setattr(TR, "READ_VALUES", 1)
    g = TR.training_frame(df, "series_key", "date", ["a", "b"])
    for x in ("bins", "target", "weight", "block", "order"):
        assert np.array_equal(getattr(f, x), getattr(g, x))
    assert all(np.array_equal(x, y) for x, y in zip(f.edges, g.edges, strict=True))


def test_repeated_keys_are_scored_row_by_row(spark, monkeypatch):
    df = many_rows(spark, 600)
    df = df.unionByName(df.withColumn("series_key", F.lit(None).cast("string"))).unionByName(df.withColumn("a", F.col("a") + 1)).cache()
    spec = two_features(monkeypatch, rf_grid=(POINT, {**POINT, "maxDepth": 1}))
    assert TN.run_forest(df, spec, False).oof.count() == df.where("block > 0").count() == 1_494


def test_wide_codes_split_alike():
    rng = np.random.default_rng(3)
    X = rng.integers(0, 300, (400, 3))
    y, w = rng.normal(size=400) + (X[:, 1] > 140), rng.uniform(0.5, 2, 400)
    a, b = (TR.grow(x, y, w, np.ones(400, int), np.random.default_rng(0), 6, 1, 2) for x in (X.astype(np.uint16), X << 42))
    assert np.array_equal(a.feature, b.feature) and np.array_equal(a.value, b.value) and np.array_equal(a.bin << 42, b.bin)


def test_a_large_model_scores_by_blocks_of_trees(spark, monkeypatch):
    df = many_rows(spark, 700).withColumn("a", F.when(F.col("b") > 20, F.col("a"))).cache()
    f = TR.training_frame(df.dropna(), "series_key", "date", ["a", "b"])
    setting = {"maxIter": 9, "maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 1, "patience": 9}
    for nodes in (TR.forest_nodes(f, spark, {**POINT, "numTrees": 7}, [6], 42).drop("fold").cache(), TR.boosted_nodes(f, spark, [setting], [6], 42).drop("setting", "fold").cache()):
        whole = TR.score_trees(df, nodes, ["a", "b"], "p")
        with monkeypatch.context() as m:
            for name, value in (("MODEL_NODES", 3), ("BLOCK_NODES", 12), ("BLOCK_ROWS", 150)):
                m.setattr(TR, name, value)
            apart = TR.score_trees(df, nodes, ["a", "b"], "q")
        assert apart.columns == [*df.columns, "q"] and apart.count() == 700
        both = whole.join(apart.select("series_key", "date", "q"), ["series_key", "date"])
        assert both.count() == 700 and both.where("q IS NULL OR abs(p - q) > 1e-9").count() == 0


def test_the_registered_tournament_searches_all_forests():
    assert TOURNAMENT_SPEC.rf_grid == grid_points(REFERENCE_RF_GRID) and len(TOURNAMENT_SPEC.rf_grid) == 24 and TOURNAMENT_SPEC.fit_rows is None
