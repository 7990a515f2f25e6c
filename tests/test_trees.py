"""Tree searches, node tables, stored champions and serving, on small grids."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerocast.catalog.models import _feats, serve
from aerocast.config import ForecastSpec, grid_points
from aerocast.plans import tournament as TN
from aerocast.plans import trees as TR
from aerocast.sources.models_io import load_champions, load_trees, save_champions, save_trees
from tests.conftest import SF_SMALL

GRID = grid_points({"numTrees": (6, 25), "maxDepth": (2, 5), "minInstancesPerNode": (1, 4), "featureSubsetStrategy": ("sqrt", "0.7")})
SETTINGS = ({"maxIter": 12, "maxDepth": 2, "stepSize": 0.3, "minInstancesPerNode": 3, "patience": 4}, {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1, "minInstancesPerNode": 3, "patience": 9})


def synthetic(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = 3 * (x[:, 0] > 0) + x[:, 1] + 0.1 * rng.normal(size=n)
    rows = [(f"s{i % 2}", i // 2, *map(float, x[i]), float(y[i]), float(0.5 + (i % 3)), min(5, 6 * (i // 2) // (n // 2))) for i in range(n)]
    df = spark.createDataFrame(rows, "series_key string, day int, a double, b double, c double, d double, target double, weight double, block int")
    return df.withColumns({"date": F.date_add(F.lit("2024-01-01"), F.col("day")), "true_level": F.col("target"), "base_pred": F.lit(0.0)}).drop("day")


@pytest.fixture(scope="module")
def frame(spark):
    df = synthetic(spark).cache()
    return df, TR.training_frame(df, "series_key", "date", ["a", "b", "c", "d"])


def plain_tree(X, y, w, depth, min_leaf):
    """Exhaustive weighted least-squares splits, the reference for grow() with all features."""
    best = None
    if depth and len(y) >= 2 * min_leaf:
        for f in range(X.shape[1]):
            for t in np.unique(X[:, f])[:-1]:
                m = X[:, f] <= t
                if min(m.sum(), (~m).sum()) >= min_leaf:
                    sse = sum((w[k] * (y[k] - np.average(y[k], weights=w[k])) ** 2).sum() for k in (m, ~m))
                    if best is None or sse < best[0] - 1e-9:
                        best = (sse, f, t, m)
    if best is None:
        return np.full(len(y), np.average(y, weights=w))
    out, m = np.empty(len(y)), best[3]
    out[m], out[~m] = plain_tree(X[m], y[m], w[m], depth - 1, min_leaf), plain_tree(X[~m], y[~m], w[~m], depth - 1, min_leaf)
    return out


@pytest.mark.parametrize("depth,min_leaf", [(1, 1), (3, 1), (3, 7)])
def test_grow_finds_the_best_splits(depth, min_leaf):
    rng = np.random.default_rng(5)
    X = rng.integers(0, 20, (120, 3)).astype(np.uint8)
    y, w = rng.normal(size=120) + (X[:, 1] > 9), rng.uniform(0.5, 2, 120)
    tree = TR.grow(X, y, w, np.ones(120, int), np.random.default_rng(0), depth, min_leaf, 3)
    got = tree.value[tree.leaves(X, [depth])[depth]]
    assert np.allclose(got, plain_tree(X, y, w, depth, min_leaf))


def test_search_equals_separate_forests(spark, frame):
    df, f = frame
    found = dict((tuple(sorted(p.items())), m) for m, p in TR.search_forest(f, spark, GRID, 5, 42))
    assert len(found) == len(GRID) == 16
    for point in (GRID[0], GRID[7], GRID[-1]):
        nodes = TR.forest_nodes(f, spark, point, range(1, 6), 42).cache()
        errors = []
        for k in range(1, 6):
            rows = TR.score_trees(df.where(F.col("block") == k), nodes.where(F.col("fold") == k), ["a", "b", "c", "d"], "pred")
            errors.append(rows.agg(F.avg(F.abs(F.col("pred") - F.col("target")))).first()[0])
        assert found[tuple(sorted(point.items()))] == pytest.approx(np.mean(errors), rel=1e-9)
        assert nodes.select("fold", "tree").distinct().count() == 5 * point["numTrees"]
        assert nodes.agg(F.max("depth")).first()[0] <= point["maxDepth"]


def test_boosting_stops_early_and_beats_a_constant(spark, frame):
    df, f = frame
    rows = np.flatnonzero(f.block < 5)
    start, trees = TR.boosted(f, rows, {**SETTINGS[0], "maxIter": 200}, 42)
    assert 0 < len(trees) < 200
    nodes = TR.boosted_nodes(f, spark, SETTINGS, [5, 6], 42)
    scored = TR.score_trees(df.where(F.col("block") == 5), nodes.where("setting = 0 AND fold = 5"), ["a", "b", "c", "d"], "pred")
    m, c = scored.agg(F.avg(F.abs(F.col("pred") - F.col("target"))), F.avg(F.abs(F.col("target") - start))).first()
    assert m < 0.6 * c


def test_stored_trees_score_alike(spark, frame, tmp_path):
    df, f = frame
    nodes = TR.forest_nodes(f, spark, GRID[-1], [6], 42)
    save_trees(nodes, str(tmp_path / "m"))
    back = load_trees(spark, str(tmp_path / "m"))
    both = TR.score_trees(TR.score_trees(df, nodes, ["a", "b", "c", "d"], "p"), back, ["a", "b", "c", "d"], "q")
    assert both.where(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0 and both.count() == 600
    # a row's prediction, walked over the stored table by joins
    x = df.limit(1).first()
    total = 0.0
    table = {(r.tree, r.node): r for r in back.collect()}
    for t in {k[0] for k in table}:
        r = table[t, 0]
        while r.feature >= 0:
            r = table[t, r.left if x["abcd"[r.feature]] <= r.threshold else r.right]
        total += r.value
    mine = both.where((F.col("series_key") == x.series_key) & (F.col("date") == x.date)).first()
    assert mine.p == pytest.approx(total, rel=1e-9)


def test_fit_rows_bound_the_fit_and_not_the_result(spark, frame):
    df, _ = frame
    f = TR.training_frame(df, "series_key", "date", ["a", "b", "c", "d"], fit_rows=100)
    assert len(f.target) == 100
    assert TR.score_trees(df, TR.forest_nodes(f, spark, GRID[0], [6], 42), ["a", "b", "c", "d"], "p").where("p IS NOT NULL").count() == 600


def test_tournament_and_serving_from_the_store(spark, tmp_path):
    spec = dataclasses.replace(ForecastSpec(), rf_grid=GRID[:4:3], gbt_grid=SETTINGS)
    feats = _feats(spark, SF_SMALL).checkpoint(eager=True)
    result = TN.run_tournament(feats, spec)
    comparison = result.comparison.toPandas()
    assert len(comparison) == 9 and (comparison.groupby("horizon").is_champion.sum() == 1).all()
    for h, part in comparison.groupby("horizon"):
        assert part.is_champion.iloc[int(np.argmin(part.mae.to_numpy()))], h  # the first of equals
        assert result.champions[h].mae == part.mae.min() and np.isfinite(part[["mae", "rmse", "r2"]].to_numpy()).all()
    day1 = result.champions["day1"].oof
    n = day1.count()
    assert 0 < n and day1.where("oof_level IS NULL").count() == 0
    # day 2 is built on day 1's out-of-fold level, so nothing of day 1's first block has one
    day2 = result.champions["day2"].oof.alias("b").join(day1.alias("a"), ["series_key", "date"], "left")
    assert day2.where("b.oof_level IS NOT NULL AND a.oof_level IS NULL").count() == 0
    assert day2.where("b.oof_level IS NOT NULL AND abs(b.base_pred - a.oof_level) > 1e-9").count() == 0
    save_champions(result.champions, result.deltas, str(tmp_path / "store"))
    champions, deltas = load_champions(spark, str(tmp_path / "store"))
    assert deltas == result.deltas and {h: c.kind for h, c in champions.items()} == {h: c.kind for h, c in result.champions.items()}
    live = serve(feats, spec, result.champions, result.deltas).toPandas().sort_values(["series_key", "horizon"])
    stored = serve(feats, spec, champions, deltas).toPandas().sort_values(["series_key", "horizon"])
    assert len(stored) == 9 and np.allclose(live.predicted, stored.predicted, rtol=1e-9)


def known_value(nodes, x, known, at=0):
    """The tree's value for a row of which only some features are known: unknown ones split by weight."""
    n = nodes[at]
    if n["feature"] < 0:
        return n["value"]
    if n["feature"] in known:
        return known_value(nodes, x, known, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
    return sum(nodes[c]["weight"] / n["weight"] * known_value(nodes, x, known, c) for c in (n["left"], n["right"]))


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_tree_shapley_equals_enumeration(spark, frame, kind):
    from itertools import combinations
    from math import factorial
    df, f = frame
    names = ["a", "b", "c", "d"]
    if kind == "forest":
        nodes = TR.forest_nodes(f, spark, {"numTrees": 7, "maxDepth": 6, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.7"}, [6], 3).drop("fold")
    else:
        nodes = TR.boosted_nodes(f, spark, SETTINGS[:1], [6], 3).drop("setting", "fold")
    nodes = nodes.cache()
    some = df.orderBy("date", "series_key").limit(12).cache()
    got = {(r["series_key"], r["date"], r["feature"]): r["attribution"] for r in TR.tree_shapley(some, ["series_key", "date"], nodes, names).collect()}
    assert len(got) == 48
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n["tree"], {})[n["node"]] = n
    base = trees.pop(-1)[0]["value"] if -1 in trees else 0.0
    mean = TR.expected_value(nodes)
    assert abs(mean - base - sum(known_value(t, None, ()) for t in trees.values())) < 1e-9
    for r in TR.score_trees(some, nodes, names, "p").collect():
        x = [r[c] for c in names]
        value = {s: sum(known_value(t, x, s) for t in trees.values()) for k in range(5) for s in combinations(range(4), k)}
        phi = [sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (value[tuple(sorted((*s, j)))] - v) for s, v in value.items() if j not in s) for j in range(4)]
        mine = [got[r["series_key"], r["date"], c] for c in names]
        assert np.allclose(mine, phi, atol=1e-9)
        assert abs(mean + sum(mine) - r["p"]) < 1e-9


def test_tree_shapley_missing_values_and_lone_leaf(spark):
    """NaN goes right as in scoring; a tree of one leaf attributes nothing; no rows give no rows."""
    nodes = spark.createDataFrame([(0, 0, 0, 0, 1.0, 1, 2, 0.0, 4.0), (0, 1, 1, -1, 0.0, -1, -1, 10.0, 1.0), (0, 2, 1, -1, 0.0, -1, -1, 20.0, 3.0),
                                   (1, 0, 0, -1, 0.0, -1, -1, 5.0, 4.0)], TR.NODES_DDL)
    rows = spark.createDataFrame([(1, 0.5, 0.0), (2, float("nan"), 0.0), (3, None, float("inf"))], "id int, u double, v double")
    got = {(r["id"], r["feature"]): r["attribution"] for r in TR.tree_shapley(rows, ["id"], nodes, ["u", "v"]).collect()}
    assert got == {(1, "u"): -7.5, (1, "v"): 0.0, (2, "u"): 2.5, (2, "v"): 0.0, (3, "u"): 2.5, (3, "v"): 0.0}
    assert TR.expected_value(nodes) == 22.5
    assert TR.tree_shapley(rows.limit(0), ["id"], nodes, ["u", "v"]).count() == 0


def test_forest_grows_no_fold_twice(spark, frame, monkeypatch):
    """Fold forests that the search has grown and scored are not grown anew; a frame that is a sample scores every row by its node tables."""
    df, _ = frame
    spec = dataclasses.replace(ForecastSpec(), features=dataclasses.replace(ForecastSpec().features, target="target"), rf_grid=GRID[:4])
    monkeypatch.setattr(type(spec.features), "feature_cols", lambda self: ["a", "b", "c", "d"])
    asked, plain = [], TR.forest_nodes
    monkeypatch.setattr(TR, "forest_nodes", lambda f, s, p, folds, seed: asked.append(list(folds)) or plain(f, s, p, folds, seed))
    found = TN.run_forest(df, spec, False)
    assert asked == [[6]] and found.oof.count() == 500
    point = plain(TR.training_frame(df, "series_key", "date", ["a", "b", "c", "d"]), spark, found.params, range(1, 6), spec.seed).cache()
    for k in (1, 5):
        rows = TR.score_trees(df.where(F.col("block") == k), point.where(F.col("fold") == k), ["a", "b", "c", "d"], "p").join(found.oof, ["series_key", "date"])
        assert rows.count() == 100 and rows.where("abs(p - oof_level) > 1e-9").count() == 0
    assert TN.run_forest(df, dataclasses.replace(spec, fit_rows=300), False).oof.count() == 500 and asked[1] == [1, 2, 3, 4, 5, 6]


def test_blocks_are_scored_by_their_own_models(spark, frame):
    df, f = frame
    nodes = TR.boosted_nodes(f, spark, SETTINGS, [1, 4], 42).cache()
    packed = TR.packed_by(nodes, ["setting", "fold"])
    both = TR.score_blocks(df.where("block IN (1, 4)"), {f"p{i}": {k: packed[i, k] for k in (1, 4)} for i in range(2)}, ["a", "b", "c", "d"])
    for k in (1, 4):
        for i in range(2):
            one = TR.score_trees(both.where(F.col("block") == k), nodes.where(f"setting = {i} AND fold = {k}"), ["a", "b", "c", "d"], "q")
            assert one.count() == 100 and one.where(f"p{i} IS NULL OR p{i} <> q").count() == 0
