"""Tree Shapley values against the formula over all subsets, on hand-made and fitted trees."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskops.operators import explain as X
from riskops.operators import models as M
from riskops.operators import shap as S


def expected(nodes, value, cover, x, known, at=0):
    """The tree's mean prediction when only the features ``known`` of ``x`` are."""
    n = nodes[at]
    if n["leftChild"] < 0:
        return value(n)
    go = [n["leftChild"], n["rightChild"]]
    if n["featureIndex"] in known:
        return expected(nodes, value, cover, x, known, go[0] if x[n["featureIndex"]] <= n["threshold"] else go[1])
    total = sum(cover(nodes[c]) for c in go)
    return sum(cover(nodes[c]) / total * expected(nodes, value, cover, x, known, c) for c in go)


def brute(nodes, value, cover, x):
    d = len(x)
    out = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for size in range(d):
            w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            for s in combinations(rest, size):
                out[i] += w * (expected(nodes, value, cover, x, {*s, i}) - expected(nodes, value, cover, x, set(s)))
    return out


def random_tree(r, depth, d):
    nodes, todo = {}, [(0, depth, float(r.integers(50, 100)))]
    free = 1
    while todo:
        at, left, weight = todo.pop()
        if left == 0 or weight < 2 or r.random() < 0.15:
            nodes[at] = {"leftChild": -1, "rightChild": -1, "v": float(r.normal()), "w": weight}
            continue
        nodes[at] = {"leftChild": free, "rightChild": free + 1, "featureIndex": int(r.integers(d)), "threshold": float(r.integers(-2, 3)), "w": weight, "v": 0.0}
        part = weight * float(r.uniform(0.05, 0.95))
        todo += [(free, left - 1, part), (free + 1, left - 1, weight - part)]
        free += 2
    return nodes


VALUE, COVER = (lambda n: n["v"]), (lambda n: n["w"])


def test_random_trees_equal_brute_force():
    r = np.random.default_rng(0)
    for _ in range(40):
        d = int(r.integers(1, 6))
        nodes = random_tree(r, 6, d)  # a feature is often split twice on a path
        x = r.integers(-3, 4, (12, d)).astype(float)
        x[0, 0] = np.nan
        x[1, -1] = -np.inf
        got, base = S.shapley([S.leaves(nodes, VALUE, COVER)], [1.0], x)
        want = np.array([brute(nodes, VALUE, COVER, row) for row in x])
        assert np.allclose(got, want, atol=1e-12)
        assert abs(base - expected(nodes, VALUE, COVER, x[0], set())) < 1e-12


def test_a_leaf_that_no_training_row_reached():
    nodes = {0: {"leftChild": 1, "rightChild": 2, "featureIndex": 0, "threshold": 0.0, "w": 4.0, "v": 0.0},
             1: {"leftChild": -1, "rightChild": -1, "v": 2.0, "w": 4.0}, 2: {"leftChild": -1, "rightChild": -1, "v": 5.0, "w": 0.0}}
    got, base = S.shapley([S.leaves(nodes, VALUE, COVER)], [1.0], np.array([[-1.0, 0.0], [1.0, 0.0]]))
    assert got.tolist() == [[0.0, 0.0], [3.0, 0.0]] and base == 2.0


FEATS = ["a", "b", "Financial stress", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(7)
    rows = []
    for k in range(400):
        a, b, c, d = (float(v) for v in r.integers(0, 6, 4))
        y = int(r.random() < 1 / (1 + np.exp(-(a * b / 4 - c))))
        rows.append((None if k == 5 else k % 390, None if k % 50 == 0 else a, b, c, d, y))
    return spark.createDataFrame(rows, "id long, a double, b double, `Financial stress` double, d double, y int").repartition(3)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_fitted_ensembles_equal_brute_force_and_add_up(spark, frame, kind):
    if kind == "forest":
        model = M.fit_forest(frame, FEATS, num_trees=6, max_depth=4)
        raw = vector_to_array("probability")[1]
    else:
        model = M.fit_gbt(frame, FEATS, max_iter=6, max_depth=3)
        raw = vector_to_array("rawPrediction")[1]
    out = S.tree_shap(model, frame, FEATS, "id").toPandas()
    assert len(out) == 1600 and out.columns.tolist() == ["id", "feature", "attribution", "share_percent", "base"]
    t = model.transform(frame).select("id", vector_to_array("features").alias("x"), raw.alias("p")).toPandas()
    rows, weights, form = X.tree_nodes(model.stages[-1], spark)
    trees = [{} for _ in weights]
    for n in rows:
        trees[n["treeID"]][n["id"]] = {**n, "threshold": n["leftCategoriesOrThreshold"][0] if n["leftChild"] >= 0 else None}
    value = (lambda n: n["impurityStats"][1] / sum(n["impurityStats"])) if form == "rf" else (lambda n: n["prediction"])
    cover = (lambda n: sum(n["impurityStats"])) if form == "rf" else (lambda n: n["impurityStats"][0])
    scale = [1 / len(trees)] * len(trees) if form == "rf" else weights
    for k, row in t[t.id.notna() & (t.id >= 10)].head(25).iterrows():
        want = sum(s * brute(n, value, cover, row.x) for s, n in zip(scale, trees))
        own = out[out.id == row.id].set_index("feature")
        assert np.allclose(own.attribution[FEATS], want, atol=1e-10)
        assert abs(own.base.iloc[0] + own.attribution.sum() - row.p) < 1e-9
        assert abs(own.share_percent.sum() - 100) < 0.05 or own.attribution.abs().sum() == 0


def test_no_rows_and_rows_without_effect(spark, frame):
    one = frame.withColumn("y", F.lit(1))
    model = M.fit_forest(one, FEATS, num_trees=2, max_depth=3, balanced=False)
    out = S.tree_shap(model, frame.limit(3), FEATS, "id", class_index=0)
    assert {(r.attribution, r.share_percent) for r in out.collect()} == {(0.0, 0.0)}
    assert S.tree_shap(model, frame.where("id < -1"), FEATS, "id").collect() == []


def test_values_do_not_depend_on_the_block_or_on_how_patterns_are_found(monkeypatch):
    r = np.random.default_rng(3)
    trees = [S.leaves(random_tree(r, 8, 6), VALUE, COVER) for _ in range(3)]
    x = r.integers(-3, 4, (300, 6)).astype(float)
    x[7, 2] = np.nan
    want, base = S.shapley(trees, [0.5, 0.25, 0.25], x)
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    monkeypatch.setattr(S, "TABLE_VALUES", 64)
    assert np.allclose(S.shapley(trees, [0.5, 0.25, 0.25], x)[0], want, atol=1e-12)
    monkeypatch.setattr(S, "TABLE_FEATURES", 2)
    got, same = S.shapley(trees, [0.5, 0.25, 0.25], x)
    assert np.allclose(got, want, atol=1e-12) and same == base


def test_leaves_are_worked_on_together_not_one_by_one(monkeypatch):
    r = np.random.default_rng(4)
    trees = [S.leaves(random_tree(r, 8, 4), VALUE, COVER) for _ in range(20)]
    calls, real = [], S.pattern_values
    monkeypatch.setattr(S, "pattern_values", lambda *a: calls.append(a) or real(*a))
    S.shapley(trees, [1.0] * 20, r.integers(-3, 4, (50, 4)).astype(float))
    assert len(calls) <= 4 < sum(map(len, trees))


def test_neighbouring_leaves_are_looked_up_once(monkeypatch):
    r = np.random.default_rng(6)
    trees = [S.leaves(random_tree(r, 8, 6), VALUE, COVER) for _ in range(5)]
    x = r.integers(-3, 4, (40_000, 6)).astype(float)
    lookups, real = [], S.patterns_of
    monkeypatch.setattr(S, "patterns_of", lambda *a: lookups.append(a) or real(*a))
    got, _ = S.shapley(trees, [1.0] * 5, x)
    assert len(lookups) < 0.6 * 3 * sum(len(leaf.features) > 0 for t in trees for leaf in t)  # three blocks of rows
    monkeypatch.setattr(S, "MERGED_BITS", 0)
    assert np.allclose(S.shapley(trees, [1.0] * 5, x)[0], got, atol=1e-12)


def test_batches_are_joined():
    import pyarrow as pa

    made = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["x"]) for n in (3, 0, 4, 5, 1)]
    assert [b.column("x").to_pylist() for b in S.gathered(iter(made), 6)] == [[0, 1, 2, 0, 1, 2, 3], [0, 1, 2, 3, 4, 0]]
    assert list(S.gathered(iter(made[1:2]), 6)) == []
