"""Learners at full size: text classifier against its formulas, calibration against a sequential fit, grids against single fits."""

import math
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskops.operators import evaluate as E
from riskops.operators import grid as G
from riskops.operators import models as M

TEXTS = [("I feel fine today", "low"), ("feel very sad and tired", "high"), ("so tired, so sad", "high"), ("fine day fine sleep", "low"), ("sleep is bad", "medium"),
         ("tired but fine", "medium"), ("sad sad sad", "high"), ("good sleep today", "low"), ("bad day", "medium"), ("very good day", "low"), (None, "low"), ("no label", None)]


def grams(text):
    t = re.findall(r"\w{2,}", text.lower())
    return t + [" ".join(p) for p in zip(t, t[1:])]


def by_hand(texts):
    bags = [grams(t) for t in texts]
    terms = sorted({g for b in bags for g in b})
    df = {t: sum(t in b for b in bags) for t in terms}
    x = np.array([[b.count(t) * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t in terms] for b in bags])
    return terms, x / np.linalg.norm(x, axis=1, keepdims=True)


def newton(x, y, w, kinds):
    """Minimise sum of weighted losses + half the squared weights (intercepts are free), by damped Newton steps."""
    n, d = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    if kinds == 2:
        b = np.zeros(d + 1)
        ridge = np.append(np.ones(d), 1e-12)
        for _ in range(100):
            p = 1 / (1 + np.exp(-z @ b))
            g = z.T @ (w * (p - y)) + ridge * b
            b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), g)
        return b[None, :-1]
    b = np.zeros((kinds, d + 1))
    ridge = np.tile(np.append(np.ones(d), 1e-9), kinds)
    onehot = np.eye(kinds)[y]
    for _ in range(100):
        e = np.exp(z @ b.T - (z @ b.T).max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        g = ((w[:, None] * (p - onehot)).T @ z).ravel() + ridge * b.ravel()
        h = np.zeros((kinds * (d + 1),) * 2)
        for i in range(n):
            h += np.kron(w[i] * (np.diag(p[i]) - np.outer(p[i], p[i])), np.outer(z[i], z[i]))
        b -= np.linalg.solve(h + np.diag(ridge), g).reshape(kinds, d + 1)
    return b[:, :-1]


@pytest.mark.parametrize("kinds", [2, 3])
def test_text_classifier_equals_formula_and_newton(spark, tmp_path, kinds):
    rows = [(i, t, l) for i, (t, l) in enumerate(TEXTS) if kinds == 3 or l != "medium"]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    model = M.fit_text_classifier(df)
    used = [(t, l) for _, t, l in rows if t and l]
    terms, x = by_hand([t for t, _ in used])
    labels = sorted({l for _, l in used})
    assert list(model.stages[0].labels) == labels
    vocabulary = model.stages[4].vocabulary
    assert sorted(vocabulary) == terms
    order = [vocabulary.index(t) for t in terms]
    got = {r.text: np.array(r.v)[order] for r in model.transform(df.dropna()).select("text", vector_to_array("features").alias("v")).collect()}
    assert all(np.allclose(got[t], v, atol=1e-12) for (t, _), v in zip(used, x))
    y = np.array([labels.index(l) for _, l in used])
    w = len(y) / (kinds * np.bincount(y)[y])
    want = newton(x, y, w, kinds)
    coefficients = model.stages[-1].coefficientMatrix.toArray()[:, order]
    assert np.allclose(coefficients, want, atol=2e-3 * np.abs(want).max())
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert sorted(map(tuple, M.text_predictions(again, df, "id").collect())) == sorted(map(tuple, M.text_predictions(model, df, "id").collect()))


def test_vocabulary_is_the_most_frequent_terms(spark):
    df = spark.createDataFrame([("aa bb", "x"), ("aa cc", "y"), ("dd", "y")], "text string, label string")
    assert M.fit_text_classifier(df, vocab_size=2).stages[4].vocabulary == ["aa", "aa bb"]


def test_label_report_by_hand(spark):
    pairs = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "a")]
    c = M.label_confusion(spark.createDataFrame(pairs, "actual string, predicted string"))
    cells = {(r.actual, r.predicted): r.n for r in c.collect()}
    assert len(cells) == 9 and cells[("a", "a")] == 2 and cells[("c", "c")] == 0
    rep = {r.label: r for r in M.label_report(c).collect()}
    assert (rep["a"].precision, rep["a"].recall, rep["a"].support) == (2 / 3, 2 / 3, 3)
    assert (rep["b"].precision, rep["b"].recall, rep["b"].f1_score) == (1 / 3, 1.0, 0.5) and rep["c"].f1_score == 0
    assert rep["accuracy"].precision == 0.5 and abs(rep["macro avg"].recall - 5 / 9) < 1e-12
    assert abs(rep["weighted avg"].precision - (3 * 2 / 3 + 1 / 3) / 6) < 1e-12


FEATS = ["a", "b"]


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(1200):
        a, b = (float(v) for v in r.integers(0, 8, 2))
        rows.append((None if k % 50 == 0 else k // 2, a, b, int(r.random() < 1 / (1 + np.exp(-(a - b) * 0.8)))))
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").repartition(3).cache()
    yield df
    df.unpersist()


def pool_adjacent(points):
    """Sequential pool-adjacent-violators over (score, mean, weight), by score."""
    blocks = []
    for s, m, w in sorted(points):
        blocks.append([m, w, [s]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, s2 = blocks.pop()
            m1, w1, s1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, s1 + s2])
    return {s: m for m, _, ss in blocks for s in ss}


def test_isotonic_equals_a_sequential_fit(spark):
    r = np.random.default_rng(9)
    rows = [(float(r.integers(0, 60)) / 60, int(v)) for v in r.integers(0, 2, 3000)] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y int").repartition(5)
    got = {row.p: row.c for row in M.isotonic(df)(df.where("p is not null").select("p").distinct(), "p", "c").collect()}
    means = {}
    for p, y in rows:
        if p is not None and y is not None:
            means.setdefault(p, []).append(y)
    want = pool_adjacent([(p, float(np.mean(v)), len(v)) for p, v in means.items()])
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_keeps_every_row_and_does_not_hurt(frame, method):
    learner = lambda t, f, y: M.fit_forest(t, f, y, num_trees=10, max_depth=8)
    train, test = M.split(frame.where("id is not null"), "id")
    scorer = M.cross_calibrated(train, FEATS, learner, "id", method=method)
    out = scorer(frame)  # repeated and null ids
    assert out.count() == frame.count() and out.columns == [*frame.columns, "p_calibrated"]
    raw = E.brier_score(M.score_model(learner(train, FEATS, "y"), test, keep=["y"])).first().brier_score
    own = E.brier_score(scorer(test), "p_calibrated").first().brier_score
    assert own <= raw + 1e-3


def test_boosting_ends_at_its_best_round_and_repeats(frame):
    d = frame.where("id is not null")
    one, two = (M.fit_gbt(d, FEATS, max_iter=90, step_size=0.3, id_col="id", patience=10) for _ in range(2))
    a, b = one.stages[-1], two.stages[-1]
    assert 2 <= a.getNumTrees < 90 and a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    whole = M.fit_gbt(d.where(M.uniform("early_stop", "id") >= 0.1), FEATS, max_iter=a.getNumTrees + 10, step_size=0.3).stages[-1]
    held = PipelineModel(one.stages[:-1]).transform(d.where(M.uniform("early_stop", "id") < 0.1)).select("features", "y")
    losses = whole.evaluateEachIteration(held)
    assert abs(min(losses) - a.evaluateEachIteration(held)[-1]) < 0.02
    scored = M.score_model(one, d, keep=["y"])
    assert E.roc_auc(scored).first().roc_auc > 0.8
    assert a.numFeatures == 2 and len(a.featureImportances) == 2


def test_grid_equals_single_fits(frame):
    d = frame.where("id is not null").withColumn("rid", F.monotonically_increasing_id())
    learner = lambda t, f, y: M.fit_logistic(t, f, y)
    grid = G.variant_grid(d, [G.Variant("lr", "both", ("a", "b"), learner), G.Variant("lr", "one", ("a",), learner)], "rid", folds=3)
    rows = {r.feature_set: r for r in grid.collect()}
    assert rows["both"].n_features == 2 and rows["both"].cv_auc_mean > rows["one"].cv_auc_mean > 0.6
    folded = G.folded(d, "rid", "y", 3, 0.2)
    aucs = [E.roc_auc(M.score_model(learner(folded.where(F.col("fold") != f), ["a", "b"], "y"), folded.where(F.col("fold") == f), keep=["y"])).first().roc_auc for f in range(3)]
    assert abs(rows["both"].cv_auc_mean - np.mean(aucs)) < 1e-9 and abs(rows["both"].cv_auc_std - np.std(aucs)) < 1e-9
    sizes = folded.groupBy("fold", "y").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in sizes)


def test_learning_curve_sizes(frame):
    d = frame.where("id is not null").withColumn("rid", F.monotonically_increasing_id())
    n = d.count()
    lc = {r.fraction: r for r in G.learning_curve(d, FEATS, lambda t, f, y: M.fit_logistic(t, f, y), "rid", fractions=(0.2, 1.0), k=3).collect()}
    assert abs(lc[0.2].train_size - 0.2 * n * 2 / 3) <= 2 and abs(lc[1.0].train_size - n * 2 / 3) <= 1
    assert lc[1.0].cv_auc_mean > 0.75 and lc[0.2].cv_auc_std >= 0


def test_learners_get_their_rows_dealt_to_all_cores(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id", "CAST(id % 2 AS int) AS y", "CAST(id % 7 AS double) AS x").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert M.dealt(rows) is rows  # too short to be dealt
    monkeypatch.setattr(M, "TASK_ROWS", 10)
    train, test = M.split(rows, "id")
    assert train.rdd.getNumPartitions() >= cores and train.count() + test.count() == 400
    monkeypatch.setattr(M, "TRAIN_ROWS", 30)
    parts = M.dealt(rows).rdd.glom().map(len).collect()
    assert len(parts) == 14 and sum(parts) == 400 and max(parts) <= 60


def test_a_forest_keeps_the_nodes_of_its_rows_and_is_the_same(frame, monkeypatch):
    made, real = [], M.RandomForestClassifier
    monkeypatch.setattr(M, "RandomForestClassifier", lambda **kw: made.append(real(**kw)) or made[-1])
    kept = M.fit_forest(frame, FEATS, num_trees=5, max_depth=4).stages[-1].toDebugString
    assert made[0].getCacheNodeIds()
    monkeypatch.setattr(M, "RandomForestClassifier", lambda **kw: real(**{**kw, "cacheNodeIds": False}))
    assert M.fit_forest(frame, FEATS, num_trees=5, max_depth=4).stages[-1].toDebugString.split("\n", 1)[1] == kept.split("\n", 1)[1]
