
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, TINY
from riskops.operators import evaluate as E
from riskops.operators import fairness
from riskops.operators import resample as RS
from riskops.operators import retrieval as RT
from riskops.sources import adapters as A


def _auc(df, score="p"):
    return E.roc_auc(df, score, "y").first()["roc_auc"]


def _numpy_auc(p, y):
    p, y = np.asarray(p, float), np.asarray(y, int)
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def test_auc_matches_brute_force(spark):
    s = A.scored(spark, TINY).select("p", "y")
    rows = s.collect()
    assert _auc(s) == pytest.approx(_numpy_auc([r.p for r in rows], [r.y for r in rows]), abs=1e-12)


def test_auc_of_complement(spark):
    s = A.scored(spark, TINY).select("p", "y")
    flipped = s.select((1 - F.col("p")).alias("p"), "y")
    assert _auc(flipped) == pytest.approx(1 - _auc(s), abs=1e-12)


def test_shuffle_invariance(spark):
    s = A.scored(spark, TINY).select("prediction_id", "p", "y")
    a = E.roc_auc(s).first()["roc_auc"], E.average_precision(s).first()[0]
    r = s.repartition(7, "y").sortWithinPartitions(F.rand(3))
    b = E.roc_auc(r).first()["roc_auc"], E.average_precision(r).first()[0]
    assert a == pytest.approx(b, abs=1e-12)


def test_auc_single_class_is_null(spark):
    s = A.scored(spark, TINY).where("y = 1").select("p", "y")
    assert _auc(s) is None


def test_auc_all_ties(spark):
    s = A.scored(spark, TINY).select(F.lit(0.5).alias("p"), "y")
    assert _auc(s) == pytest.approx(0.5)


def test_empty_input_metrics(spark):
    s = A.scored(spark, TINY).where("false").select("p", "y")
    m = E.classification_metrics(s).first()
    assert m["accuracy"] in (None, 0.0)


def test_group_folds_never_overlap(spark):
    a = A.assessments(spark, TINY)
    cols = ["sleep_quality", "appetite", "fatigue"]
    f = RS.group_folds(a, cols, k=5)
    per_profile = f.groupBy("profile").agg(F.countDistinct("fold").alias("n")).where("n > 1").count()
    assert per_profile == 0
    assert {r[0] for r in f.select("fold").distinct().collect()} <= set(range(5))


def test_oversample_draws_with_replacement_to_the_exact_size(spark):
    s = A.scored(spark, SMALL).select("prediction_id", "y")
    sizes = {r.y: r["count"] for r in s.groupBy("y").count().collect()}
    o = RS.oversample(s.union(spark.createDataFrame([(-1, None)], "prediction_id long, y int")), "prediction_id", "y")
    after = {r.y: r["count"] for r in o.groupBy("y").count().collect()}
    assert after == dict.fromkeys(sizes, max(sizes.values()))
    # the largest class is drawn too: about 1 - 1/e of its rows come out
    big = max(sizes, key=sizes.get)
    share = o.where(F.col("y") == big).select("prediction_id").distinct().count() / sizes[big]
    assert abs(share - 0.632) < 0.02
    assert o.groupBy("prediction_id").agg(F.countDistinct("copy").alias("a"), F.count("*").alias("b"), F.max("copy").alias("c")).where("a <> b OR c <> b - 1").count() == 0
    one = RS.oversample(s.where("y = 1"), "prediction_id", "y")
    assert one.count() == sizes[1] and RS.oversample(s.where("y = 7"), "prediction_id", "y").count() == 0


def test_oversample_never_broadcasts_its_draws(spark):
    """The draws grow with the rows, whatever the planner takes their size for."""
    rows = spark.range(2000).selectExpr("id AS row_id", "CAST(id % 5 = 0 AS int) AS y")
    drawn = RS.oversample(rows, "row_id", "y")
    assert drawn.count() == 3200
    drawn.collect()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Join" in line and "class_rank" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_chunks_rejoin_to_text(spark):
    docs = A.guidelines(spark, TINY)
    size, overlap = 500, 80
    ch = RT.chunk_documents(docs, size=size, overlap=overlap).collect()
    by = {}
    for r in ch:
        by.setdefault(r.source, []).append((r.chunk_id, r.text))
    clean = {r.source: " ".join(r.text.split()) for r in docs.collect()}
    for src, parts in by.items():
        parts.sort()
        text = parts[0][1]
        for i, (_, t) in enumerate(parts[1:], start=1):
            start = i * (size - overlap)
            text = text[:start] + t
        assert text == clean[src]


def test_reweigh_balances_group_label_cells(spark):
    s = A.scored(spark, TINY)
    w = fairness.reweigh(s, "income_band", "y")
    assert w.count() > 0


def test_no_null_group_lost(spark):
    df = spark.createDataFrame([(None, 70.0), ("a", 10.0), ("a", 90.0)], "income_band string, risk_percent double")
    rates = {r["group"]: r["positive_rate"] for r in fairness.group_positive_rate(df).collect()}
    assert rates == {"unknown": 1.0, "a": 0.5}


def test_topk_same_without_broadcast(spark, monkeypatch):
    """The shuffle-join path (query side over the broadcast bound) returns the same top-k."""
    qs, docs = A.queries_table(spark, TINY), RT.chunk_documents(A.guidelines(spark, TINY))
    a = RT.rag_topk(qs, docs, k=3).select("query_id", "rank", "source", "chunk_id").collect()
    monkeypatch.setattr(RT, "BROADCAST_QUERY_TERMS", 0)
    b = RT.rag_topk(qs, docs, k=3).select("query_id", "rank", "source", "chunk_id").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def _empty_scored(spark):
    return spark.createDataFrame([], "prediction_id long, p double, y int, income_band string, risk_percent double")


def _single_class(spark):
    return spark.createDataFrame([(i, i / 10, 1, None, 70.0) for i in range(10)],
                                 "prediction_id long, p double, y int, income_band string, risk_percent double")


def test_empty_input_fairness_is_insufficient(spark):
    r = fairness.disparate_impact(fairness.group_positive_rate(_empty_scored(spark))).first()
    assert r["n_groups"] == 0 and r["n_nonzero_groups"] == 0
    assert r["mitigation_strategy"] == "none" and r["bias_detected"] is False


def test_empty_input_confusion_matrix_is_zero(spark):
    assert [r["n"] for r in E.confusion_matrix(_empty_scored(spark)).collect()] == [0, 0, 0, 0]


def test_single_class_edges(spark):
    one = _single_class(spark)
    assert fairness.disparate_impact(fairness.group_positive_rate(one)).first()["mitigation_strategy"] == "none"
    assert fairness.di_by_threshold(one).count() == 0
    assert E.bootstrap_auc_ci(one, n_boot=20).first()["n_bootstraps"] == 0
    assert E.average_precision(one).first()["average_precision"] == pytest.approx(1.0)


def test_key_points_normalise_and_split_a_text_once(spark):
    from riskops.operators import triage as TR
    from riskops.plans import catalog as C

    d = C.q_key_points(spark, TINY)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("split(") == 1
    rows = [(1, "One  longer sentence here. short. Another\tsentence of it - and a last part"), (2, "tiny"), (3, "   "), (4, None), (5, "")]
    got = {r.i: r.key_points for r in TR.key_points(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got[1] == ["One longer sentence here", "Another sentence of it", "and a last part"] and got[2] == ["tiny"] and got[3] == got[5] == []


def test_ranks_of_one_class_are_taken_in_many_tasks(spark):
    d = spark.range(20_000).select("id", F.lit("all").alias("y"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        r = RS.class_rank(d, "id", "y", "s")
        held = [n for n in r.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        ranks = sorted(x.class_rank for x in r.select("class_rank").collect())
    finally:
        spark.conf.set(key, old)
    assert max(held) < 15_000 and ranks == list(range(20_000))


def test_group_folds_do_not_shuffle_profiles_by_their_mix(spark):
    d = spark.range(500).select(F.col("id").alias("p"), (F.col("id") % 2).alias("y"))
    r = RS.group_folds(d, ["p"], 5, "s", "y")
    assert sorted(x["count"] for x in r.groupBy("fold", "y").count().collect()) == [50] * 10
