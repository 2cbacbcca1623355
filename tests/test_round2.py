"""Quarantine, folder streams and true stratification."""

import pytest

from riskops.operators import evaluate, resample, retrieval
from riskops.sources import scans
from riskops.streaming import jobs

TINY = "/root/testdata/sf0.001"


def test_bad_json_is_quarantined(spark):
    rows = [(1, '{"k": 3}'), (2, "garbage"), (3, '{"k" 3'), (4, None), (5, ""), (6, '{"k": "x"}'), (7, "{}")]
    got = {r.id: (r.valid, r.doc.k if r.doc else None)
           for r in scans.parse_json_column(spark.createDataFrame(rows, "id int, j string"), "j", "k INT").collect()}
    assert [i for i, (v, _) in got.items() if v] == [1, 7] and got[1][1] == 3


def test_class_sizes_of_split_and_folds(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANK_RANGE", 100)
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN 1 WHEN id % 7 = 0 THEN NULL ELSE 0 END AS y")
    sizes = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    split = {(r.y, r.split): r["count"] for r in resample.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert all(split[y, "test"] == int(n * 0.2 + 0.5) for y, n in sizes.items()) and sum(split.values()) == 1000
    folds = {(r.y, r.fold): r["count"] for r in resample.stratified_folds(df, "id", "y").groupBy("y", "fold").count().collect()}
    for y, n in sizes.items():
        assert sorted(folds[y, k] for k in range(5)) == sorted(n // 5 + (k < n % 5) for k in range(5))


def test_streams_read_tables_of_several_parts(spark, tmp_path):
    events = spark.read.parquet(f"{TINY}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want = sorted(map(str, jobs.stream_latest_state(spark, TINY).select("patient_id", "ts", "seq").collect()))
    got = sorted(map(str, jobs.stream_latest_state(spark, str(tmp_path)).select("patient_id", "ts", "seq").collect()))
    assert got == want and got


def test_unreadable_state_fails(spark, tmp_path):
    (tmp_path / "batch_id=0").mkdir()
    (tmp_path / "batch_id=0" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):
        jobs.read_sink(spark, str(tmp_path), "a long")
    assert jobs.read_sink(spark, str(tmp_path / "none"), "a long").collect() == []


def test_lexical_search_finds_short_queries(spark):
    docs = {"a": "Concatenate the catalog, cat!", "b": "a bobcat saturday", "c": "no match *** here", "d": "", "e": "cat sat. CAT SAT", "f": None}
    queries = ["cat", "cat sat", "***", "*", " ", "", "x", "c", "at s", "the catalog, cat", "atalo", "zz", "é", "! ", None]
    d = spark.createDataFrame(list(docs.items()), "source string, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {(r.query_id, r.source): r.score for r in retrieval.rag_lexical(q, d, k=10).collect()}
    want = {(i, s): n for i, x in enumerate(queries) if x for s, t in docs.items() if t and (n := t.lower().count(x))}
    assert got == want


def test_infinite_and_nan_scores_rank_at_the_ends(spark):
    rows = [(0, float("-inf")), (0, 0.1), (1, 0.4), (0, 0.3), (1, float("inf")), (1, float("nan"))] * 40
    df = spark.createDataFrame(rows, "y int, p double")
    assert evaluate.roc_auc(df, "p", "y").first().roc_auc == 1.0


def test_bootstrap_replicates_equal_brute_force(spark, monkeypatch):
    """A hot value, ranges of several values and infinite scores, with ranges small enough to cut and salt."""
    import numpy as np

    monkeypatch.setattr(evaluate, "BOOT_RANGE", 20)
    rng = np.random.default_rng(3)
    s = np.where(rng.random(400) < 0.4, 0.5, rng.normal(size=400).round(2))
    s[:5], y = [np.inf, -np.inf, np.inf, np.nan, np.nan], (rng.random(400) < 0.3).astype(int)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, y int, p double").repartition(7)
    got = {r.rep: r.roc_auc for r in evaluate.bootstrap_auc(df, "id", ["p"], "y", 30).collect()}
    from riskops.functions.exprs import uniform

    h = {r.id: int(r.u * 2**32) % evaluate.HASH_MODULUS for r in df.select("id", uniform("boot", "id").alias("u")).collect()}
    w = evaluate.multiplicities(np.array([h[i] for i in range(400)]), evaluate.replicate_coefficients(30, "boot"))
    assert w.shape == (400, 30) and 0.9 < w.mean() < 1.1 and 0.9 < w.var() < 1.1
    key = np.where(np.isnan(s), 1e300, np.clip(s, -1e200, 1e200))
    order = (key[:, None] > key[None, :]) + 0.5 * (key[:, None] == key[None, :])
    for r in range(30):
        pos, neg = w[:, r] * y, w[:, r] * (1 - y)
        assert got[r] == pytest.approx(pos @ order @ neg / (pos.sum() * neg.sum()), abs=1e-12)


def test_group_folds_share_the_classes(spark):
    df = spark.range(3000).selectExpr("id", "concat('g', cast(pow(id, 0.7) as int)) AS g", "CASE WHEN id % 11 < 2 THEN 1 WHEN id % 11 = 3 THEN NULL ELSE 0 END AS y")
    f = resample.group_folds(df, ["g"], 5, label_col="y")
    assert f.count() == 3000 and f.groupBy("g").agg({"fold": "max"}).count() == f.select("g", "fold").distinct().count()
    most = f.where("y = 1").groupBy("g").count().agg({"count": "max"}).first()[0]
    sizes = [r["count"] for r in f.where("y = 1").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= most
    assert resample.group_folds(df.where("false"), ["g"], 5, label_col="y").count() == 0


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 7), (5, 0), (4, 3)])
def test_chunks_are_the_windows_of_the_text(spark, size, overlap):
    texts = {"a": "", "b": "x", "c": "abcdefghij", "d": "abcdefghijk", "e": "\U0001f600é word " * 20, "f": None}
    docs = spark.createDataFrame(list(texts.items()), "source string, text string")
    got = {(r.source, r.chunk_id): r.text for r in retrieval.chunk_documents(docs, size=size, overlap=overlap).collect()}
    want, step = {}, size - overlap
    for name, text in texts.items():
        clean = " ".join((text or "").split())
        for i in range(max(0, -(-(len(clean) - size) // step)) + 1 if clean else 0):
            want[name, i] = clean[i * step:i * step + size]
    assert got == want


def test_chat_falls_back_to_the_lexical_search(spark):
    docs = spark.createDataFrame([("a", "sleep well sleep"), ("b", "q: zz-? yes zz-?")], "source string, text string")
    rows = [(1, "about sleep", ["sleep"], " Next."), (2, "zz-?", [], " Next."), (3, None, [], "Call."), (4, "gone", ["x"], " Next."), (5, "about sleep", ["sleep"], " Next.")]
    guided = spark.createDataFrame(rows, "message_id int, guidance_query string, risk_factors array<string>, actionable string")
    got = {r.message_id: r for r in retrieval.assess_chat(guided, docs).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1].guidance == got[5].guidance
    assert got[1].guidance == "Based on the available guidelines and sleep, consider the following: sleep well sleep Next."
    assert got[1].sources[0].startswith("a (score=")
    assert (got[3].guidance, got[3].sources) == ("Call.", [])
    assert got[4].guidance.startswith("No guideline documents") and got[4].sources == []
    assert got[2].guidance == "Based on the available guidelines and the reported symptoms, consider the following: " + "q: zz-? yes zz-? Next." and got[2].sources
