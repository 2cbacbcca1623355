"""Counts in Arrow batches equal the JVM's tokens; pruned top-k equals the full product and scores few chunks."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskops.operators import retrieval as RT
from riskops.session import written

WORDS = [f"w{i}" for i in range(400)]


def corpus(spark, n=1500, seed=1):
    """Chunks of rare words, each with stop words that all of them share; some are short."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        own = [r.choice(WORDS) for _ in range(r.choice([2, 8, 30]))]
        text = " ".join(x for w in own for x in (w, r.choice(["the", "of", "and", "to"])))
        rows.append((f"d{i // 5}", i % 5, text))
    rows += [("same", k, "the w1 of w2") for k in range(30)] + [("empty", 0, ""), ("none", 0, None)]
    return written(spark.createDataFrame(rows, "source string, chunk_id int, text string").repartition(4), "test-chunks")


def queries(spark, n=40, seed=2):
    r = random.Random(seed)
    rows = [(i, " ".join(["the", "of", "and", "to", "the of", *(r.choice(WORDS) for _ in range(3))])) for i in range(n)]
    return spark.createDataFrame([*rows, (900, "the of and to"), (901, "unknown words only"), (902, ""), (903, None), (904, "w1 w2 the")], "query_id int, query string")


@pytest.fixture(scope="module")
def index(spark):
    postings, vocab = RT.tfidf_index(corpus(spark), blocks=True)
    return written(postings, "test-postings"), written(RT.vectorize(queries(spark), vocab), "test-queries")


def listed(df):
    return sorted((r.query_id, r.rank, r.source, r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 3, 50])
def test_pruned_equals_the_full_product(index, k):
    postings, qv = index
    want = listed(RT.top_k(RT.similarity(qv, postings), k))
    assert listed(RT.pruned_top_k(qv, postings, k, plain_postings=0)) == want
    assert listed(RT.pruned_top_k(qv, postings, k, floor_postings=1, plain_postings=0)) == want
    assert listed(RT.pruned_top_k(qv, postings, k)) == want and len(want) > k * 40


def test_stop_words_make_no_candidates(index):
    postings, qv = index
    some = qv.where("query_id < 900")
    terms = written(RT.bounded_terms(some, postings, 3), "test-terms")
    full = RT.similarity(some, postings).count()
    found = RT.candidates(terms, postings).count()
    assert found < 0.1 * full
    touched = terms.where("essential").join(postings, ["term", "block"]).count()
    assert touched < 0.7 * some.join(postings, "term").count()


def test_index_by_hand(spark):
    rows = [("a", 0, "Fever and FEVER, rash!"), ("a", 1, "rash and x"), ("b", 0, "Ärzte_1 raten: ärzte_1 raten"), ("c", 0, "")]
    postings, vocab = RT.tfidf_index(spark.createDataFrame(rows, "source string, chunk_id int, text string"))
    grams = {(s, c): (lambda t: t + [" ".join(p) for p in zip(t, t[1:])])(re.findall(r"\w{2,}", x.lower())) for s, c, x in rows}
    df = {}
    for g in grams.values():
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
    want = {}
    for key, g in grams.items():
        w = {t: g.count(t) * idf[t] for t in g}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(*key, t): x / norm for t, x in w.items()}
    got = {(r.source, r.chunk_id, r.term): r.weight for r in postings.collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    assert {r.term: r.df for r in vocab.collect()} == df
    few, _ = RT.tfidf_index(spark.createDataFrame(rows, "source string, chunk_id int, text string"), max_features=2)
    assert {r.term for r in few.collect()} <= {"fever", "rash", "and", "raten", "ärzte_1", "ärzte_1 raten"} and few.select("term").distinct().count() == 2
    none, _ = RT.tfidf_index(spark.createDataFrame([], "source string, chunk_id int, text string"))
    assert none.collect() == []


def test_tokens_are_the_jvms(spark):
    """Letters that are newer than the JVM's Unicode tables aside (the first of them is U+0870)."""
    chars = [chr(c) for c in [*range(0x20, 0x860), *range(0x3040, 0x3100), *range(0x4E00, 0x5200), *range(0x2150, 0x2189)]]
    texts = ["".join(chars[i : i + 64]) for i in range(0, len(chars), 64)] + [f"a{c}b" for c in "́²½Ⅷ_-٣"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    jvm = {r.i: r.toks for r in df.select("i", RT.tokens(F.col("t")).alias("toks")).collect()}
    own = {r.i: RT.TOKEN.findall(r.t) for r in df.select("i", F.lower("t").alias("t")).collect()}
    differ = [(i, jvm[i], own[i]) for i in jvm if jvm[i] != own[i]]
    assert not differ, differ[:3]
    assert np.array(list(jvm)).size == len(texts)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_scored_in_place_equals_the_full_product(spark, index, k, monkeypatch):
    """the rows are those of the full product, also when a batch is scored in many parts; no posting is joined."""
    postings, qv = index
    want = listed(RT.top_k(RT.similarity(qv, postings), k))
    monkeypatch.setattr(RT, "pruned_top_k", lambda *a: pytest.fail("postings were joined"))
    got = RT.rag_topk(queries(spark), corpus(spark), k)
    assert listed(got) == want and len(want) > k * 40
    chunks = RT.lowered(corpus(spark))
    vocab = RT.vocabulary(chunks, 12000)
    assert RT.scored_in_place(chunks, vocab, qv, k).count() <= k * qv.select("query_id").distinct().count() * 20


def test_scorer_parts_and_ties():
    """parts of a batch give the rows of the whole, ties by place; the floor drops what cannot be among the best."""
    r = np.random.default_rng(3)
    of, term = np.repeat(np.arange(300), 6), r.integers(0, 20, 1800)
    key = np.unique(of * 20 + term)
    of, term = key // 20, key % 20
    weight, place = np.round(r.random(len(of)), 1), r.permutation(300)
    qt = np.repeat(np.arange(20), 5)
    q, qw = np.tile(np.arange(5), 20), np.round(r.random(100), 1)
    score = np.zeros((300, 5))
    for c, t, w in zip(of, term, weight):
        for i in np.flatnonzero(qt == t):
            score[c, q[i]] += w * qw[i]
    want = {(j, c) for j in range(5) for c in sorted(range(300), key=lambda c: (-round(score[c, j], 9), place[c]))[:4]}
    for cells in (1, 500, 10**6):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(RT, "SCORER_CELLS", cells)
            scorer = RT.BatchScorer(q, qt, qw, 5, 20, 4)
            chunk, query, s = scorer(of, term, weight, place)
            assert set(zip(query.tolist(), chunk.tolist())) == want
            assert np.allclose(s, score[chunk, query]) and np.all(scorer.floor > 0)


def test_repeated_chunks_add_up_as_before(spark):
    """rows of one (source, chunk_id), also null ones, in different batches, are one chunk."""
    rows = [("a", 0, "red fish"), ("a", 0, "red cat"), ("b", 0, "red dog"), (None, 0, "red fox"), (None, 0, "red owl"), ("c", 1, "blue")]
    chunks = spark.createDataFrame(rows, "source string, chunk_id int, text string").repartition(6)
    qs = spark.createDataFrame([(1, "red"), (2, "red dog"), (None, "blue")], "query_id int, query string")
    postings, vocab = RT.tfidf_index(chunks)
    want = RT.top_k(RT.similarity(RT.vectorize(qs, vocab), written(postings, "test-postings")), 3)
    key = lambda d: sorted(((r.query_id, r.rank, r.source, r.chunk_id, round(r.score, 9)) for r in d.collect()), key=str)
    assert key(RT.rag_topk(qs, chunks)) == key(want) and len(key(want)) >= 6
    assert key(RT.rag_topk(qs, chunks, in_place=0)) == key(RT.pruned_top_k(RT.vectorize(qs, vocab), written(postings, "test-postings")))


def test_answers_cut_found_documents_only(spark):
    """the chunks for the answers come from the documents found."""
    docs = spark.createDataFrame([(f"d{i}", "x " * 900) for i in range(20)], "source string, text string")
    found = spark.createDataFrame([(1, 1, "d3", 2, 0.5), (2, 1, "d3", 0, 0.5)], "query_id int, rank int, source string, chunk_id int, score double")
    assert {r.source for r in RT.found_chunks(found, docs).collect()} == {"d3"}


def test_term_counter_equals_plain_counts(monkeypatch):
    """counts are kept over batches, and given out in parts when they are many."""
    r = random.Random(5)
    texts = [" ".join(r.choice(WORDS[:30]) for _ in range(r.choice([0, 1, 2, 9]))) for _ in range(300)] + [None, ""]
    want_cnt, want_df = {}, {}
    for t in texts:
        w = (t or "").split()
        terms = w + [" ".join(p) for p in zip(w, w[1:])]
        for x in terms:
            want_cnt[x] = want_cnt.get(x, 0) + 1
        for x in set(terms):
            want_df[x] = want_df.get(x, 0) + 1
    for limit in (10, 500, 10**6):
        monkeypatch.setattr(RT, "COUNTER_TERMS", limit)
        counter, cnt, df, outs = RT.TermCounter(), {}, {}, 0
        for i in range(0, len(texts), 50):
            counter.add(texts[i : i + 50])
            if counter.full() or i + 50 >= len(texts):
                outs += 1
                for b in counter.counted():
                    for row in b.to_pylist():
                        cnt[row["term"]] = cnt.get(row["term"], 0) + row["cnt"]
                        df[row["term"]] = df.get(row["term"], 0) + row["df"]
        assert df.pop("") == len(texts) and cnt.pop("") == 0
        assert (cnt, df) == (want_cnt, want_df) and (outs > 1) == (limit < 1000)
