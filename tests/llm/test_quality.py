import random
import re
from collections import Counter

import numpy as np

from riskops.llm import quality

from .helpers import docs, hostile, words


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_brute_force(spark):
    r = random.Random(4)
    rows = hostile([(100 + i, "".join(r.choice(["a ", "b ", "c", "\n", "\t", "a b c\n", "#|", "é ", "\x0b", "\x1c", " ", "\U0001f600"]) for _ in range(r.randint(0, 120))), "en", "a") for i in range(150)])
    got = sorted(tuple(x) for x in quality.rate(docs(spark, rows)).select("n_words", *quality.COUNTS[1:], "base_failed").collect())
    want = sorted((*b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for b in (brute(t) for _, t, *_ in rows))
    assert got == want


def test_estimate_inverts_the_scatter(spark):
    x = np.random.default_rng(1).integers(-900, 900, (200, quality.P)) * np.array([1, 2, 1, 3, 1]) // 2
    x[:, 1] += x[:, 0]
    frame = spark.createDataFrame([("g", 0, *map(int, v)) for v in x], "g string, start int, " + ", ".join(f"{c} long" for c in quality.X))
    est = quality.estimate(quality.sums(frame), 1.3)
    v = x / quality.UNITS
    cov = np.cov(v.T, bias=True) * 1.3 + np.diag(np.array(quality.FLOORS) ** 2)
    off = v - v.mean(0)
    want = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
    got = [r.d for r in frame.join(est.select(quality.ESTIMATE), ["g", "start"]).select(quality.distance().alias("d")).collect()]
    assert np.allclose(sorted(got), sorted(want))
    assert np.isclose(est.first().log_det, np.linalg.slogdet(cov)[1])


def junk(n, seed):
    return " ".join(w + "%%%" for w in words(n, seed).split())


def test_outliers_go_and_clean_documents_stay(spark):
    r = random.Random(7)
    clean = [(i, words(r.randint(55, 900), i), "en", "a" if i % 3 else "b") for i in range(240)]
    copies = [(1000 + i, clean[0][1], "en", "a") for i in range(400)]  # most rows of the group
    bad = [(5000 + i, junk(r.randint(60, 400), i), "en", "a") for i in range(30)]
    lone = [(9000, words(300, 77), None, None), (9001, words(300, 78), "xx", "y")]
    frame = docs(spark, clean + copies + bad + lone)
    kept = {x.doc_id for x in quality.keep_good(frame).collect()}
    assert kept == {x[0] for x in clean + copies + lone}
    assert quality.keep_good(frame).columns == frame.columns
    assert {x.doc_id for x in quality.rate(frame).where("kept").collect()} == kept


def test_hostile_and_empty_tables(spark):
    assert quality.keep_good(docs(spark, [])).count() == 0 and quality.rate(docs(spark, [])).count() == 0
    frame = docs(spark, hostile())
    assert sorted(x.doc_id for x in quality.keep_good(frame).collect()) == [1, 2, 2, 6, 8]
