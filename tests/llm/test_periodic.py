"""op13 against brute force over every period, on random words and on whole texts; hostile tables."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from riskops.llm import periodic as P

from .helpers import docs, hostile, words


def brute(w, least_words=6, least_exponent=4):
    found = {}
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_exponent * q):
                found.setdefault((i, j + q - i), q)  # the first period is the least
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        batch = []
        for _ in range(r.randint(1, 5)):
            w = [r.randint(1, r.choice([1, 2, 3, 5, 20])) for _ in range(r.choice([0, 1, 2, 5, 8, 13, 40, 120]))]
            if r.random() < 0.5 and len(w) > 4:
                a = r.randrange(len(w))
                p = 1 + (len(w) - a) // r.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            batch.append(w)
        coded = np.array([x for w in batch for x in [*w, 0]], np.int64)
        ends = np.cumsum([len(w) + 1 for w in batch])
        for least in ((6, 4), (2, 2)):
            got = [[] for _ in batch]
            for d, *run in zip(*(x.tolist() for x in P.runs(coded, ends, *least))):
                got[d].append(tuple(run))
            assert got == [brute(w, *least) for w in batch]


def test_suffix_arrays_and_prefixes():
    r = np.random.default_rng(2)
    for high in (2, 3, 50):
        sizes = r.integers(0, 40, 6)
        coded = np.concatenate([np.append(r.integers(1, high, n), 0) for n in sizes])
        ends = np.cumsum(sizes + 1)
        doc = np.repeat(np.arange(6), sizes + 1)
        sa, isa, lcp = P.suffix_array(coded, doc)
        tails = [(int(d), *coded[i : ends[d]].tolist()) for i, d in enumerate(doc)]
        assert [tails[i] for i in sa] == sorted(tails) and np.array_equal(sa[isa], np.arange(len(coded)))
        for k in range(1, len(sa)):
            a, b = tails[sa[k - 1]], tails[sa[k]]
            if a[0] == b[0]:
                assert lcp[k] == next((n for n, (x, y) in enumerate(zip(a[1:], b[1:])) if x != y), min(len(a), len(b)) - 1)


def spoilt(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    return w


def row(i, text):
    w = spoilt(i, text)
    runs = brute(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(top + (1000 * top[1] // top[2],) if top else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_whole_texts_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.randint(0, 60))), "en", "a") for k in range(100, 220)]
    rows += [(k, words(150, k) + " \x0b" + "x y " * (k % 9) + "\x85   ü", "en", "a") for k in range(220, 320)]
    rows = hostile(rows + [(500, "a " * 5000, "en", "a"), (501, "tick tock tack " * 900 + "end", "en", "a"), (502, words(4000, 8), "en", "a")])
    got = P.digest(P.find(docs(spark, rows).withColumn("own", P.planted()), text="own"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda t: tuple((x is None, x or 0) for x in t[:-2]) + t[-2:]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((row(i, t) for i, t, *_ in rows), key=key)
    assert got.where(F.col("n_runs") > 0).count() > 20


def test_runs_and_texts_of_the_operator(spark):
    out = P.find(docs(spark, [(1, "go la la la la la la stop a b a b a b a b", "en", "a")])).first()
    assert [tuple(r) for r in out.runs] == [(1, 6, 1), (8, 8, 2)] and out.collapsed == "go la stop a b" and out.n_words == 16
    assert P.find(docs(spark, [])).collect() == [] and P.digest(P.find(docs(spark, []))).collect() == []
