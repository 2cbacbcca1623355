import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from riskops.llm import suffix

from .helpers import docs, hostile, words


def brute(rows, length=50):
    first = {}
    order = lambda i: i if i is not None else 2**63 - 1
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < order(i):
                gone[s : s + length] = True
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def shared_corpus():
    r = random.Random(8)
    passages = [words(r.randint(8, 40), 900 + k) for k in range(6)]
    rows = []
    for i in range(120):
        parts = [words(r.randint(0, 60), i), r.choice(passages), words(r.randint(0, 30), 500 + i)]
        text = " ".join(parts)
        if i % 5 == 0 and rows:
            near = list(rows[i // 2][1])
            for _ in range(3):
                if near:
                    near[r.randrange(len(near))] = "é"
            text = "".join(near)
        rows.append((1000 - i if i % 2 else i, text, "en", "a"))
    rows += [(2000, "a" * 300, None, None), (2001, "a" * 180 + "b" * 60, None, None), (2002, "ab" * 100, None, None), (2003, "\x00" * 90, None, None), (2004, "\x00" * 70 + "x", None, None)]
    return hostile(rows)


@pytest.mark.parametrize("batch,shard", [(2 << 20, 4 << 20), (3000, 700)])
def test_equals_brute_force(spark, monkeypatch, batch, shard):
    monkeypatch.setattr(suffix, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix.least_documents, "__defaults__", (50, shard))
    rows = shared_corpus()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicate(docs(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_documents_without_ids_come_last_however_they_are_dealt(spark, tmp_path, parts):
    passage, other = words(40, 77), words(40, 78)
    rows = [(None, f"{words(9, k)} {passage} {words(7, 50 + k)}", "en", "a") for k in range(5)] + [(None, f"{other} {k}", "en", "a") for k in range(4)]
    rows += [(None, f"{words(4, 99)} {passage[20:]} tail", "en", "a"), (1, f"{words(5, 300)} {passage} end", "en", "a"), (7, f"x {other[:120]} y", "en", "a")]
    docs(spark, rows).repartition(parts).write.parquet(str(tmp_path / "t"))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicate(spark.read.parquet(str(tmp_path / "t"))).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert suffix.deduplicate(docs(spark, [])).count() == 0


def test_suffix_array_and_common_prefixes():
    r = random.Random(2)
    for n in (1, 7, 60, 400):
        b = bytes(r.choice(b"ab") for _ in range(n)) + b"ab" * 40 + bytes(5)
        text = np.frombuffer(b, np.uint8)
        sa, rank = suffix.refined_suffixes(text, 50)
        cut = [b[i : i + 50].ljust(50, b"\0") for i in sa]
        assert cut == sorted(cut) and sorted(sa) == list(range(len(b)))
        lcp = suffix.common_prefixes(text, sa, 50, lanes=7)
        for k in range(1, len(b)):
            x, y = b[sa[k - 1] :], b[sa[k] :]
            want = next((d for d in range(min(len(x), len(y))) if x[d] != y[d]), min(len(x), len(y)))
            assert lcp[k] == min(50, want)
