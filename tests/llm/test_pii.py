import hashlib
import random
import re
from collections import Counter

from riskops.llm import pii

from .helpers import docs, hostile

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), n, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_base_spans_equal_brute_force(spark):
    r = random.Random(3)
    bits = ["a", "@", ".", "b.c", " ", "+", "-", "1", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "x@y.zz", "%", "1.2.3.4", "\U0001f600", "é", "00", "\n", "(", "a@b.c%d@e.f"]
    rows = hostile([(100 + i, "".join(r.choice(bits) for _ in range(r.randint(1, 25))), "en", "a") for i in range(600)])
    rows += [(5000, "1" * 50_000, None, None), (5001, "a" * 50_000 + "@b.c " + "1 " * 30_000, None, None), (5002, "." * 20_000 + "+1" + "(" * 20_000, None, None)]
    base = lambda spans: ",".join(s for s in spans.split(",") if not s.startswith("term:"))  # the method may add terms
    got = Counter((r.doc_id, r.base_sha256, base(r.spans), r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.find(docs(spark, rows)).collect())
    want = Counter((i, hashlib.sha256(",".join(b).encode()).hexdigest(), ",".join(b), len(b)) for i, t, *_ in rows for b in [brute(t)])
    assert got == want


def corpus():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, text(200), "en", "a") for i in range(200)]
    told = [(1000 + i, f"{text(40)} {r.choice(vocabulary)} Nightjar {r.choice(vocabulary)} wrote to k.roe@corp.example today {text(40)}", "en", "a") for i in range(12)]
    alone = [(2000, text(30) + " nightjar " + text(30), "en", "a")]
    copies = [(3000 + i, "rarewordone came from z@copy.example again", "en", "a") for i in range(50)]
    return rows, told, alone, copies


def test_terms_that_disclose_an_entity_are_found(spark):
    rows, told, alone, copies = corpus()
    frame = docs(spark, rows + told + alone + copies)
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    texts = {i: t for i, t, *_ in rows + told + alone + copies}
    words = lambda i: {texts[i][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if k == "term"}
    assert all("nightjar" in words(i) for i, *_ in told) and words(2000) == {"nightjar"}
    assert not any(words(i) for i, *_ in rows + copies)  # copies are one context
    clean = pii.sanitise(frame)
    assert clean.columns == frame.columns
    out = {r.doc_id: r for r in clean.collect()}
    assert all("ightjar" not in out[i].text and "[EMAIL]" in out[i].text and out[i].n_chars == len(out[i].text) for i, *_ in told)
    assert all(out[i].text == t for i, t, *_ in rows)


def test_short_terms_and_terms_at_the_ends_of_texts(spark):
    rows, *_ = corpus()
    r = random.Random(4)
    some = lambda: "".join(r.choice("mnopqrst") for _ in range(6))
    told = {
        "kim": [f"{some()} Kim {some()} at kim.l@corp.example now {some()}" for _ in range(12)],
        "firstword": [f"Firstword {some()} has first@corp.example {some()}" for _ in range(12)],
        "lastword": [f"{some()} write to last@corp.example {some()} Lastword" for _ in range(12)],
        "\u91d1\u6c38": [f"{some()} \u91d1\u6c38 {some()} cjk@corp.example {some()}" for _ in range(12)],
    }
    texts = {5000 + 100 * k + n: (term, t) for k, (term, ts) in enumerate(told.items()) for n, t in enumerate(ts)}
    got = {x.doc_id: x.spans for x in pii.find(docs(spark, rows + [(i, t, "en", "a") for i, (_, t) in texts.items()])).collect()}
    for i, (term, t) in texts.items():
        found = {t[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in got[i].split(",")) if k == "term"}
        assert term in found, (i, t, got[i])


def test_many_terms_are_joined_with_the_same_result(spark, monkeypatch):
    rows, told, alone, copies = corpus()
    frame = docs(spark, rows + told + alone + copies)
    in_row = Counter((r.doc_id, r.spans) for r in pii.find(frame).collect())
    monkeypatch.setattr(pii, "TERMS_IN_ROW", 0)
    assert Counter((r.doc_id, r.spans) for r in pii.find(frame).collect()) == in_row


def test_a_word_that_the_window_cuts_is_no_term(spark):
    long = " ".join("abcdefgh"[k % 8] * 9 for k in range(30))
    rows = [(i, f"{long[: 200 + i]} a{i}@b.co {long[i:]}", "en", "a") for i in range(20)]
    base = pii.base_table(docs(spark, rows)).collect()
    for r in base:
        text = rows[r.doc_id][1]
        for s in r.base:
            assert all(w in text.split() for w in s.left.split()) and all(w in text.split() for w in s.right.split())


def test_hostile_and_empty_tables(spark):
    frame = docs(spark, hostile())
    assert Counter(pii.sanitise(frame).collect()) == Counter(frame.collect())
    assert pii.sanitise(docs(spark, [])).count() == 0 and pii.find(docs(spark, [])).count() == 0


def test_overlapping_spans_are_replaced_once(spark):
    frame = docs(spark, [(1, "call +4111111111111111 or a@b.co, 1.2.3.4!", "en", "a")])
    assert pii.sanitise(frame).first().text == "call +[CARD] or [EMAIL], [IP]!"
