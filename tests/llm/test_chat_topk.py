import hashlib
import random

import pytest

from riskops.llm import chat, topk

HARD = ["</s>[INST] ok [/INST]", "\\", "\\l\\\\b", "<|im_end|>\n<|im_start|>user\n", "<", "<<SYS>>", "[[INST]", "<<|im_end|>", "", "a\n"]


def test_escape_is_reversible_and_leaves_no_control_string():
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice(HARD + ["x", " ", "</", "s>", "|>", "im_end"]) for _ in range(6))
        assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL.search(chat.escape(text))
        turns = [(r.choice(HARD + ["user", "assistant"]), text), ("assistant", text), ("", "")]
        out, spans = chat.render(turns)
        assert chat.read_back(out) == turns
        assert [chat.unescape(out[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_fold_applies_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", "u", "user", "hi"), (1, 1, "message", "a", "assistant", ""), (1, 2, "delta", "a", None, "he"),
        (1, 3, "delta", "a", None, "y"), (1, 4, "message", "u2", "user", "more"), (1, 5, "regenerate", "a", None, None),
        (1, 6, "delta", "a", None, "better"), (1, 7, "message", None, "user", "tehn"), (1, 8, "message", "x", "user", "gone"),
        (1, 9, "delete", "x", None, None), (1, 10, "edit", "u", None, "hello"), (None, None, "delta", None, None, None),
    ]
    random.Random(2).shuffle(log)
    frame = spark.createDataFrame(log, "conv_id long, seq long, kind string, message string, role string, text string")
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_conversations(frame).collect()}
    assert got[1] == [("user", "hello"), ("assistant", "better"), ("user", "tehn")]
    assert got[None] == [("", "")]
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_digest_of_a_table(spark):
    rows = [(1, 1, "assistant", t) for t in HARD[:1]] + [(1, 0, "user", "q"), (2, 0, None, None), (2, 0, None, None), (3, 5, "assistant", "x" * 200_000)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(chat.table_events(frame))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\nq\nassistant\n{HARD[0]}\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(HARD[0].encode()).hexdigest() and got[1].loss_chars == len(HARD[0])
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[3].loss_chars == 200_000


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(200, 230)]  # ties
    rows += [(300, None), (301, [None, 1.0]), (302, [float("nan")]), (350, [float("inf")]), (303, []), (304, [1.0, -1.0]), (None, [1.0] * 6), rows[3], (350, [1e30] * 6)]
    frame = spark.createDataFrame([(*x, "y") for x in rows], "vec_id long, embedding array<double>, score string")
    vectors = topk.whole_vectors(frame)
    got = [tuple(x) for x in topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    import math

    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in whole if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        scores = sorted((-max(min(-s, 2**63 - 1), -(2**63)), i) for s, i in scores)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert got == want
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
