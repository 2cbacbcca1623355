from collections import Counter

import corpus_pipeline
from riskops.llm import mixing
from riskops.llm.common import written

from .helpers import docs, words
from .test_dedup_pack_mix import encoder


def test_stages_chain_and_take_effect(spark, tmp_path):
    clean = [(i, words(80 + i, i) + (f" mail a{i}@c.example now" if i % 10 == 0 else ""), "en", f"s{i % 3}") for i in range(60)]
    copies = [(1000 + i, clean[i][1], "en", "s9") for i in range(20)]
    short = [(2000, "too short", "en", "s0"), (2001, None, None, None)]
    frame = docs(spark, clean + copies + short)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), name)
        assert now.columns == frame.columns
        kept.append(sorted(r.doc_id for r in now.collect()))
    assert kept == [sorted(i for i, *_ in clean + copies)] + [list(range(60))] * 3
    texts = {r.doc_id: r.text for r in now.collect()}
    assert texts[10] == clean[10][1].replace("a10@c.example", "[EMAIL]") and texts[11] == clean[11][1]
    t = encoder()
    want = Counter({i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts.items()})
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_mix_reaches_the_sequences(spark, tmp_path, monkeypatch):
    docs(spark, [(i, words(60, i), "en", "xy"[i % 2]) for i in range(400)]).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def sequences(weights):
        place = mixing.with_place
        monkeypatch.setattr(mixing, "with_place", lambda d, order: place(d, order, weights, 2))
        got = corpus_pipeline.pack_sequences(spark, frame, str(tmp_path)).collect()
        monkeypatch.setattr(mixing, "with_place", place)
        return sorted((r.sequence_id, r.offset, r.doc_id) for r in got)

    many, few = sequences({"x": 0.9, "y": 0.1}), sequences({"x": 0.1, "y": 0.9})
    first = [sum(i % 2 == 0 for s, _, i in got if s < 4) / sum(s < 4 for s, _, _ in got) for got in (many, few)]
    assert first[0] > 0.7 and first[1] < 0.3
