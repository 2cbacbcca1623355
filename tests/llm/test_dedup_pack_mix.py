import itertools
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash

from riskops.llm import mixing, packing, simhash, tokens

from .helpers import DOC_SCHEMA, docs, hostile, words


def brute_fingerprint(text):
    w = (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    rows = hostile([(100 + i, words(40, 5) + " " + words(i % 4, i), "en", "a") for i in range(60)])
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t, _, _ in rows]
    roots = brute_components(prints)
    least = defaultdict(list)
    for (i, *_), r in zip(rows, roots):
        least[r] += [i] if i is not None else []
    want = sorted((str(i), f"{p:016x}", str(min(least[r], default=None))) for (i, *_), p, r in zip(rows, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_simhash_tiles_split_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    import random

    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(150)} | {sum(1 << b for b in c) for c in itertools.combinations(range(40, 52), 3)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    frame = spark.createDataFrame(signed, "fp long")
    found = {row.node: row.root for row in simhash.components(simhash.links(frame)).collect()}
    fps = sorted(x[0] for x in signed)
    roots = brute_components([x & (2**64 - 1) for x in fps])
    group = defaultdict(list)
    for x, k in zip(fps, roots):
        group[k].append(x)
    assert all(found.get(x, x) == min(group[k]) for x, k in zip(fps, roots))


def test_one_of_each_keeps_one_document_per_group(spark):
    frame = docs(spark, hostile())
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 3, 6, 7, 9] or sorted(x for x in ids if x is not None) == [1, 3, 6, 7, 8, 9]
    assert ids.count(None) == 1  # the null text joins the group of 3


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.one_of_each(docs(spark, [])).columns == docs(spark, []).columns


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_ids_are_the_texts_ids():
    t = encoder()
    texts = ["Hello,  world it's 42!", "", "a b\x1cc\u3000d", "ΣΑΣ ΟΔΟΣ\u0301 é", "x<|endoftext|> y", words(500, 4), "가 힣",
             "<|ENDOFTEXT|> A, b.) c!!\u0301 d, é, it's. don'T! x..., ,y .,", "<|endoftext|", "A\u030a, B? ÉÀß ªº µ İ \xad ÿ ñandú"]
    own = tokens.WordTokens(packing.TOKENIZER)
    want = [t.encode(text, add_special_tokens=False).ids for text in texts]
    for _ in range(2):
        ids, ends = own(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    import pytest

    with pytest.raises(ValueError):
        tokens.WordTokens("byte_bpe_50k.json")


def test_packing_is_whole_and_gapless(spark):
    rows = hostile([(200 + i, words(3 + i * 7, i), "en", "a") for i in range(80)])
    got = packing.pack(docs(spark, rows)).collect()
    t = encoder()
    want = defaultdict(int)
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(k[3] * n for k, n in want.items()) // 2048) + 1


def test_packing_rank_is_split_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BUCKET", 7)
    got = packing.pack(docs(spark, [(i, "same words here", "en", "a") for i in range(100)])).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 100


@pytest.mark.parametrize("counts,room", [({3: 2, 5: 1, 9: 4}, 14), ({7: 3}, 20), ({2: 5, 11: 1}, 1), ({4: 9, 6: 2}, 25)])
def test_fullest_is_the_best_subset_sum(counts, room):
    best = max(
        total for pick in itertools.product(*(range(c + 1) for c in counts.values()))
        if (total := sum(x * k for x, k in zip(counts, pick))) <= room
    )
    found = packing.fullest(counts, room)
    assert sum(x * k for x, k in found) == best and all(k <= counts[x] for x, k in found)


def test_packing_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_pfair_lag_stays_below_one_block():
    slots = mixing.shares({"a": 5.0, "b": 3.3, "c": 0.01, None: 1.7}, 512)
    done = defaultdict(int)
    for source, j, slot, release, deadline in mixing.schedule(slots):
        assert release <= slot < deadline and done[source] == j
        done[source] += 1
        assert all(abs(done[s] - n * (slot + 1) / 512) < 1 for s, n in slots.items())
    assert done == slots


def test_mix_keeps_every_row_and_the_shares(spark):
    rows = [(i, words(3, i), "en", "big" if i % 2 else ["x", "y", None][i % 3]) for i in range(900)] + hostile()
    frame = docs(spark, rows)
    got = mixing.mix(frame, {"big": 0.5, "x": 0.3, "y": 0.2}, block_docs=4, period=64).orderBy("mix_order").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert len({r.mix_order for r in got}) == len(got)
    assert all(r.released <= r.slot < r.deadline for r in got)
    blocks = {(r.source, r.block): r.slot for r in got}
    slots = mixing.shares({"big": 0.5, "x": 0.3, "y": 0.2} | dict.fromkeys([None, "", "a", "b", "c"], 0.0), 64)
    for t in range(1, 65):  # the sources of weight last so long
        for s in ("big", "x", "y"):
            assert abs(sum(1 for (src, _), slot in blocks.items() if src == s and slot < t) - slots[s] / 64 * t) < 1
    ordered = mixing.in_mix_order(frame)
    assert ordered.columns == frame.columns and ordered.count() == len(rows)


def test_exact_schedule_holds_the_targets():
    targets = {"a": 0.61803398875, "b": 0.38185, "c": 1 / 9973, "d": 0.0000157}  # two below 1/4096
    shares = mixing.exact(targets)
    total, sums = sum(shares.values()), sum(targets.values())
    assert all(abs(shares[s] / total - w / sums) < 1e-12 for s, w in targets.items())
    n = 60_000
    done = defaultdict(int)
    blocks = {s: int(n * w / sums) + 2 for s, w in targets.items()}
    for t, (source, j, slot, release, deadline) in zip(range(n), mixing.timetable(shares, blocks)):
        assert release <= slot < deadline and slot == t and done[source] == j
        done[source] += 1
        assert all(abs(done[s] - (t + 1) * w / sums) < 1 for s, w in targets.items())
    every = list(mixing.timetable(mixing.exact({"a": 0.9, "b": 0.1, "c": 0.0}), {"a": 3, "b": 50, "c": 2}))
    assert len(every) == 55 and all(r <= slot < d for _, _, slot, r, d in every) and len({x[2] for x in every}) == 55


def test_mix_holds_the_target_weights(spark):
    rows = [(i, "t", "en", "big" if i % 16 else "small") for i in range(8000)]
    got = mixing.mix(docs(spark, rows), {"big": 4999.5, "small": 0.5}, block_docs=1).orderBy("mix_order").collect()
    slots = sorted(r.slot for r in got if r.source == "small")
    assert all(abs(k + 1 - 0.0001 * (slot + 1)) < 1 for k, slot in enumerate(slots))  # rounded to 1/4096, the second came at 4096
    assert len({r.slot for r in got}) == len(rows) and all(r.released <= r.slot < r.deadline for r in got)


@pytest.mark.parametrize("bucket", [4096, 16])
def test_sequences_follow_the_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "RANK_BUCKET", bucket)
    frame = docs(spark, [(i, words(10 + i * 7 % 40, i), "en", "xy"[i % 2]) for i in range(1200)])

    def packed(weights):
        return packing.pack(mixing.with_place(frame, "p", weights, 2), 256, place="p").collect()

    source_of = lambda r: "xy"[r.doc_id % 2]
    ids = {}
    for weights in ({"x": 0.8, "y": 0.2}, {"x": 0.3, "y": 0.7}):
        got = packed(weights)
        assert len({(r.doc_id, r.piece) for r in got}) == len(got) == packing.pieces(frame, 256).count()
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        assert sorted(bins) == list(range(len(bins)))
        for spans in bins.values():
            assert [o for o, _ in sorted(spans)] == [0, *itertools.accumulate(n for _, n in sorted(spans))][:-1] and sum(n for _, n in spans) <= 256
        early = [source_of(r) for r in got if r.sequence_id < len(bins) // 2]
        assert abs(early.count("x") / len(early) - weights["x"]) < 0.05
        ids[weights["x"]] = sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in got)
    assert ids[0.8] != ids[0.3]


def test_packing_in_order_of_an_empty_table(spark):
    assert packing.pack(mixing.with_place(docs(spark, []), "p"), place="p").count() == 0


def test_mix_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert spark.createDataFrame([], DOC_SCHEMA).columns == mixing.in_mix_order(docs(spark, [])).columns
