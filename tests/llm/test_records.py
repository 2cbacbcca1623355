"""op11: frames and checksums by hand, files read back in both ways, damage, hostile tables."""

import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskops.llm import packing, records, tokens

from .helpers import docs, hostile, words


def slow_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums_equal_a_bitwise_one():
    r = np.random.default_rng(0)
    many = [1, 2, 3, 63, 64, 65, 128, 129, 1000]
    data = r.integers(0, 1 << 32, sum(many), dtype=np.uint64).astype(np.uint32)
    first = np.cumsum([0, *many[:-1]])
    got = records.masked_crc32c(data, first, np.array(many))
    assert got.tolist() == [slow_crc(data[a : a + n].tobytes()) for a, n in zip(first, many)]
    assert slow_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def expected(rows):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_hold_the_sequences_and_read_back_in_order(spark, tmp_path):
    rows = hostile([(k, words(20 + k % 7, k), "en", "a") for k in range(100, 300)])
    written = records.write(docs(spark, rows), str(tmp_path / "r"), shard_bytes=4096)
    got = sorted(map(tuple, records.read(written).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    ids = [r[0] for r in got]
    known = [i for i in ids if i is not None]
    assert known == sorted(known) and ids == known + [None] * 2
    assert sorted((i is None, i or 0, n, c) for i, _, n, c in got) == sorted((i is None, i or 0, len(x), crc(x)) for i, x in expected(rows))
    files = sorted(glob.glob(str(tmp_path / "r/data/*")))
    assert len(files) > 3
    raw, at, seen = open(files[0], "rb").read(), 0, []
    while at < len(raw):  # the format, by hand
        size = int.from_bytes(raw[at : at + 8], "little")
        assert int.from_bytes(raw[at + 8 : at + 12], "little") == slow_crc(raw[at : at + 8])
        body = raw[at + 12 : at + 12 + size]
        assert int.from_bytes(raw[at + 12 + size : at + 16 + size], "little") == slow_crc(body)
        n = int.from_bytes(body[12:16], "little")
        assert int.from_bytes(body[:4], "little") == 3 and len(body) == 16 + -(-n // 2) * 4
        seen.append((int.from_bytes(body[4:12], "little"), n, crc(np.frombuffer(body[16 : 16 + 2 * n], "<u2"))))
        at += size + 16
    assert seen == [(r[0], *r[2:]) for r in got[: len(seen)]]


def test_shuffled_reads_seek_every_record_once(spark, tmp_path):
    rows = [(k, words(5 + k % 11, k), "en", "a") for k in range(200)]
    written = records.write(docs(spark, rows), str(tmp_path / "r"), shard_bytes=2048)
    one, again, other = ([(r.part, r.doc_id, tuple(r.ids)) for r in records.read_shuffled(written, seed, 3).orderBy("part", "place").collect()] for seed in (1, 1, 2))
    assert one == again and one != other
    assert sorted((i, x) for _, i, x in one) == [(i, tuple(x)) for i, x in expected(rows)]
    assert [i for _, i, _ in one] != sorted(i for _, i, _ in one)


def test_four_byte_ids():
    ids, ends = np.array([70000, 1, 2, 3], np.uint32), np.array([0, 1, 1, 4])
    out, size = records.frames(pa.array([5, None, -2]), ids, ends, 4)
    words, at = records.check(out.tobytes(), [0, *(4 * np.cumsum(size)).tolist()], "x")
    doc_ids, own = records.decoded(words, at)
    assert doc_ids.to_pylist() == [5, None, -2] and [x.tolist() for x in own] == [[70000], [], [1, 2, 3]]


def test_damage_is_an_error(spark, tmp_path):
    written = records.write(docs(spark, [(k, words(9, k), "en", "a") for k in range(20)]), str(tmp_path / "r"))
    (file,) = glob.glob(str(tmp_path / "r/data/*"))
    raw = bytearray(open(file, "rb").read())
    for change in (30, 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[change] ^= 1
        open(file, "wb").write(bad)
        with pytest.raises(Exception, match="part-000000"):
            records.read(written).collect()
    open(file, "wb").write(raw[:-5])
    with pytest.raises(Exception, match="cut off"):
        records.read(written).collect()


def test_empty_table_and_long_frame(spark, monkeypatch):
    empty = records.write(docs(spark, []))
    assert records.read(empty).collect() == [] and records.read_shuffled(empty, 1, 2).collect() == [] and empty.index.collect() == []
    long = [(1, words(60000, 3), "en", "a"), (2, "x", "en", "a")]
    monkeypatch.setattr(records, "READ_BYTES", 1 << 10)
    got = records.read(records.write(docs(spark, long))).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), crc(x)) for i, x in expected(long)]


def test_tokens_equal_the_tokenizer_also_when_words_are_dropped():
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    own = tokens.WordTokens(records.TOKENIZER, cache=40)
    texts = [words(30, k % 9) + ". Größe!! \t<|x|> a.b, c..  d" * (k % 3) + (" <|endoftext|>" if k % 4 == 0 else "") for k in range(60)] + ["", None, " \n"]
    for k in range(0, len(texts), 7):
        ids, ends = own(pa.array(texts[k : k + 7], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts[k : k + 7]]
    assert len(own.index) < 400
    with pytest.raises(ValueError):
        tokens.WordTokens("byte_bpe_50k.json")
    assert packing.TOKENIZER == records.TOKENIZER
