"""Commits are whole or not there; files of any size are hashed in chunks."""

import hashlib
import json
import os

import pytest

from riskops.sources import commits as CM
from riskops.sources import scans as S


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_log_batches_are_there_once(spark, tmp_path):
    log = str(tmp_path / "log")
    a, b = (spark.createDataFrame([(i, s) for i in r], "k int, day string") for r, s in (((1, 2), "x"), ((3,), "y")))
    assert CM.read_log(spark, log, a.schema).collect() == []
    assert CM.append_batch(a, log, 0, ["day"]) and CM.append_batch(b, log, 1, ["day"])
    assert not CM.append_batch(b, log, 1, ["day"]) and not CM.append_batch(a.limit(1), log, 0)
    assert rows(CM.read_log(spark, log)) == [(1, "x", 0), (2, "x", 0), (3, "y", 1)]
    c = spark.createDataFrame([(4, 0.5)], "k int, more double")
    c.write.parquet(f"{log}/{CM.DATA}/batch-000000000007-half")  # no manifest: its run ended
    assert CM.read_log(spark, log).count() == 3
    assert CM.append_batch(c, log, 7)
    assert rows(CM.read_log(spark, log).select("k", "day", "more", "batch_id").where("k = 4")) == [(4, None, 0.5, 7)]
    empty = spark.createDataFrame([], "k int, day string")
    assert CM.append_batch(empty, log, 8) and CM.read_log(spark, log).count() == 4


def test_of_two_writers_of_a_batch_one_wins(spark, tmp_path):
    path = str(tmp_path / "m" / "batch.json")
    assert CM.put(spark, path, {"a": 1}) and not CM.put(spark, path, {"a": 2})
    assert CM.get(spark, path) == {"a": 1} and CM.put(spark, path, {"a": 3}, replace=True) and CM.get(spark, path) == {"a": 3}
    assert [f for f in os.listdir(tmp_path / "m") if f.endswith(".json")] == ["batch.json"] and CM.get(spark, str(tmp_path / "none")) is None


def test_pointer_moves_in_one_step(spark, tmp_path):
    base = str(tmp_path / "models")
    assert CM.latest(spark, base) is None
    for v in ("1", "2"):
        CM.publish(spark, base, v, f"model_v{v}")
        assert CM.latest(spark, base) == {"version": v, "folder": f"model_v{v}"}
    assert json.loads((tmp_path / "models" / "latest.json").read_text())["version"] == "2"


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_files_are_hashed_in_chunks(spark, tmp_path, chunk):
    content = {"a.bin": b"", "b c.txt": b"x" * 100_000, "sub/d.bin": bytes(range(256)) * 999, "ü%20.bin": b"odd name"}
    for name, data in content.items():
        (tmp_path / "files" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / name).write_bytes(data)
    got = {r.path.rsplit("/files/", 1)[1]: (r.length, r.sha256) for r in S.file_sha256(spark, str(tmp_path / "files"), chunk).collect()}
    assert sorted(got.values()) == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in content.values() if d)


def test_text_files_whole(spark, tmp_path):
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1" / "one.txt").write_text("first\nsecond\n")
    (tmp_path / "day=1" / "empty.txt").write_text("")
    got = {r.source: (r.text, r.day) for r in S.read_text_documents(spark, str(tmp_path)).collect()}
    assert got["one.txt"] == ("first\nsecond\n", 1) and got.get("empty.txt", ("", 1))[0] in ("", None)
