"""The consent gate's state (F24): a patient's rows of a batch are one state row, ids keep all their digits."""

from pyspark.sql import functions as F

from riskops.operators import logs
from riskops.sources import adapters as A
from riskops.streaming import jobs

GATE = ["prediction_id", "patient_id", "reason", "allowed"]
BIG = 2**53 + 1


def events(spark, folder, first=0, odd=()):
    """120 events of three patients and of none, a fifth of them sign-ups, numbered from ``first``."""
    e = spark.range(120).select((F.col("id") + first).alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 % 120 as int))").alias("ts"),
                                F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("user_id"), F.when(F.col("id") % 5 == 0, "signup").otherwise("view").alias("event_type"),
                                F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("id").cast("string"), F.lit("}")).alias("props"))
    if odd:
        e = e.unionByName(spark.createDataFrame(odd, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    e.coalesce(1).write.parquet(f"{folder}/events.parquet")


def same_as_the_batch_twin(spark, folder):
    got, twin = jobs.stream_consent_gate(spark, folder), logs.consent_gate_as_of(A.assessments(spark, folder), A.consents(spark, folder), "risk_scoring")
    rows = [sorted(map(str, df.select(*GATE).collect())) for df in (got, twin)]
    assert rows[0] == rows[1]
    return rows[0]


def test_a_batch_adds_one_state_row_a_patient(spark, tmp_path, monkeypatch):
    events(spark, str(tmp_path))
    updated = []

    def once(spark, start, beats, closing):
        q = start()
        q.awaitTermination()
        updated.append(q.recentProgress[0]["stateOperators"][0]["numRowsUpdated"])
        return 0

    monkeypatch.setattr(jobs, "run_and_close", once)
    jobs.stream_consent_gate(spark, str(tmp_path))
    assert updated == [3]


def test_large_ids_are_not_rounded(spark, tmp_path):
    events(spark, str(tmp_path), first=BIG)
    rows = same_as_the_batch_twin(spark, str(tmp_path))
    assert len(rows) == 120 and any(f"prediction_id={BIG + 1}," in r for r in rows)


def test_rows_without_an_id_or_a_time(spark, tmp_path):
    odd = [(None, None, 1, "view", 1.0, '{"k": 3}'), (200, None, 2, "signup", 1.0, '{"k": 3}'), (None, None, 2, "view", 1.0, None), (201, None, 9, "signup", 1.0, None)]
    events(spark, str(tmp_path), odd=odd)
    assert len(same_as_the_batch_twin(spark, str(tmp_path))) == 124
