"""Keyed stream state (H3, H4, H6, H7): tables in three parts out of order, one file a batch, equal the batch twins; restarts."""

import glob

import pytest
from pyspark.sql import functions as F

from conftest import TINY
from riskops.operators import logs
from riskops.session import scratch_path
from riskops.sources import adapters as A
from riskops.streaming import jobs, state


def parts(spark, folder, deal, which=(0, 1, 2)):
    """The events of TINY as files, by ``deal`` (a part number for each row); files are read in the order of their names' times."""
    e = spark.read.parquet(f"{TINY}/events.parquet").withColumn("part", deal)
    for k in which:
        e.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def mixed():
    return F.pmod(F.xxhash64("event_id"), F.lit(3))


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


GATE = ["prediction_id", "patient_id", "reason", "allowed"]


def as_of(spark, folder):
    return logs.consent_gate_as_of(A.assessments(spark, folder), A.consents(spark, folder), "risk_scoring")


def test_gate_equals_the_batch_twin_out_of_order(spark, tmp_path):
    parts(spark, str(tmp_path), mixed())
    got = jobs.stream_consent_gate(spark, str(tmp_path), watermark="1000 days", max_files=1)
    assert rows(got, *GATE) == rows(as_of(spark, TINY), *GATE)


def test_gate_with_a_short_delay_and_disorder_inside_it(spark, tmp_path):
    """Parts by time, but each hour's rows spread over the part before or after: half a day of delay covers it."""
    e = spark.read.parquet(f"{TINY}/events.parquet")
    low, high = e.agg(F.min(F.col("ts").cast("timestamp").cast("double")), F.max(F.col("ts").cast("timestamp").cast("double"))).first()
    place = (F.col("ts").cast("timestamp").cast("double") + F.pmod(F.xxhash64("event_id"), F.lit(10_000)) - low) / (high + 10_001 - low)
    parts(spark, str(tmp_path), F.floor(place * 3))
    got = jobs.stream_consent_gate(spark, str(tmp_path), watermark="12 hours", max_files=1)
    assert rows(got, *GATE) == rows(as_of(spark, TINY), *GATE)


def test_gate_goes_on_after_a_restart(spark, tmp_path):
    parts(spark, str(tmp_path), mixed(), (0, 1))
    run = f"test-gate-{tmp_path.name}-{tmp_path.stat().st_ino}"
    first = jobs.stream_consent_gate(spark, str(tmp_path), watermark="1000 days", max_files=1, close=False, run=run)
    assert first.where("patient_id <> ''").count() == 0  # all wait for the watermark
    parts(spark, str(tmp_path), mixed(), (2,))
    got = jobs.stream_consent_gate(spark, str(tmp_path), watermark="1000 days", max_files=1, run=run)
    assert rows(got, *GATE) == rows(as_of(spark, TINY), *GATE)


def test_gate_by_hand(spark, tmp_path):
    """Times of one patient: a consent counts from its own time on, the greater seq of one time wins; anonymous requests pass."""
    c = spark.createDataFrame([("p", "2024-01-02", 5, True, ["risk_scoring"]), ("p", "2024-01-02", 4, False, ["risk_scoring"]), ("p", "2024-01-03", 6, True, ["chat_assessment"]),
                               ("p", "2024-01-04", 7, False, ["risk_scoring"])], "patient_id string, ts string, seq long, consent_given boolean, consent_scope array<string>")
    r = spark.createDataFrame([("p", "2024-01-01", 1), ("p", "2024-01-02", 2), ("p", "2024-01-03", 3), ("p", "2024-01-05", 4), (None, "2024-01-01", 5), ("", "2024-01-01", 6), ("q", "2024-01-01", 7)],
                              "patient_id string, ts string, prediction_id long")
    got = {x.prediction_id: x.reason for x in logs.consent_gate_as_of(r, c, "risk_scoring").collect()}
    assert got == {1: logs.CONSENT_REQUIRED, 2: None, 3: logs.CONSENT_SCOPE_MISSING + "risk_scoring", 4: logs.CONSENT_NOT_GRANTED, 5: None, 6: None, 7: logs.CONSENT_REQUIRED}


def test_latest_state_writes_only_changed_patients(spark, tmp_path):
    parts(spark, str(tmp_path), mixed())
    root, ckpt = f"{tmp_path}/state", f"{tmp_path}/ckpt"
    cols = ["patient_id", "ts", "seq", "consent_given", "consent_scope"]
    got = jobs.stream_latest_state(spark, str(tmp_path), state_root=root, checkpoint=ckpt, max_files=1)
    assert rows(got, *cols) == rows(logs.consent_latest(A.consents(spark, TINY)), *cols)
    batches = sorted(glob.glob(f"{root}/batch_id=*"))
    assert len(batches) == 3
    asked = [A.consents_from(A.assessments_from(spark.read.parquet(f))).select("patient_id").distinct().count() for f in glob.glob(f"{tmp_path}/events.parquet/*.parquet")]
    assert sorted(spark.read.parquet(b).count() for b in batches)[-1] <= max(asked)
    assert spark.read.parquet(batches[2]).count() <= max(asked) and sum(spark.read.parquet(b).count() for b in batches) <= sum(asked)


def test_daily_fairness_closes_the_last_day_and_counts_late_rows(spark, tmp_path):
    parts(spark, str(tmp_path), mixed())
    cols = ["day", "n_groups", "n_nonzero_groups", "bias_detected"]
    whole = jobs.stream_fairness_daily(spark, TINY)
    days = spark.read.parquet(f"{TINY}/events.parquet").select(F.date_trunc("day", "ts").alias("d")).distinct().count()
    assert whole.count() == days and whole.select("late_rows").distinct().first()[0] == 0
    patient = jobs.stream_fairness_daily(spark, str(tmp_path), watermark="1000 days", max_files=1)
    assert rows(patient, *cols) == rows(whole, *cols)
    hasty = jobs.stream_fairness_daily(spark, str(tmp_path), watermark="1 hour", max_files=1)
    assert hasty.select("late_rows").first()[0] > 0


def test_open_days_stay_without_a_heartbeat(spark):
    kept, closed = (jobs.stream_fairness_daily(spark, TINY, close=c).count() for c in (False, True))
    assert 0 < kept < closed


@pytest.mark.parametrize("first", ["predictions", "feedback"])
def test_feedback_counts_once_whichever_comes_first(spark, tmp_path, first):
    p = spark.createDataFrame([(1,), (2,), (3,)], "prediction_id long")
    f = spark.createDataFrame([(1, " High ", "a"), (1, " High ", "a"), (1, "low", "b"), (2, "agree", "a"), (9, "high", "a"), (3, "low", "a")], "prediction_id long, clinician_label string, ts string")
    folder = {"predictions": p, "feedback": f}
    later = {"feedback": "predictions", "predictions": "feedback"}[first]
    for name, df in folder.items():
        df.where("false").write.parquet(f"{tmp_path}/{name}")
    folder[first].coalesce(1).write.mode("append").parquet(f"{tmp_path}/{first}")
    streams = {n: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{n}") for n, df in folder.items()}
    out, ckpt = f"{tmp_path}/out", f"{tmp_path}/ckpt"
    for step in range(3):
        with state.rocksdb(spark):
            q = (jobs.usable_feedback(streams["predictions"], streams["feedback"]).writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
            q.awaitTermination()
        folder[later if step == 0 else "feedback"].coalesce(1).write.mode("append").parquet(f"{tmp_path}/{later if step == 0 else 'feedback'}")  # then repeated
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select("prediction_id", F.trim(F.lower("clinician_label"))).collect())) == [(1, "high"), (1, "low"), (3, "low")]


def test_state_folder_is_in_the_shared_place(spark):
    assert state.heartbeat_folder(spark, "x-test").startswith(scratch_path(spark, "x-test"))
