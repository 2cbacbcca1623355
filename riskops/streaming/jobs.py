"""Structured Streaming twins of the service's request handlers (H1-H7).

Source: the events table read as a file stream (``readStream.parquet``).
Sinks: parquet folders under the cluster's shared checkpoint folder (never a
driver-memory sink), each query with its own checkpoint location, so a
restarted job resumes exactly where it stopped; ``foreachBatch`` writers
overwrite a ``batch_id=`` partition, which makes a replayed micro-batch
idempotent.

Tests and the registered queries run each job with
``trigger(availableNow=True)`` and compare the sink with the batch twin.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskops.operators import fairness, logs, risk
from riskops.session import scratch_path
from riskops.sources import adapters as A
from riskops.streaming import state

#: How late an event may be by default: rows later than this are dropped by H2, H3 and H5.
WATERMARK = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", max_files: int | None = None) -> DataFrame:
    """File stream over one table of the folder, with the batch table's schema."""
    folder = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return r.parquet(f"{folder}/{name}.parquet")
    # a table that is one file: the stream watches its folder, and the glob keeps this file only
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def with_event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    """Event-time column for watermarks (session time zone is UTC)."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def run_to_sink(spark: SparkSession, df: DataFrame, name: str, mode: str = "append",
                partition_by: list[str] | None = None) -> str:
    """Run a streaming DataFrame to completion (availableNow) into a parquet sink; return its path."""
    run = f"stream-{name}-{uuid.uuid4().hex}"
    out, ckpt = scratch_path(spark, f"{run}/out"), scratch_path(spark, f"{run}/checkpoint")
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def run_foreach_batch(spark: SparkSession, df: DataFrame, name: str,
                      fn: Callable[[DataFrame, int], DataFrame], mode: str = "append") -> str:
    """foreachBatch: ``fn(batch, batch_id)`` -> rows written to ``<out>/batch_id=<id>`` (overwrite = idempotent)."""
    run = f"stream-{name}-{uuid.uuid4().hex}"
    out, ckpt = scratch_path(spark, f"{run}/out"), scratch_path(spark, f"{run}/checkpoint")

    def write(batch: DataFrame, batch_id: int):
        fn(batch, batch_id).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def read_sink(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # no file written (empty stream); any other failure is one
        if schema is None or not nothing_written(e):
            raise
        return spark.createDataFrame([], schema)


def nothing_written(e: AnalysisException) -> bool:
    """Whether a read failed because its folder is missing or holds no file."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# ------------------------------------------------------------------ H1


def stream_risk_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: score each incoming assessment (crisis rule, heuristic) and emit the crisis alerts."""
    s = risk.score_requests(A.assessments_from(event_stream(spark, sf_dir)))
    alerts = s.where(F.col("crisis_mode")).select(
        "prediction_id", "patient_id", "risk_percent", F.lit(logs.ALERT_STATUS_LOCAL).alias("status"),
        F.substring("message", 1, 300).alias("message_excerpt"))
    return read_sink(spark, run_to_sink(spark, alerts, "risk_alerts"))


# ------------------------------------------------------------------ H2


def stream_timeline(spark: SparkSession, sf_dir: str, duplicates: int = 2,
                    watermark: str = WATERMARK) -> DataFrame:
    """H2: at-least-once input (the source replayed ``duplicates`` times) -> one timeline point per prediction."""
    streams = [with_event_time(risk.score_requests(A.assessments_from(event_stream(spark, sf_dir))))
               for _ in range(duplicates)]
    s = streams[0]
    for o in streams[1:]:
        s = s.unionByName(o)
    pts = (s.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["prediction_id"])
           .select("patient_id", "prediction_id", "ts", "gestational_weeks", "risk_percent"))
    return read_sink(spark, run_to_sink(spark, pts, "timeline"))


# ------------------------------------------------------------------ H3


def last_event(spark: SparkSession, sf_dir: str, *after: str) -> str:
    """The time a closing heartbeat of a whole table carries: its last event plus the intervals ``after``."""
    t = F.max("ts").cast("timestamp")
    for more in after:
        t = t + F.expr(f"INTERVAL {more}")
    t = A.table(spark, sf_dir, "events").agg(t.cast("string").alias("t")).first().t
    return t or "1970-01-01 00:00:00"


def run_and_close(spark: SparkSession, start: Callable[[], StreamingQuery], beats: str, closing: str | None) -> int:
    """Run a stream over what is there, then over a closing heartbeat; the rows it dropped as too late."""
    q = start()
    q.awaitTermination()
    late = state.dropped_rows(q)
    if closing:
        state.beat(spark, beats, closing)
        q = start()
        q.awaitTermination()
        late += state.dropped_rows(q)
    return late


def stream_fairness_daily(spark: SparkSession, sf_dir: str, threshold: float = 60.0, watermark: str = WATERMARK,
                          close: bool = True, max_files: int | None = None, run: str | None = None) -> DataFrame:
    """H3: per day and group, the share with risk >= threshold (tumbling window, watermark, append);
    then DI per closed day.

    A closing heartbeat, if ``close``, lets the last days out. Rows later than the watermark are not
    in any day; ``late_rows`` counts them, the same in every row.
    """
    run = run or f"stream-fairness-{uuid.uuid4().hex}"
    out, ckpt = scratch_path(spark, f"{run}/out"), scratch_path(spark, f"{run}/checkpoint")
    beats = state.heartbeat_folder(spark, run)
    s = with_event_time(risk.score_requests(A.assessments_from(event_stream(spark, sf_dir, max_files=max_files))))
    s = s.select("event_time", "risk_percent", fairness.group_col_expr("income_band").alias("group"))
    g = (state.with_heartbeats(s, beats).withWatermark("event_time", watermark)
         .groupBy(F.window("event_time", "1 day").alias("w"), "group")
         .agg(F.count(F.when(F.col("is_row"), 1)).alias("total"),
              F.sum(F.when(F.col("is_row") & (F.col("risk_percent") >= threshold), 1).otherwise(0)).alias("positives"))
         .where(F.col("total") > 0)
         .select(F.col("w.start").cast("timestamp_ntz").alias("day"), "group", "total", "positives"))

    def start() -> StreamingQuery:
        return (g.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
                .trigger(availableNow=True).start())

    with state.rocksdb(spark):
        late = run_and_close(spark, start, beats, last_event(spark, sf_dir, watermark, "2 DAYS") if close else None)
    daily = read_sink(spark, out, "day timestamp_ntz, `group` string, total long, positives long")
    rates = daily.select("day", "group", (F.col("positives") / F.col("total")).alias("positive_rate"))
    nz = F.col("positive_rate") > 0
    per = rates.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum(F.when(nz, 1).otherwise(0)).alias("n_nonzero_groups"),
        F.min(F.when(nz, F.col("positive_rate"))).alias("min_rate"),
        F.max(F.when(nz, F.col("positive_rate"))).alias("max_rate"))
    enough = F.col("n_nonzero_groups") >= 2
    di = F.when(enough, F.col("min_rate") / F.col("max_rate")).otherwise(F.lit(1.0))
    return per.select("day", "n_groups", "n_nonzero_groups", di.alias("disparate_impact"),
                      F.coalesce(enough & (di < fairness.DI_THRESHOLD), F.lit(False)).alias("bias_detected"),
                      F.lit(late).cast("long").alias("late_rows"))


# ------------------------------------------------------------------ H4


def stream_consent_gate(spark: SparkSession, sf_dir: str, scope: str = "risk_scoring", watermark: str = WATERMARK,
                        max_files: int | None = None, close: bool = True, run: str | None = None) -> DataFrame:
    """H4: answer each request by the consent in force at its time; consents and requests are one stream, keyed by patient.

    The state holds what the watermark has not passed and one consent a patient (``state.ConsentGate``).
    A closing heartbeat, if ``close``, answers what still waits. Requests later than the watermark get no
    answer, as the consents of their time may be gone. ``run`` names the folder of the sink and the
    checkpoint: the same one goes on where it stopped.
    """
    run = run or f"stream-gate-{uuid.uuid4().hex}"
    out, ckpt = scratch_path(spark, f"{run}/out"), scratch_path(spark, f"{run}/checkpoint")
    beats = state.heartbeat_folder(spark, run)
    log = with_event_time(A.assessments_from(event_stream(spark, sf_dir, max_files=max_files)))
    given, scopes = A.consent_columns()
    change = F.when(F.col("event_type") == "signup", F.struct(given.alias("given"), scopes.alias("scope")))
    rows = state.gate_rows(log.select("patient_id", "event_time", "prediction_id", change.alias("consent")), scope)
    answers = state.gated(state.with_heartbeats(rows, beats), scope, watermark)

    def start() -> StreamingQuery:
        return (answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
                .outputMode("append").trigger(availableNow=True).start())

    with state.rocksdb(spark):
        run_and_close(spark, start, beats, last_event(spark, sf_dir, watermark, "1 DAY") if close else None)
    return read_sink(spark, out, state.GATE_OUT)


# ------------------------------------------------------------------ H5


def stream_feedback_join(spark: SparkSession, sf_dir: str, within_days: int = 14,
                         watermark: str = WATERMARK) -> DataFrame:
    """H5: stream-stream inner join of feedback to its prediction within ``within_days`` of it."""
    p = with_event_time(A.assessments_from(event_stream(spark, sf_dir)), "ts", "p_time") \
        .select("prediction_id", "patient_id", "p_time").withWatermark("p_time", watermark)
    f = with_event_time(A.feedback_from(event_stream(spark, sf_dir)), "ts", "f_time") \
        .select(F.col("prediction_id").alias("f_prediction_id"), "clinician_label", "f_time") \
        .withWatermark("f_time", watermark)
    cond = (F.col("prediction_id") == F.col("f_prediction_id")) & (F.col("f_time") >= F.col("p_time")) & \
        (F.col("f_time") <= F.col("p_time") + F.expr(f"INTERVAL {int(within_days)} DAYS"))
    j = p.join(f, cond, "inner").select("prediction_id", "patient_id", "clinician_label",
                                        F.col("p_time").cast("timestamp_ntz").alias("prediction_ts"),
                                        F.col("f_time").cast("timestamp_ntz").alias("feedback_ts"))
    return read_sink(spark, run_to_sink(spark, j, "feedback_join"))


# ------------------------------------------------------------------ H6


def stream_latest_state(spark: SparkSession, sf_dir: str, state_root: str | None = None,
                        checkpoint: str | None = None, max_files: int | None = None) -> DataFrame:
    """H6: the latest consent per patient, as keyed state; a batch writes only the patients it changes.

    The state store holds one row a patient. In update mode each batch emits the changed rows to
    ``batch_id=<n>`` of the state folder (a replayed batch overwrites its own), and the latest of a patient's
    rows is the table. A job restarted on the same ``state_root`` and ``checkpoint`` goes on from its state.
    """
    c = A.consents_from(A.assessments_from(event_stream(spark, sf_dir, max_files=max_files)))
    run = f"stream-latest-{uuid.uuid4().hex}"
    state_root = state_root or scratch_path(spark, f"{run}/state")
    checkpoint = checkpoint or scratch_path(spark, f"{run}/checkpoint")

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_root}/batch_id={batch_id}")

    with state.rocksdb(spark):
        q = (logs.consent_latest(c).writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
             .outputMode("update").trigger(availableNow=True).start())
        q.awaitTermination()
    schema = "patient_id string, ts timestamp_ntz, seq long, consent_given boolean, consent_scope array<string>"
    return logs.consent_latest(read_sink(spark, state_root, schema))


# ------------------------------------------------------------------ H7


def usable_feedback(predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback records (label high / low) whose prediction is known, each once, when the later of the two has come."""
    known = predictions.select("prediction_id").dropDuplicates(["prediction_id"])
    fb = feedback.where(F.lower(F.trim("clinician_label")).isin(*logs.FEEDBACK_TARGETS))
    fb = fb.select(F.col("prediction_id").alias("of"), "clinician_label", "ts").dropDuplicates(["of", "clinician_label", "ts"])
    return known.join(fb, F.col("prediction_id") == F.col("of")).select("prediction_id", "clinician_label", "ts")


def stream_retrain_trigger(spark: SparkSession, sf_dir: str, min_feedback: int = 50, duplicates: int = 2,
                           max_files: int | None = None) -> DataFrame:
    """H7: running count of usable feedback (label high / low) whose prediction is known; trigger at ``min_feedback``.

    Predictions and feedback are both streams that may repeat rows (here the source is replayed
    ``duplicates`` times): each feedback record counts once, when it and its prediction have come, whichever
    is first. A batch writes the number it adds; the count is the sum over the batches.
    """
    def replayed(project: Callable[[DataFrame], DataFrame]) -> DataFrame:
        s = [project(event_stream(spark, sf_dir, max_files=max_files)) for _ in range(duplicates)]
        return reduce(DataFrame.unionByName, s)

    usable = usable_feedback(replayed(A.assessments_from), replayed(A.feedback_from))

    def emit(batch: DataFrame, batch_id: int) -> DataFrame:
        return batch.agg(F.count(F.lit(1)).alias("added"))

    with state.rocksdb(spark):
        path = run_foreach_batch(spark, usable, "retrain_trigger", emit)
    out = read_sink(spark, path, "added long").agg(F.coalesce(F.sum("added"), F.lit(0)).alias("feedback_rows"))
    return out.select("feedback_rows", F.lit(int(min_feedback)).alias("min_feedback"), (F.col("feedback_rows") >= min_feedback).alias("retrain"))
