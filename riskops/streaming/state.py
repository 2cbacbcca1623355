"""Keyed stream state on RocksDB: the consent gate in event time, and heartbeats that close a stream.

The gate holds, for each patient, the consents that can still matter and the requests that the
watermark has not passed. A request is answered when the watermark passes it, by the consent in
force at its own time, so rows may come in any order within the watermark's delay. Then every consent but
the last before the watermark is dropped. Work per batch follows the rows of the batch and the
patients whose requests fall due; nothing else of the state is read or written.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from riskops.operators import logs
from riskops.session import scratch_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB (a stream's later runs take it from its checkpoint)."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# ------------------------------------------------------------------ heartbeats


def heartbeat_folder(spark: SparkSession, run: str) -> str:
    """A new folder that a stream can read heartbeats from."""
    path = scratch_path(spark, f"{run}/heartbeats")
    spark.createDataFrame([], "event_time timestamp").write.mode("ignore").parquet(path)
    return path


def with_heartbeats(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (with ``event_time``) and the heartbeats of ``folder``; the others' columns are null in a heartbeat, ``is_row`` false."""
    beats = rows.sparkSession.readStream.schema("event_time timestamp").parquet(folder)
    return rows.withColumn("is_row", F.lit(True)).unionByName(beats.withColumn("is_row", F.lit(False)), allowMissingColumns=True)


def beat(spark: SparkSession, folder: str, at: str) -> None:
    """A heartbeat: no row before ``at`` less the watermark's delay will come any more."""
    spark.range(1).select(F.lit(at).cast("timestamp").alias("event_time")).coalesce(1).write.mode("append").parquet(folder)


def dropped_rows(query) -> int:
    """Rows that this run of a stream left out because they were later than the watermark."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


# ------------------------------------------------------------------ consent gate

# a row of the request log; ``at`` is its time in microseconds, ``consent`` the consent change it carries: 0 for none, else
# CHANGE, with GIVEN and SCOPED where they hold
GATE_ROWS = "patient_id string, event_time timestamp, at long, prediction_id long, consent int"
GATE_OUT = "prediction_id long, patient_id string, reason string, allowed boolean"
GATE_ANSWERS = "prediction_id long, patient_id string, answer int"
CHANGE, SCOPED, GIVEN, ANSWERED = 1, 2, 4, 8
ALLOWED, REQUIRED, NOT_GRANTED, SCOPE_MISSING = range(4)
#: The state of a patient: its rows, packed, so that a batch costs one state call and not one for each row.
RECORD = np.dtype([("at", "<i8"), ("prediction_id", "<i8"), ("consent", "i1")])
CHUNK_ROWS = 10_000
#: No time or id, before all others; pandas would hold a long column with nulls as doubles, which do not hold all longs.
NONE = -(2**63)


def chunks(records: np.ndarray) -> list[tuple[bytes]]:
    """Values of a list state that hold ``records``."""
    return [(records[k : k + CHUNK_ROWS].tobytes(),) for k in range(0, len(records), CHUNK_ROWS)]


class ConsentGate(StatefulProcessor):
    """Answers the requests of one patient; times are whole microseconds."""

    def init(self, handle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", "chunk binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            records = np.empty(len(part), RECORD)
            for name in RECORD.names:
                records[name] = part[name].to_numpy()
            if key[0] == "":
                records = records[records["consent"] >= 0]  # without heartbeats
            if len(records):
                self.records.appendList(chunks(records))
                self.set_timer(records)
        return iter(())

    def set_timer(self, records: np.ndarray) -> None:
        """A timer at the first of ``records``; one that was answered with others by then finds nothing due."""
        self.handle.registerTimer(-(-int(records["at"].min()) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        found = [np.frombuffer(chunk, RECORD) for (chunk,) in self.records.get()]
        records = np.concatenate(found) if found else np.empty(0, RECORD)
        due, left = records[records["at"] <= passed], records[records["at"] > passed]
        ready = due[due["consent"] < ANSWERED]
        if not len(ready):
            return
        known = due[due["consent"] & CHANGE > 0]
        known["consent"] &= ~ANSWERED
        known.sort(order=RECORD.names)
        last = known[-1:].copy()
        last["consent"] |= ANSWERED
        if len(last) or len(left):
            self.records.put(chunks(np.concatenate([last, left])))
        else:
            self.records.clear()
        if len(left):
            self.set_timer(left)
        yield pd.DataFrame({"prediction_id": ready["prediction_id"], "patient_id": key[0], "answer": answers(ready["at"], known)})

    def close(self) -> None:
        pass


def answers(at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The answer at each of the times ``at`` by the last of the consents ``known`` (sorted) up to then."""
    place = np.searchsorted(known["at"], at, side="right")
    consent = np.concatenate([np.zeros(1, "i1"), known["consent"]])[place]
    return np.select([place == 0, consent & GIVEN == 0, consent & SCOPED == 0], [REQUIRED, NOT_GRANTED, SCOPE_MISSING], ALLOWED).astype("int32")


def gate_rows(requests: DataFrame, scope: str) -> DataFrame:
    """GATE_ROWS from a request log whose rows may carry a consent change too (``consent``: given, scope; null if none)."""
    given = F.when(F.col("consent.given"), GIVEN).otherwise(0)
    scoped = F.when(F.array_contains("consent.scope", scope), SCOPED).otherwise(0)
    change = F.when(F.col("consent").isNull(), 0).otherwise(F.lit(CHANGE) + given + scoped)
    return requests.select("patient_id", "event_time", F.unix_micros("event_time").alias("at"), "prediction_id", change.alias("consent"))


def gated(rows: DataFrame, scope: str, watermark: str) -> DataFrame:
    """The answers to a stream of GATE_ROWS (and heartbeats): anonymous requests at once, the others when the watermark passes them."""
    schema = [f.split()[0] for f in GATE_OUT.split(", ")]
    anonymous = F.col("patient_id").isNull() | (F.col("patient_id") == "")
    free = rows.where(anonymous & F.col("is_row")).select("prediction_id", "patient_id", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("allowed"))
    # heartbeats carry the watermark on, under a key of their own that holds no state; a filter on the event time is not pushed below the watermark
    keyed = rows.withWatermark("event_time", watermark).withColumn("patient_id", F.when(anonymous, F.lit("")).otherwise(F.col("patient_id")))
    keyed = keyed.where(~((F.col("patient_id") == "") & F.col("is_row") & F.col("event_time").isNotNull()))
    filled = [F.coalesce(name, F.lit(none)).alias(name) for name, none in (("at", NONE), ("prediction_id", NONE), ("consent", -1))]
    keyed = keyed.select("patient_id", "event_time", *filled)
    found = keyed.groupBy("patient_id").transformWithStateInPandas(ConsentGate(), outputStructType=GATE_ANSWERS, outputMode="Append", timeMode="EventTime")
    answer = F.col("answer")
    reason = F.when(answer == REQUIRED, logs.CONSENT_REQUIRED).when(answer == NOT_GRANTED, logs.CONSENT_NOT_GRANTED).when(answer == SCOPE_MISSING, logs.CONSENT_SCOPE_MISSING + scope)
    answered = found.select(F.nullif("prediction_id", F.lit(NONE)).alias("prediction_id"), "patient_id", reason.alias("reason"), (answer == ALLOWED).alias("allowed"))
    return answered.unionByName(free.select(*schema))
