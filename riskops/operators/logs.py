"""Append-only log tables and the set-at-a-time versions of the service's point look-ups:
consent upsert view (A6), feedback joins (C1, C2), consent gate (C3), patient
summary (C4), follow-up worklist (C7), retrain union / gate (D14, D16), patient
timeline (D17-D19), contribution ranking (D20), case status (D21), alert / audit /
mitigation rows (G22-G24).

"Latest per key" is an aggregation (``max`` of a struct ordered by time), not
a window, so a patient holding a third of all rows is reduced map-side before
the shuffle.  Per-patient ordering (timeline) goes through the two-level
prefix sum, which splits a hot patient across time buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskops.operators.rank import cumulative

UNKNOWN_PATIENT = "unknown"


def _ts_num(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")).cast("double")


def latest_by_key(df: DataFrame, key: str, order_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Last write wins per ``key``: ``max(struct(order..., values...))`` (partial aggregation, skew-safe)."""
    s = F.max(F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in value_cols])).alias("_m")
    return df.groupBy(key).agg(s).select(key, *[F.col(f"_m.{c}").alias(c) for c in [*order_cols, *value_cols]])


def consent_latest(consents: DataFrame) -> DataFrame:
    """Current consent per patient (ties on ts broken by ``seq``)."""
    return latest_by_key(consents, "patient_id", ["ts", "seq"], ["consent_given", "consent_scope"])


# Consent refusal texts of the service.
CONSENT_REQUIRED = "Consent record required for patient"
CONSENT_NOT_GRANTED = "Consent not granted by patient"
CONSENT_SCOPE_MISSING = "Consent scope missing: "


def consent_gate(requests: DataFrame, consents: DataFrame, scope: str, patient_col: str = "patient_id") -> DataFrame:
    """``allowed`` + ``reason`` per request; a NULL/empty patient passes (anonymous use)."""
    cur = consent_latest(consents).select(F.col("patient_id").alias("_cp"), "consent_given", "consent_scope")
    j = requests.join(cur, requests[patient_col] == cur["_cp"], "left")
    anon = F.col(patient_col).isNull() | (F.col(patient_col) == "")
    reason = (F.when(anon, F.lit(None).cast("string"))
              .when(F.col("_cp").isNull(), F.lit(CONSENT_REQUIRED))
              .when(~F.coalesce(F.col("consent_given"), F.lit(False)), F.lit(CONSENT_NOT_GRANTED))
              .when(~F.coalesce(F.array_contains("consent_scope", scope), F.lit(False)),
                    F.lit(CONSENT_SCOPE_MISSING + scope)))
    return j.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()) \
        .drop("_cp", "consent_given", "consent_scope")


def consent_gate_as_of(requests: DataFrame, consents: DataFrame, scope: str) -> DataFrame:
    """C3 in event time: ``allowed`` + ``reason`` by the consent in force at each request's ``ts`` (consents of that very time included)."""
    one = F.struct("ts", "seq", "consent_given", "consent_scope")
    changes = consents.select("patient_id", "ts", F.lit(0).alias("_kind"), "seq", one.alias("_c"), F.lit(None).cast("long").alias("prediction_id"))
    asked = requests.select("patient_id", "ts", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(changes.schema["_c"].dataType).alias("_c"), "prediction_id")
    anon = F.col("patient_id").isNull() | (F.col("patient_id") == "")
    w = Window.partitionBy("patient_id").orderBy("ts", "_kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = changes.unionByName(asked.where(~anon)).withColumn("_now", F.last("_c", ignorenulls=True).over(w)).where(F.col("_kind") == 1)
    reason = (F.when(F.col("_now").isNull(), F.lit(CONSENT_REQUIRED))
              .when(~F.coalesce(F.col("_now.consent_given"), F.lit(False)), F.lit(CONSENT_NOT_GRANTED))
              .when(~F.coalesce(F.array_contains("_now.consent_scope", scope), F.lit(False)), F.lit(CONSENT_SCOPE_MISSING + scope)))
    out = j.select("prediction_id", "patient_id", reason.alias("reason"))
    free = requests.where(anon).select("prediction_id", "patient_id", F.lit(None).cast("string").alias("reason"))
    return out.unionByName(free).withColumn("allowed", F.col("reason").isNull())


# Clinician label -> training label; other labels are dropped.
FEEDBACK_TARGETS = {"high": "Depressed", "low": "Not"}


def dedupe_predictions(predictions: DataFrame, id_col: str = "prediction_id", ts_col: str = "ts") -> DataFrame:
    """One row per prediction id (the last one wins, as the reference's dict build)."""
    cols = [c for c in predictions.columns if c not in (id_col, ts_col)]
    return latest_by_key(predictions, id_col, [ts_col], cols)


def feedback_training_rows(feedback: DataFrame, predictions: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Feedback joined to its prediction; labels high -> Depressed, low -> Not, others dropped."""
    lab = F.lower(F.trim(F.col("clinician_label")))
    target = F.lit(None).cast("string")
    for k, v in FEEDBACK_TARGETS.items():
        target = F.when(lab == k, F.lit(v)).otherwise(target)
    fb = feedback.select(id_col, "clinician_label", target.alias("Labelling")).where(F.col("Labelling").isNotNull())
    p = dedupe_predictions(predictions.drop("clinician_label"), id_col)
    return fb.join(p, id_col, "inner")


def feedback_orphans(feedback: DataFrame, predictions: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Accepted (prediction exists) vs rejected feedback - one left join on distinct ids."""
    ids = predictions.select(F.col(id_col).alias("_pid")).distinct()
    j = feedback.join(ids, feedback[id_col] == ids["_pid"], "left")
    return j.select(*feedback.columns, F.when(F.col("_pid").isNull(), F.lit("rejected")).otherwise(F.lit("accepted"))
                    .alias("status"),
                    F.when(F.col("_pid").isNull(), F.lit("Prediction not found")).alias("reason"))


def patient_summary(patient_ids: DataFrame, summaries: DataFrame, patient_col: str = "patient_id") -> DataFrame:
    """C4: summary per patient or the placeholder record (left join + coalesce)."""
    ids = patient_ids.select(patient_col).distinct()
    s = summaries.select(F.col("patient_id").alias("_sp"), "patient_name", "recent_visits")
    j = ids.join(s, ids[patient_col] == s["_sp"], "left")
    return j.select(
        patient_col,
        F.coalesce(F.col("patient_name"), F.lit("Unknown Patient")).alias("patient_name"),
        F.lit("N/A").alias("dob"),
        F.concat(F.lit("MRN-"), F.col(patient_col)).alias("mrn"),
        F.lit(None).cast("int").alias("latest_epds"),
        F.coalesce(F.col("recent_visits"), F.lit(0)).cast("bigint").alias("recent_visits"),
    )


def followup_worklist(outcomes: DataFrame, predictions: DataFrame, as_of: str) -> DataFrame:
    """due = ts + follow_up_days; 'overdue' when due < as_of, else 'open'; risk from the prediction log."""
    p = predictions.select("prediction_id", "risk_percent")
    due = F.date_add(F.to_date("ts"), F.col("follow_up_days"))
    j = outcomes.join(p, "prediction_id", "left")
    return j.select(
        "prediction_id", "patient_id", "outcome_label", "follow_up_days", due.alias("due_date"), "risk_percent",
        F.when(due < F.to_date(F.lit(as_of)), F.lit("overdue")).otherwise(F.lit("open")).alias("status"),
    )


def retrain_union(base: DataFrame, feedback_rows: DataFrame) -> DataFrame:
    """Base training rows plus feedback rows (by name, tagged with ``origin``)."""
    return base.withColumn("origin", F.lit("base")).unionByName(
        feedback_rows.withColumn("origin", F.lit("feedback")), allowMissingColumns=True)


def retrain_gate(feedback_rows: DataFrame, min_feedback: int = 50) -> DataFrame:
    """Retrain only when at least ``min_feedback`` usable feedback rows exist."""
    n = F.count(F.lit(1))
    return feedback_rows.agg(n.alias("feedback_rows")).select(
        "feedback_rows", F.lit(int(min_feedback)).alias("min_feedback"),
        (F.col("feedback_rows") >= min_feedback).alias("retrain"),
        F.when(F.col("feedback_rows") >= min_feedback, F.lit("retrain queued"))
        .otherwise(F.concat(F.lit("Not enough feedback rows: "), F.col("feedback_rows").cast("string"),
                            F.lit(f" < {int(min_feedback)}. Skipping retrain."))).alias("message"),
    )


def patient_timeline(points: DataFrame, ts_col: str = "ts", id_col: str = "prediction_id") -> DataFrame:
    """Per patient, points in time order with their index and the change from the previous point.

    Ordering per patient uses the two-level prefix sum (hot patients split by
    time bucket); the previous point is fetched by an equi-join on index - 1.
    """
    p = points.select(
        F.coalesce(F.col("patient_id"), F.lit(UNKNOWN_PATIENT)).alias("patient_id"), id_col, ts_col,
        "gestational_weeks", "risk_percent", _ts_num(ts_col).alias("_t"), F.lit(1).alias("one"))
    c = cumulative(p, ["_t", id_col], ["one"], ["patient_id"]).withColumnRenamed("one_cum", "point")
    prev = c.select("patient_id", (F.col("point") + 1).alias("point"), F.col("risk_percent").alias("_prev"))
    j = c.join(prev, ["patient_id", "point"], "left")
    return j.select("patient_id", F.col("point").cast("bigint").alias("point"), id_col, ts_col, "gestational_weeks",
                    "risk_percent", (F.col("risk_percent") - F.col("_prev")).alias("risk_change"))


def timeline_last_n(points: DataFrame, n: int = 6, ts_col: str = "ts", id_col: str = "prediction_id") -> DataFrame:
    """Newest ``n`` points per patient (row_number <= n; Spark's WindowGroupLimit prunes map-side)."""
    w = Window.partitionBy("patient_id").orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
    p = points.withColumn("patient_id", F.coalesce(F.col("patient_id"), F.lit(UNKNOWN_PATIENT)))
    return p.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def risk_zone(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c <= 40, F.lit("low")).when(c <= 70, F.lit("moderate")).otherwise(F.lit("high"))


def risk_trajectory(points: DataFrame) -> DataFrame:
    """Per patient and gestational week: points, mean risk, zone (<=40 / <=70 / >70), trimester."""
    g = points.groupBy(F.coalesce(F.col("patient_id"), F.lit(UNKNOWN_PATIENT)).alias("patient_id"),
                       "gestational_weeks").agg(F.count(F.lit(1)).alias("n"), F.avg("risk_percent").alias("avg_risk"))
    tri = F.when(F.col("gestational_weeks") <= 13, 1).when(F.col("gestational_weeks") <= 27, 2).otherwise(3)
    return g.select("*", risk_zone("avg_risk").alias("zone"), tri.alias("trimester"))


def contribution_rank(contrib: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Contributions per prediction sorted by percent desc (ties by feature order)."""
    w = Window.partitionBy(id_col).orderBy(F.col("contribution_percent").desc(), F.col("ord"))
    return contrib.withColumn("rank", F.row_number().over(w))


# Case status order (later stages win ties).
CASE_STATUS_ORDER = {"new": 0, "pending_review": 1, "resolved": 2}


def case_status(events: DataFrame) -> DataFrame:
    """Latest status per patient from (patient_id, ts, status) events."""
    rank = F.lit(None).cast("int")
    for k, v in CASE_STATUS_ORDER.items():
        rank = F.when(F.col("status") == k, F.lit(v)).otherwise(rank)
    e = events.withColumn("_r", rank)
    return latest_by_key(e, "patient_id", ["ts", "_r"], ["status"]).drop("_r")


ALERT_STATUS_LOCAL = "queued_local"


def crisis_alerts(df: DataFrame, text_col: str = "message", risk_col: str = "risk_percent",
                  crisis_col: str = "crisis_mode", keep: Sequence[str] = ()) -> DataFrame:
    """Alert row per crisis event: status, 300-character excerpt, risk (no outbound webhook)."""
    return df.where(F.col(crisis_col)).select(
        *keep, F.coalesce(F.col("patient_id"), F.lit(UNKNOWN_PATIENT)).alias("patient_id"),
        F.lit(ALERT_STATUS_LOCAL).alias("status"), F.col(risk_col).alias("risk_percent"),
        F.substring(F.col(text_col), 1, 300).alias("message_excerpt"))


def consent_audit_log(consents: DataFrame, updated_by: str = "system") -> DataFrame:
    """One audit row per consent change, detail as JSON."""
    return consents.select(
        F.lit("consent_updated").alias("event"), "patient_id", "ts",
        F.lit(updated_by).alias("updated_by"),
        F.to_json(F.struct(F.col("consent_given"), F.col("consent_scope").alias("scope"))).alias("detail"))


def mitigation_queue(di_rows: DataFrame, operating_threshold: float, requested_by: str = "fairness_monitor",
                     current_model: str = "risk_model", min_feedback: int = 50) -> DataFrame:
    """A retrain request row for every biased protected attribute."""
    return di_rows.where(F.col("bias_detected")).select(
        F.lit(requested_by).alias("requested_by"), F.lit(int(min_feedback)).alias("min_feedback_samples"),
        F.lit(current_model).alias("current_model"), F.lit("queued_auto_mitigation").alias("status"),
        F.lit("fairness_auto").alias("trigger"), "protected_attribute",
        F.lit(float(operating_threshold)).alias("operating_threshold"), "disparate_impact")
