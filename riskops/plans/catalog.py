"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through the fixture views, runs the
library operator on the whole table and ``finish``-es the result for the
oracle compare (doubles rounded to 6 places, arrays joined to text).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskops.operators import fairness, risk
from riskops.session import scratch_path
from riskops.sources import adapters as A
from riskops.sources import commits as CM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.concat_ws(" | ", c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log scored as the service scores it (crisis rule, then heuristic)."""
    return risk.score_requests(A.assessments(spark, sf_dir))


# ------------------------------------------------------------------ fairness


@register("group_positive_rate")
def q_group_positive_rate(spark, sf_dir):
    return finish(fairness.group_positive_rate(predictions(spark, sf_dir), "income_band", "risk_percent", 60.0))


@register("disparate_impact")
def q_disparate_impact(spark, sf_dir):
    rates = fairness.group_positive_rate(predictions(spark, sf_dir), "income_band", "risk_percent", 60.0)
    return finish(fairness.disparate_impact(rates, "income_band"))


# ------------------------------------------------------------------ evaluation (input: scored view)

from riskops.operators import evaluate as E  # noqa: E402
from riskops.operators import resample as RS  # noqa: E402


@register("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return finish(E.confusion_matrix(A.scored(spark, sf_dir), "p", "y", 0.5))


@register("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    return finish(E.classification_metrics(A.scored(spark, sf_dir), "p", "y", 0.5))


@register("classification_report")
def q_classification_report(spark, sf_dir):
    return finish(E.classification_report(A.scored(spark, sf_dir), "p", "y", 0.5, class_names=("not", "depressed")))


@register("roc_auc")
def q_roc_auc(spark, sf_dir):
    return finish(E.roc_auc(A.scored(spark, sf_dir), "p", "y"))


@register("average_precision")
def q_average_precision(spark, sf_dir):
    return finish(E.average_precision(A.scored(spark, sf_dir), "p", "y"))


@register("brier_score")
def q_brier_score(spark, sf_dir):
    return finish(E.brier_score(A.scored(spark, sf_dir), "p", "y"))


@register("roc_curve")
def q_roc_curve(spark, sf_dir):
    return finish(E.roc_curve(A.scored(spark, sf_dir), "p2", "y"))


@register("pr_curve")
def q_pr_curve(spark, sf_dir):
    return finish(E.pr_curve(A.scored(spark, sf_dir), "p", "y"))


@register("calibration_curve")
def q_calibration_curve(spark, sf_dir):
    return finish(E.calibration_curve(A.scored(spark, sf_dir), "p2", "y", 10))


@register("best_accuracy_threshold")
def q_best_accuracy_threshold(spark, sf_dir):
    return finish(E.best_accuracy_threshold(A.scored(spark, sf_dir), "p2", "y"))


@register("recall_tuned_threshold")
def q_recall_tuned_threshold(spark, sf_dir):
    return finish(E.recall_tuned_threshold(A.scored(spark, sf_dir), "p2", "y", max_precision_drop=0.04))


@register("bootstrap_auc_ci")
def q_bootstrap_auc_ci(spark, sf_dir):
    return finish(E.bootstrap_auc_ci(A.scored(spark, sf_dir), "prediction_id", "p", "y", n_boot=1000))


@register("bootstrap_auc_diff")
def q_bootstrap_auc_diff(spark, sf_dir):
    return finish(E.bootstrap_auc_diff(A.scored(spark, sf_dir), "prediction_id", "p", "p2", "y", n_boot=2000))


@register("cv_summary")
def q_cv_summary(spark, sf_dir):
    s = E.assign_folds(A.scored(spark, sf_dir), "prediction_id", 5, "fold")
    return finish(E.cv_summary(s, "fold", "p2", "y"))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    s = RS.stratified_split(A.scored(spark, sf_dir), "prediction_id", "y", test_size=0.2, seed="split")
    return finish(s.select("prediction_id", "y", "split"))


@register("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    s = RS.stratified_folds(A.scored(spark, sf_dir), "prediction_id", "y", k=5, seed="fold")
    return finish(s.select("prediction_id", "y", "fold"))


PROFILE_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("group_folds")
def q_group_folds(spark, sf_dir):
    s = RS.group_folds(A.profiles(spark, sf_dir), PROFILE_COLS, 5, "gfold", "y")
    return finish(s.select("l_orderkey", "l_linenumber", "fold"))


# ------------------------------------------------------------------ coercion / harmonisation / features

from riskops.operators import audit as AU  # noqa: E402
from riskops.operators import coerce as C  # noqa: E402
from riskops.operators import features as FE  # noqa: E402
from riskops.operators import harmonize as H  # noqa: E402


@register("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    return finish(C.coerce_numeric(A.raw_survey(spark, sf_dir), ["epds_score"]).select("row_id", "epds_score"))


@register("coerce_yes_no")
def q_coerce_yes_no(spark, sf_dir):
    r = A.raw_survey(spark, sf_dir)
    return finish(C.coerce_yes_no(r, {"money": {"numeric_fallback": True}}).select("row_id", "money"))


@register("ordinal_map")
def q_ordinal_map(spark, sf_dir):
    r = A.raw_survey(spark, sf_dir)
    return finish(C.ordinal_map(r, "relation", {"poor": 0.0, "moderate": 1.0, "good": 2.0}, out="support_score")
                  .select("row_id", "support_score"))


@register("parse_length_weeks")
def q_parse_length_weeks(spark, sf_dir):
    return finish(C.parse_length_weeks(A.raw_survey(spark, sf_dir), "length_text").select("row_id", "gestational_weeks"))


def _with_due(r):
    return r.withColumn("due_date", F.date_format(
        F.date_add(F.lit("1992-01-01").cast("date"), (F.col("row_id") % 3000).cast("int")), "dd/MM/yyyy"))


@register("gestation_from_dates")
def q_gestation_from_dates(spark, sf_dir):
    r = _with_due(A.raw_survey(spark, sf_dir))
    return finish(C.gestation_from_dates(r, "eval_date", "due_date").select("row_id", "gestational_weeks"))


@register("composite_scores")
def q_composite_scores(spark, sf_dir):
    r = A.raw_survey(spark, sf_dir).select(
        "row_id",
        C.yes_no_expr("money", ["no"], ["yes"]).alias("sleep1"),
        C.yes_no_expr("epds_result", ["high"], ["low"]).alias("sleep2"),
        C.yes_no_expr("epds_result", ["high"], ["low"]).alias("phq2"),
        "epds_score", "length_text")
    out = C.composite_scores(r, "sleep1", "sleep2", "phq2", "epds_score", "length_text")
    return finish(out.select("row_id", "sleep_score", "low_mood_score", "prior_pregnancy_loss"))


@register("harmonize_sources")
def q_harmonize_sources(spark, sf_dir):
    return finish(H.harmonize_sources(A.three_sources(spark, sf_dir)))


@register("label_rules")
def q_label_rules(spark, sf_dir):
    r = A.raw_survey(spark, sf_dir)
    out = C.label_rules(r, [C.threshold_label("epds_score", 13), C.result_is("epds_result", ["high"])])
    return finish(out.select("row_id", "target"))


@register("drop_incomplete")
def q_drop_incomplete(spark, sf_dir):
    r = A.raw_survey(spark, sf_dir).select("row_id", "epds_score", "relation")
    return finish(C.drop_incomplete(r, ["epds_score", "relation"]))


@register("validate_inputs")
def q_validate_inputs(spark, sf_dir):
    m = A.messages(spark, sf_dir)
    return finish(C.validate_inputs(m, bounds={}, text_col="message").select("message_id", "valid", "reject_reason"))


@register("validate_requests")
def q_validate_requests(spark, sf_dir):
    """B10 with all bounds on; the shifts take some values of each column out of its range."""
    k = F.col("k")
    a = A.assessments(spark, sf_dir).withColumns({
        "age": F.col("age") + k % 20 - 5, "gestational_weeks": F.col("gestational_weeks") + k % 5 - 1,
        "sleep_quality": F.col("sleep_quality") + k % 3, "appetite": F.col("appetite") - k % 2,
        "fatigue": F.col("fatigue") + k % 4, "financial_stress": F.col("financial_stress") + k % 2,
        "self_harm": F.col("self_harm") + k % 7,
    })
    return finish(C.validate_inputs(a).select("prediction_id", "valid", "reject_reason"))


@register("map_features")
def q_map_features(spark, sf_dir):
    a = A.assessments(spark, sf_dir)
    # names are resolved case-insensitively: 'age' would clash with 'Age'
    return finish(FE.map_features(a, FE.LEGACY_FEATURES + FE.HARMONIZED_FEATURES, keep=["prediction_id"],
                                  names={"age": "harmonized_age"}))


@register("feedback_features")
def q_feedback_features(spark, sf_dir):
    return finish(FE.feedback_features(A.assessments(spark, sf_dir), keep=["prediction_id"]))


@register("numeric_proxy")
def q_numeric_proxy(spark, sf_dir):
    r = A.raw_survey(spark, sf_dir).select("row_id", "relation", "epds_score")
    r = FE.numeric_proxy(r, "relation", "relation_proxy")
    r = FE.numeric_proxy(r, "epds_score", "epds_proxy")
    return finish(r.select("row_id", "relation_proxy", "epds_proxy"))


def _history_frame(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    c = A.table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey",
        (F.col("c_custkey") % 44 + 12).alias("Age"),
        (F.col("o_orderkey") % 6).alias("Gravida"),
        (F.col("c_nationkey") % 4).alias("Female Education"),
        (F.col("c_nationkey") % 5).alias("Husband Education"),
        (F.col("o_orderkey") % 4).alias("Total Number of Children"),
        C.yes_no_expr("o_orderstatus", ["f"], ["o"]).alias("Previous Miscarriage"),
        F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0).alias("Sufficient Money for Basic Needs"),
        (F.col("c_custkey") % 3).alias("Family System"),
    )


@register("interaction_features")
def q_interaction_features(spark, sf_dir):
    out = FE.interaction_features(_history_frame(spark, sf_dir))
    return finish(out.select("o_orderkey", *FE.ENGINEERED_FEATURES))


@register("audit_schema")
def q_audit_schema(spark, sf_dir):
    return finish(FE.audit_schema(A.raw_survey(spark, sf_dir)))


@register("impute_values")
def q_impute_values(spark, sf_dir):
    r = C.coerce_numeric(A.raw_survey(spark, sf_dir).select("row_id", "epds_score", "relation"), ["epds_score"])
    return finish(FE.impute_values(r, numeric=["epds_score"], categorical=["relation"]))


@register("standard_scale")
def q_standard_scale(spark, sf_dir):
    p = A.profiles(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return finish(FE.standard_scale(p, ["l_quantity", "l_discount"]))


@register("one_hot")
def q_one_hot(spark, sf_dir):
    p = A.profiles(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return finish(FE.one_hot(p, ["l_returnflag", "l_linestatus"]))


PROFILE_ROW = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "y"]


@register("dedup_counts")
def q_dedup_counts(spark, sf_dir):
    return finish(AU.dedup_counts(A.profiles(spark, sf_dir).select(*PROFILE_ROW)))


@register("profile_duplicates")
def q_profile_duplicates(spark, sf_dir):
    return finish(AU.profile_duplicates(A.profiles(spark, sf_dir).select(*PROFILE_ROW), PROFILE_COLS))


@register("class_balance")
def q_class_balance(spark, sf_dir):
    h = H.harmonize_sources(A.three_sources(spark, sf_dir))
    before = AU.class_balance(h, "target", ["source"]).select(F.lit("before").alias("phase"), "source", "target", "n")
    os_ = RS.oversample(h, "row_id", "target", seed="os")
    after = AU.class_balance(os_, "target").select(F.lit("after").alias("phase"), F.lit("all").alias("source"),
                                                   "target", "n")
    return finish(before.unionByName(after))


@register("oversample")
def q_oversample(spark, sf_dir):
    h = H.harmonize_sources(A.three_sources(spark, sf_dir))
    return finish(RS.oversample(h, "row_id", "target", seed="os").select("row_id", "target", "copy"))


@register("class_weights")
def q_class_weights(spark, sf_dir):
    return finish(RS.class_weights(H.harmonize_sources(A.three_sources(spark, sf_dir)), "target"))


@register("label_quality_audit")
def q_label_quality_audit(spark, sf_dir):
    return finish(AU.label_quality_audit(A.raw_survey(spark, sf_dir), "epds_score", 10.0))


@register("split_overlap")
def q_split_overlap(spark, sf_dir):
    p = A.profiles(spark, sf_dir).withColumn("rid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    s = RS.stratified_split(p, "rid", "y", 0.2, "split")
    row = AU.split_overlap(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), PROFILE_COLS)
    g = RS.group_folds(p, PROFILE_COLS, 5, "gfold", "y")
    grp = AU.split_overlap(g.where(F.col("fold") != 0), g.where(F.col("fold") == 0), PROFILE_COLS)
    return finish(row.select(F.lit("row_split").alias("split_kind"), "overlap")
                  .unionByName(grp.select(F.lit("group_split").alias("split_kind"), "overlap")))


# ------------------------------------------------------------------ sources

from riskops.operators import logs as L  # noqa: E402
from riskops.sources import scans as S  # noqa: E402


@register("scan_contract")
def q_scan_contract(spark, sf_dir):
    return finish(S.read_table(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"]))


@register("scan_documents")
def q_scan_documents(spark, sf_dir):
    return finish(S.scan_documents(A.guidelines(spark, sf_dir)).drop("text"))


@register("scan_prediction_log")
def q_scan_prediction_log(spark, sf_dir):
    return finish(S.scan_prediction_log(predictions(spark, sf_dir), keep=["prediction_id"]))


@register("parse_props")
def q_parse_props(spark, sf_dir):
    e = S.parse_json_column(A.table(spark, sf_dir, "events"), "props", "k INT")
    return finish(e.select("event_id", F.col("doc.k").alias("k"), "valid"))


@register("dataset_fingerprint")
def q_dataset_fingerprint(spark, sf_dir):
    return finish(S.table_fingerprint(A.table(spark, sf_dir, "orders")))


def _text_folder(spark, sf_dir):
    """The benchmark's texts as files, one for each item."""
    path = scratch_path(spark, f"text-files-{uuid.uuid4().hex}")
    b = A.table(spark, sf_dir, "benchmark").select("item_id", "text")
    b.repartition("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    return path


@register("read_text_files")
def q_read_text_files(spark, sf_dir):
    """A2: whole text files, written by Spark and read back."""
    d = S.read_text_documents(spark, _text_folder(spark, sf_dir))
    return finish(d.select("item_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256")))


@register("file_fingerprints")
def q_file_fingerprints(spark, sf_dir):
    """SHA-256 of files, streamed."""
    f = S.file_sha256(spark, _text_folder(spark, sf_dir))
    return finish(f.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "length", "sha256"))


@register("log_append")
def q_log_append(spark, sf_dir):
    """A5: two batches, the second one replayed, a half-written third; what the log holds then."""
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    p = predictions(spark, sf_dir).select("prediction_id", "patient_id", "ts", "risk_percent")
    late = F.col("prediction_id") % 3 == 0
    CM.append_batch(p.where(~late), path, 0)
    CM.append_batch(p.where(late), path, 1)
    CM.append_batch(p.where(late), path, 1)
    p.where(late).write.parquet(f"{path}/{CM.DATA}/batch-000000000002-lost")  # its run ended before the commit
    return finish(CM.read_log(spark, path))


@register("metrics_report")
def q_metrics_report(spark, sf_dir):
    """Written as JSON lines and read back."""
    path = scratch_path(spark, f"report-{uuid.uuid4().hex}")
    m = E.classification_metrics(A.scored(spark, sf_dir)).select("accuracy", "precision", "recall", "f1")
    S.write_metrics_report(S.metrics_tall(m, "test"), path)
    return finish(spark.read.schema("section string, metric string, value double").json(path))


@register("model_registry")
def q_model_registry(spark, sf_dir):
    """Two versions are published; the pointer gives the second, which scores the request log."""
    base = scratch_path(spark, f"registry-{uuid.uuid4().hex}")
    d = _train_frame(spark, sf_dir)
    for iterations in (1, 100):
        M.save_versioned(M.fit_logistic(d, ML_FEATURES, max_iter=iterations), base)
    return finish(M.score_model(M.load_latest(spark, base), d, keep=["prediction_id"]))


# ------------------------------------------------------------------ risk scoring / explanation


@register("crisis_override")
def q_crisis_override(spark, sf_dir):
    return finish(risk.crisis_override(A.assessments(spark, sf_dir))
                  .select("prediction_id", "crisis_mode", "crisis_reason", "override_risk"))


@register("heuristic_risk")
def q_heuristic_risk(spark, sf_dir):
    return finish(risk.heuristic_risk(A.assessments(spark, sf_dir)).select("prediction_id", "heuristic_risk"))


@register("risk_contributions")
def q_risk_contributions(spark, sf_dir):
    return finish(risk.risk_contributions(A.assessments(spark, sf_dir)))


@register("contribution_rank")
def q_contribution_rank(spark, sf_dir):
    return finish(L.contribution_rank(risk.risk_contributions(A.assessments(spark, sf_dir))))


# ------------------------------------------------------------------ more fairness


def _rates(spark, sf_dir):
    return fairness.group_positive_rate(predictions(spark, sf_dir), "income_band", "risk_percent", 60.0)


@register("di_by_threshold")
def q_di_by_threshold(spark, sf_dir):
    return finish(fairness.di_by_threshold(predictions(spark, sf_dir), "income_band", "risk_percent", 60.0,
                                           [40.0, 50.0, 60.0, 70.0, 120.0]))


@register("fairness_status")
def q_fairness_status(spark, sf_dir):
    return finish(fairness.fairness_status(_rates(spark, sf_dir)))


@register("fairness_deviation")
def q_fairness_deviation(spark, sf_dir):
    return finish(fairness.fairness_deviation(_rates(spark, sf_dir)))


def _flagged(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("high_risk", (F.col("risk_percent") >= 60.0).cast("int"))


@register("fairness_reweigh")
def q_fairness_reweigh(spark, sf_dir):
    return finish(fairness.reweigh(_flagged(spark, sf_dir), "income_band", "high_risk"))


@register("mitigation_effect")
def q_mitigation_effect(spark, sf_dir):
    return finish(fairness.mitigation_effect(_flagged(spark, sf_dir), "income_band", "high_risk"))


@register("fairness_auc_gap")
def q_fairness_auc_gap(spark, sf_dir):
    return finish(fairness.auc_gap(A.scored(spark, sf_dir), "income_band", "p2", "y"))


def protected_attributes() -> dict:
    return {"income_band": F.col("income_band"),
            "age_band": (F.floor(F.col("age") / 10) * 10).cast("string"),
            "event_type": F.col("event_type")}


def _di_all(spark, sf_dir, threshold=60.0):
    p = predictions(spark, sf_dir)
    out = None
    for name, expr in protected_attributes().items():
        r = fairness.group_positive_rate(p.withColumn("_g", expr), "_g", "risk_percent", threshold)
        d = fairness.disparate_impact(r, name)
        out = d if out is None else out.unionByName(d)
    return out


@register("mitigation_queue")
def q_mitigation_queue(spark, sf_dir):
    return finish(L.mitigation_queue(_di_all(spark, sf_dir), 60.0))


# ------------------------------------------------------------------ logs, joins, timelines


@register("consent_latest")
def q_consent_latest(spark, sf_dir):
    return finish(L.consent_latest(A.consents(spark, sf_dir)))


@register("consent_gate")
def q_consent_gate(spark, sf_dir):
    req = A.assessments(spark, sf_dir).select("prediction_id", "patient_id")
    return finish(L.consent_gate(req, A.consents(spark, sf_dir), "risk_scoring"))


def _feedback_rows(spark, sf_dir):
    rows = L.feedback_training_rows(A.feedback(spark, sf_dir), predictions(spark, sf_dir))
    return FE.feedback_features(rows, keep=["prediction_id", "clinician_label", "Labelling"])


@register("feedback_training_rows")
def q_feedback_training_rows(spark, sf_dir):
    return finish(_feedback_rows(spark, sf_dir))


@register("feedback_orphans")
def q_feedback_orphans(spark, sf_dir):
    return finish(L.feedback_orphans(A.feedback(spark, sf_dir), A.assessments(spark, sf_dir)).drop("ts"))


@register("patient_summary")
def q_patient_summary(spark, sf_dir):
    return finish(L.patient_summary(A.assessments(spark, sf_dir), A.patients(spark, sf_dir)))


@register("followup_worklist")
def q_followup_worklist(spark, sf_dir):
    return finish(L.followup_worklist(A.outcomes(spark, sf_dir), predictions(spark, sf_dir), "2024-01-20"))


def _base_rows(spark, sf_dir):
    t = A.training(spark, sf_dir).withColumn(
        "Labelling", F.when(F.col("y") == 1, F.lit("Depressed")).otherwise(F.lit("Not")))
    return FE.map_features(t, FE.LEGACY_FEATURES, keep=["prediction_id", "Labelling"])


@register("retrain_union")
def q_retrain_union(spark, sf_dir):
    fb = _feedback_rows(spark, sf_dir).drop("clinician_label")
    return finish(L.retrain_union(_base_rows(spark, sf_dir), fb))


@register("retrain_gate")
def q_retrain_gate(spark, sf_dir):
    return finish(L.retrain_gate(_feedback_rows(spark, sf_dir), 50))


@register("patient_timeline")
def q_patient_timeline(spark, sf_dir):
    return finish(L.patient_timeline(predictions(spark, sf_dir)))


@register("timeline_last_n")
def q_timeline_last_n(spark, sf_dir):
    t = L.timeline_last_n(predictions(spark, sf_dir), 6)
    return finish(t.select("patient_id", "recency", "prediction_id", "ts", "risk_percent"))


@register("risk_trajectory")
def q_risk_trajectory(spark, sf_dir):
    return finish(L.risk_trajectory(predictions(spark, sf_dir)))


def _case_events(spark, sf_dir):
    p = predictions(spark, sf_dir)
    new = p.select("patient_id", "ts", F.lit("new").alias("status"))
    fb = A.feedback(spark, sf_dir).join(p.select("prediction_id", "patient_id"), "prediction_id") \
        .select("patient_id", "ts", F.lit("pending_review").alias("status"))
    out = A.outcomes(spark, sf_dir).select("patient_id", (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"),
                                            F.lit("resolved").alias("status"))
    return new.unionByName(fb).unionByName(out)


@register("case_status")
def q_case_status(spark, sf_dir):
    return finish(L.case_status(_case_events(spark, sf_dir)))


@register("audit_log")
def q_audit_log(spark, sf_dir):
    return finish(L.consent_audit_log(A.consents(spark, sf_dir)))


# ------------------------------------------------------------------ text triage (messages view, fixture lexicon)

from riskops.operators import triage as TR  # noqa: E402


def triaged(spark, sf_dir):
    return TR.chat_triage(A.messages(spark, sf_dir), "message", TR.FIXTURE_LEXICON)


@register("chat_triage")
def q_chat_triage(spark, sf_dir):
    return finish(triaged(spark, sf_dir).select(
        "message_id", "rules_percent", "risk_percent", "risk_level", "risk_factors", "protective_factors",
        "crisis_mode", "model_used"))


@register("chat_crisis")
def q_chat_crisis(spark, sf_dir):
    return finish(triaged(spark, sf_dir).select("message_id", "crisis_mode", "risk_percent", "risk_level", "risk_factors"))


@register("chat_context")
def q_chat_context(spark, sf_dir):
    return finish(triaged(spark, sf_dir).select("message_id", "postpartum_hits", "antenatal_hits", "likely_context"))


@register("chat_language")
def q_chat_language(spark, sf_dir):
    return finish(triaged(spark, sf_dir).select("message_id", "language"))


@register("chat_guidance")
def q_chat_guidance(spark, sf_dir):
    return finish(TR.chat_guidance(triaged(spark, sf_dir)).select(
        "message_id", "crisis_mode", "guidance_query", "followups", "actionable"))


@register("key_points")
def q_key_points(spark, sf_dir):
    d = TR.key_points(A.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    # the outer form: a filter on the points' number, set by the planner below the inner one, takes every step on the text again
    d = d.select("doc_id", F.posexplode_outer("key_points").alias("point_idx", "point"))
    return finish(d.where(F.col("point_idx").isNotNull()))


@register("evidence_spans")
def q_evidence_spans(spark, sf_dir):
    return finish(TR.evidence_spans(triaged(spark, sf_dir), keywords=TR.FIXTURE_EVIDENCE))


@register("crisis_alerts")
def q_crisis_alerts(spark, sf_dir):
    return finish(L.crisis_alerts(triaged(spark, sf_dir), keep=["message_id"]))


# ------------------------------------------------------------------ retrieval (guidelines = documents, queries = benchmark)

from riskops.operators import retrieval as RT  # noqa: E402


def _chunks(spark, sf_dir):
    return RT.chunk_documents(A.guidelines(spark, sf_dir))


@register("chunk_documents")
def q_chunk_documents(spark, sf_dir):
    return finish(_chunks(spark, sf_dir))


@register("tfidf_index")
def q_tfidf_index(spark, sf_dir):
    postings, _ = RT.tfidf_index(_chunks(spark, sf_dir))
    return finish(postings)


@register("rag_topk")
def q_rag_topk(spark, sf_dir):
    t = RT.rag_topk(A.queries_table(spark, sf_dir), _chunks(spark, sf_dir), k=3)
    return finish(t.select("query_id", "rank", "source", "chunk_id", "score"))


@register("rag_lexical")
def q_rag_lexical(spark, sf_dir):
    t = RT.rag_lexical(A.queries_table(spark, sf_dir), A.guidelines(spark, sf_dir), k=3)
    return finish(t.select("query_id", "rank", "source", "score"))


@register("rag_answer")
def q_rag_answer(spark, sf_dir):
    qs = A.queries_table(spark, sf_dir)
    found = written(RT.rag_topk(qs, _chunks(spark, sf_dir), k=3), "found")
    return finish(RT.rag_answer(found, RT.found_chunks(found, A.guidelines(spark, sf_dir)), qs))


@register("chat_assess")
def q_chat_assess(spark, sf_dir):
    guided = TR.chat_guidance(triaged(spark, sf_dir))
    return finish(RT.assess_chat(guided, A.guidelines(spark, sf_dir)))


# ------------------------------------------------------------------ learning pipelines (rows-only checks)

from riskops.operators import explain as X  # noqa: E402
from riskops.operators import grid as G  # noqa: E402
from riskops.operators import models as M  # noqa: E402
from riskops.operators import shap as SH  # noqa: E402
from riskops.session import written  # noqa: E402

ML_FEATURES = FE.LEGACY_FEATURES


def _train_frame(spark, sf_dir):
    """Learnable fixture: legacy 7 features of the request log, label drawn from the heuristic risk."""
    return FE.map_features(A.training(spark, sf_dir), ML_FEATURES, keep=["prediction_id", "y"])


def _lr(train, feats, label):
    return M.fit_logistic(train, feats, label)


def _rf(train, feats, label):
    return M.fit_forest(train, feats, label)


def _gbt(train, feats, label):
    return M.fit_gbt(train, feats, label, id_col="prediction_id")


def _metrics_row(spark, name, learner, sf_dir):
    d = _train_frame(spark, sf_dir)
    tr, te = M.split(d, "prediction_id")
    m = learner(tr, ML_FEATURES, "y")
    both = tr.withColumn("part", F.lit("train")).unionByName(te.withColumn("part", F.lit("test")))
    s = written(M.score_model(m, both, keep=["part", "y"]), "scored")
    auc = {r.part: r.roc_auc for r in E.roc_auc(s, "p", "y", ["part"]).collect()}
    test = s.where("part = 'test'")
    met = E.classification_metrics(test, "p", "y", 0.5).first()
    return M.model_comparison(spark, [{"model": name, "feature_set": "legacy7", "n_features": len(ML_FEATURES),
                                       "train_auc": auc.get("train"), "test_auc": auc.get("test"), "brier_score": E.brier_score(test).first().brier_score,
                                       **{k: met[k] for k in ("accuracy", "precision", "recall", "f1")}}])


@register("fit_logistic")
def q_fit_logistic(spark, sf_dir):
    return finish(_metrics_row(spark, "logistic_regression", _lr, sf_dir))


@register("fit_forest")
def q_fit_forest(spark, sf_dir):
    return finish(_metrics_row(spark, "random_forest", _rf, sf_dir))


@register("fit_gbt")
def q_fit_gbt(spark, sf_dir):
    return finish(_metrics_row(spark, "gbt", _gbt, sf_dir))


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    grid = [G.Variant(n, "legacy7", tuple(ML_FEATURES), f) for n, f in (("logistic_regression", _lr), ("random_forest", _rf), ("gbt", _gbt))]
    return finish(G.variant_grid(_train_frame(spark, sf_dir), grid, "prediction_id"))


@register("score_model")
def q_score_model(spark, sf_dir):
    d = _train_frame(spark, sf_dir)
    tr, _ = M.split(d, "prediction_id")
    m = _lr(tr, ML_FEATURES, "y")
    feats = FE.map_features(A.assessments(spark, sf_dir), ML_FEATURES, keep=["prediction_id"])
    return finish(M.score_model(m, feats, keep=["prediction_id"]))


@register("calibrate_isotonic")
def q_calibrate_isotonic(spark, sf_dir):
    tr, te = M.split(_train_frame(spark, sf_dir), "prediction_id")
    scorer = M.cross_calibrated(tr, ML_FEATURES, _rf, "prediction_id", method="isotonic")
    return finish(scorer(te).select("prediction_id", "y", "p_calibrated"))


@register("calibrate_sigmoid")
def q_calibrate_sigmoid(spark, sf_dir):
    tr, te = M.split(_train_frame(spark, sf_dir), "prediction_id")
    scorer = M.cross_calibrated(tr, ML_FEATURES, _rf, "prediction_id", method="sigmoid")
    return finish(scorer(te).select("prediction_id", "y", "p_calibrated"))


@register("leakage_audit")
def q_leakage_audit(spark, sf_dir):
    t = A.training(spark, sf_dir)
    d = FE.map_features(t, ML_FEATURES, keep=["prediction_id", "y", "heur"])
    sets = {"full_with_score": ML_FEATURES + ["heur"], "preventive": ML_FEATURES[:2] + ML_FEATURES[5:6],
            "baseline": ML_FEATURES[:2]}
    return finish(G.variant_grid(d, [G.Variant("logistic_regression", n, tuple(f), _lr) for n, f in sets.items()], "prediction_id"))


def _profile_frame(spark, sf_dir):
    p = A.profiles(spark, sf_dir).withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    p = p.withColumn("is_r", (F.col("l_returnflag") == "R").cast("double")) \
        .withColumn("is_o", (F.col("l_linestatus") == "O").cast("double"))
    return RS.group_folds(p, PROFILE_COLS, 5, "gfold", "y")


@register("group_holdout")
def q_group_holdout(spark, sf_dir):
    feats = ["l_quantity", "l_discount", "l_tax", "is_r", "is_o"]
    return finish(M.group_holdout(_profile_frame(spark, sf_dir), feats, _lr, "fold", "y", "row_id"))


@register("learning_curve")
def q_learning_curve(spark, sf_dir):
    return finish(G.learning_curve(_train_frame(spark, sf_dir), ML_FEATURES, _lr, "prediction_id"))


@register("retrain_from_feedback")
def q_retrain_from_feedback(spark, sf_dir):
    base = _base_rows(spark, sf_dir).withColumn("y", (F.col("Labelling") == "Depressed").cast("int"))
    fb = _feedback_rows(spark, sf_dir).withColumn("y", (F.col("Labelling") == "Depressed").cast("int")) \
        .drop("clinician_label")
    reg = M.retrain_from_feedback(base, fb, ML_FEATURES, "y", "prediction_id", 50)
    return finish(reg.drop("path", "version"))


def _text_frame(spark, sf_dir, label="toxic"):
    return A.text_labels(spark, sf_dir, label)


def _text_predictions(spark, sf_dir):
    d = written(_text_frame(spark, sf_dir, "quality").where(F.col("label").isNotNull()), "text-frame")
    tr, te = M.split(d, "doc_id", 0.25, "text_split", label="label")
    m = M.fit_text_classifier(tr, "text", "label")
    return M.text_predictions(m, te, "doc_id", "text", "label")


@register("fit_text_classifier")
def q_fit_text_classifier(spark, sf_dir):
    return finish(M.label_report(M.label_confusion(_text_predictions(spark, sf_dir))))


@register("text_confusion")
def q_text_confusion(spark, sf_dir):
    return finish(M.label_confusion(_text_predictions(spark, sf_dir)))


@register("chat_hybrid")
def q_chat_hybrid(spark, sf_dir):
    d = _text_frame(spark, sf_dir, "toxic")
    m = M.fit_text_classifier(d, "text", "label")
    msgs = A.messages(spark, sf_dir)
    ms = M.text_risk_scores(m, msgs, "message_id", "message", 1,
                            {f: ph for f, (ph, _) in TR.FIXTURE_LEXICON.risk.items()})
    h = TR.chat_hybrid(triaged(spark, sf_dir), ms, "message_id")
    return finish(h.select("message_id", "rules_percent", "model_percent", "risk_percent", "risk_level", "risk_factors",
                           "model_used"))


@register("importance_contributions")
def q_importance_contributions(spark, sf_dir):
    d = _train_frame(spark, sf_dir)
    m = _rf(d, ML_FEATURES, "y")
    return finish(X.importance_contributions(m, d, ML_FEATURES, "prediction_id"))


@register("tree_shap")
def q_tree_shap(spark, sf_dir):
    d = _train_frame(spark, sf_dir)
    return finish(SH.tree_shap(_gbt(d, ML_FEATURES, "y"), d, ML_FEATURES, "prediction_id"))


@register("tree_shap_forest")
def q_tree_shap_forest(spark, sf_dir):
    d = _train_frame(spark, sf_dir)
    return finish(SH.tree_shap(M.fit_forest(d, ML_FEATURES, "y"), d, ML_FEATURES, "prediction_id"))


@register("tree_attribution")
def q_tree_attribution(spark, sf_dir):
    d = _train_frame(spark, sf_dir)
    m = _gbt(d, ML_FEATURES, "y")
    return finish(X.tree_attribution(m, d, ML_FEATURES, "prediction_id"))


# linear attribution on the heuristic's linear model (exact, SQL-checkable)
LINEAR_COEF = {"gestational_weeks": 10 * 0.25 * 10 / 42, "sleep_quality": -2.5, "appetite": -1.5,
               "fatigue": 2.0, "financial_stress": 1.5}
LINEAR_INTERCEPT = 40.0


def _linear_attr(spark, sf_dir):
    return X.linear_attribution(A.assessments(spark, sf_dir), LINEAR_COEF, "prediction_id")


@register("linear_attribution")
def q_linear_attribution(spark, sf_dir):
    return finish(_linear_attr(spark, sf_dir))


@register("global_importance")
def q_global_importance(spark, sf_dir):
    return finish(X.global_importance(_linear_attr(spark, sf_dir)))


@register("attribution_waterfall")
def q_attribution_waterfall(spark, sf_dir):
    a = A.assessments(spark, sf_dir)
    r = a.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in LINEAR_COEF]).first()
    base = LINEAR_INTERCEPT + sum(LINEAR_COEF[c] * r[c] for c in LINEAR_COEF)
    return finish(X.attribution_waterfall(_linear_attr(spark, sf_dir), "prediction_id", base))


# ------------------------------------------------------------------ SMOTE (vectors view: embeddings, label 5 vs rest)

from riskops.operators import neighbors as NB  # noqa: E402


@register("smote_neighbors")
def q_smote_neighbors(spark, sf_dir):
    return finish(NB.smote_neighbors(A.vectors(spark, sf_dir), "row_id", "embedding", "y", 1, k=5))


@register("smote_rows")
def q_smote_rows(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    nb = NB.smote_neighbors(v, "row_id", "embedding", "y", 1, k=5)
    s = NB.smote_rows(v, nb, "row_id", "embedding", "y", 1)
    return finish(s.select("draw", "row_id", F.size("embedding").alias("dim"), "y",
                           F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b).alias("vec_sum")))


# ------------------------------------------------------------------ streaming twins (availableNow runs into parquet sinks)

from riskops.streaming import jobs as ST  # noqa: E402


@register("stream_risk_alerts")
def q_stream_risk_alerts(spark, sf_dir):
    return finish(ST.stream_risk_alerts(spark, sf_dir))


@register("stream_timeline")
def q_stream_timeline(spark, sf_dir):
    return finish(ST.stream_timeline(spark, sf_dir))


@register("stream_fairness_daily")
def q_stream_fairness_daily(spark, sf_dir):
    return finish(ST.stream_fairness_daily(spark, sf_dir))


@register("stream_consent_gate")
def q_stream_consent_gate(spark, sf_dir):
    return finish(ST.stream_consent_gate(spark, sf_dir))


@register("stream_feedback_join")
def q_stream_feedback_join(spark, sf_dir):
    return finish(ST.stream_feedback_join(spark, sf_dir))


@register("stream_latest_state")
def q_stream_latest_state(spark, sf_dir):
    return finish(ST.stream_latest_state(spark, sf_dir))


@register("stream_retrain_trigger")
def q_stream_retrain_trigger(spark, sf_dir):
    return finish(ST.stream_retrain_trigger(spark, sf_dir))
