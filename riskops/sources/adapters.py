"""Fixture views over the driver tables (tests / driver only).

Each view stands in for one of the reference's inputs (request log, feedback,
consents, ...) and is defined so that the same rows come out of DuckDB; the SQL
twins live in ``oracle_queries.py``.  Every view is a lazy projection of the
given parquet tables, so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskops.functions.exprs import spread, uniform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  A file written as one row group is one split however large it is,
    so an under-split table is spread round-robin over the cluster first (a no-op when the
    scan already has enough splits); column pruning and filters still reach the scan."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction / request log: one risk request per event."""
    return assessments_from(table(spark, sf_dir, "events"))


def assessments_from(events: DataFrame) -> DataFrame:
    """The request-log projection of an events frame (batch or streaming)."""
    e = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).try_cast("int"))
    k, uid = F.col("k"), F.col("user_id")
    return e.select(
        F.col("event_id").alias("prediction_id"),
        F.concat(F.lit("p"), uid.cast("string")).alias("patient_id"),
        "ts",
        (F.col("event_id") % 42 + 1).alias("gestational_weeks"),
        (k % 11).alias("sleep_quality"),
        ((k * 2) % 11).alias("appetite"),
        ((k * 9) % 11).alias("fatigue"),
        ((k + uid) % 11).alias("financial_stress"),
        (uid % 44 + 12).alias("age"),
        F.when(uid % 4 == 0, "low").when(uid % 4 == 1, "middle").when(uid % 4 == 2, "high").alias("income_band"),
        F.when((F.col("event_type") == "error") & (k % 10 == 0), k % 5 + 1).otherwise(0).alias("self_harm"),
        "k",
        "event_type",
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input of the evaluation operators: (prediction_id, y, p, p2, group columns)."""
    a = assessments(spark, sf_dir)
    p = F.col("k") / F.lit(100.0)
    return a.select(
        "*",
        p.alias("p"),
        F.when(uniform("42", "prediction_id") < p, 1).otherwise(0).alias("y"),
        ((F.col("k") * 0.7 + uniform("p2", "prediction_id") * 30) / F.lit(100.0)).alias("p2"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_from(table(spark, sf_dir, "events"))


def feedback_from(events: DataFrame) -> DataFrame:
    """Clinician feedback projection of an events frame (batch or streaming)."""
    e = events.where(F.col("event_id") % 5 == 0)
    eid = F.col("event_id")
    return e.select(
        (eid + F.when(eid % 25 == 0, F.lit(1000000000)).otherwise(F.lit(0))).alias("prediction_id"),
        F.when(eid % 20 == 0, "high").when(eid % 20 == 5, "low").when(eid % 20 == 10, "agree")
        .otherwise("medium").alias("clinician_label"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"),
    )


def consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consents_from(assessments(spark, sf_dir))


def consents_from(assess: DataFrame) -> DataFrame:
    """Consent-change projection of a request log (batch or streaming)."""
    a = assess.where(F.col("event_type") == "signup")
    given, scope = consent_columns()
    return a.select("patient_id", given.alias("consent_given"), "ts", F.col("prediction_id").alias("seq"),
                    scope.alias("consent_scope"))


def consent_columns() -> tuple[F.Column, F.Column]:
    """Whether a sign-up of the request log gives consent, and the scope it names."""
    k = F.col("k")
    scope = (F.when(k % 3 == 0, F.array(F.lit("risk_scoring")))
             .when(k % 3 == 1, F.array(F.lit("chat_assessment")))
             .otherwise(F.array(F.lit("chat_assessment"), F.lit("risk_scoring"), F.lit("model_improvement"))))
    return k % 4 != 0, scope


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessments(spark, sf_dir).where(F.col("event_type") == "purchase")
    k = F.col("k")
    return a.select(
        "patient_id",
        "prediction_id",
        "ts",
        F.when(k % 4 == 0, "improved").when(k % 4 == 1, "stable").when(k % 4 == 2, "deteriorated")
        .otherwise("urgent_referral").alias("outcome_label"),
        F.when(k % 4 == 3, 1).otherwise(14).alias("follow_up_days"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("patient_id"),
        F.col("text").alias("message"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    # pre-aggregate orders per customer before the join (orders >> customers)
    visits = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return c.join(visits, "c_custkey", "left").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"),
        F.col("c_name").alias("patient_name"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("recent_visits"),
    )


def guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("source"), "text")


def queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def text_labels(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return d.join(lab, "doc_id")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.when(F.col("l_extendedprice") >= 50000, 1).otherwise(0).alias("y"),
    )


def raw_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "no")
        .otherwise((key % 3).cast("string")).alias("money"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Poor").when(F.col("o_orderpriority") == "2-HIGH", "moderate ")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "GOOD").when(F.col("o_orderpriority") == "5-LOW", "n/a")
        .alias("relation"),
        F.when(key % 17 == 0, "unknown").otherwise(F.concat((key % 12).cast("string"), F.lit(" months")))
        .alias("length_text"),
        F.when(key % 13 == 0, "bad").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("eval_date"),
        F.when(key % 11 == 0, F.lit(None).cast("string")).otherwise((key % 31).cast("string")).alias("epds_score"),
        F.when(key % 5 == 0, "High").when(key % 5 == 1, "low").alias("epds_result"),
    )


def heuristic_expr() -> F.Column:
    g = F.col("gestational_weeks") / F.lit(42.0) * 10
    raw = (g * 0.25 + (10 - F.col("sleep_quality")) * 0.25 + (10 - F.col("appetite")) * 0.15
           + F.col("fatigue") * 0.2 + F.col("financial_stress") * 0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 10.0))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments with a learnable label drawn from the heuristic risk."""
    a = assessments(spark, sf_dir).withColumn("heur", heuristic_expr())
    return a.withColumn(
        "y", F.when(uniform("lab", "prediction_id") < F.col("heur") / F.lit(100.0), 1).otherwise(0)
    )


def three_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw-ish per-source frames; ``operators.harmonize`` maps them to one schema."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    li = table(spark, sf_dir, "lineitem")
    ev = table(spark, sf_dir, "events")
    main = o.join(c, o.o_custkey == c.c_custkey).select(
        o.o_orderkey.alias("row_id"),
        (c.c_custkey % 44 + 12).cast("double").alias("age"),
        (o.o_orderkey % 42 + 1).cast("double").alias("gestational_weeks"),
        F.when(o.o_orderstatus == "F", 1).when(o.o_orderstatus == "O", 0).cast("double").alias("prior_pregnancy_loss"),
        F.when(o.o_totalprice >= 250000, 1).otherwise(0).alias("target"),
    )
    ppd = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_quantity").cast("double").alias("gestational_weeks"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("target"),
    )
    uganda = ev.select(
        F.col("event_id").alias("row_id"),
        (F.col("user_id") % 44 + 12).cast("double").alias("age"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("double").alias("prior_pregnancy_loss"),
        F.col("value").alias("anxiety_score"),
        F.when(F.col("value") >= 60, 1).otherwise(0).alias("target"),
    )
    return {"main": main, "ppd": ppd, "uganda": uganda}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "embedding",
                    F.when(F.col("label") == 5, 1).otherwise(0).alias("y"))
