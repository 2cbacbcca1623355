"""Structured risk scoring: crisis override (G15), heuristic risk (G16) and its
contributions (G17).  All set-at-a-time column expressions: one narrow
projection, no shuffle.

Input columns (flat request schema): ``gestational_weeks, sleep_quality, appetite,
fatigue, financial_stress, self_harm`` (behavioural scales 0-10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference (heuristic weights, crisis rule, messages).
HEURISTIC_WEIGHTS = {
    "gestational_weeks": 0.25,
    "sleep_quality": 0.25,
    "appetite": 0.15,
    "fatigue": 0.2,
    "financial_stress": 0.15,
}
CRISIS_SELF_HARM_REASON = "self-harm indicator"
CRISIS_CLUSTER_REASON = "critical behavioral threshold cluster"
CRISIS_MESSAGE_PREFIX = "Crisis mode activated: immediate support is required. Trigger: "
CRISIS_MESSAGE_SUFFIX = ". Please contact local emergency services and a clinician."
HEURISTIC_MESSAGE = "Heuristic risk score (model not loaded)."


def crisis_reason(
    self_harm="self_harm", sleep="sleep_quality", appetite="appetite", fatigue="fatigue"
) -> Column:
    """NULL when no crisis rule fires, else the trigger text (self-harm checked first)."""
    c = F.col
    return (
        F.when(c(self_harm) > 0, F.lit(CRISIS_SELF_HARM_REASON))
        .when((c(sleep) <= 2) & (c(appetite) <= 2) & (c(fatigue) >= 9), F.lit(CRISIS_CLUSTER_REASON))
    )


def crisis_override(df: DataFrame) -> DataFrame:
    """Add ``crisis_mode``, ``crisis_reason`` and the override risk (100 or NULL)."""
    r = crisis_reason()
    return df.select(
        "*",
        F.coalesce(r.isNotNull(), F.lit(False)).alias("crisis_mode"),
        r.alias("crisis_reason"),
        F.when(r.isNotNull(), F.lit(100.0)).alias("override_risk"),
    )


def _terms() -> dict[str, Column]:
    w = HEURISTIC_WEIGHTS
    c = F.col
    return {
        "gestational_weeks": (c("gestational_weeks") / F.lit(42.0) * 10.0) * w["gestational_weeks"],
        "sleep_quality": (F.lit(10.0) - c("sleep_quality")) * w["sleep_quality"],
        "appetite": (F.lit(10.0) - c("appetite")) * w["appetite"],
        "fatigue": c("fatigue").cast("double") * w["fatigue"],
        "financial_stress": c("financial_stress").cast("double") * w["financial_stress"],
    }


def heuristic_risk_expr() -> Column:
    t = _terms()
    raw = (t["gestational_weeks"] + t["sleep_quality"] + t["appetite"] + t["fatigue"]
           + t["financial_stress"])
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw / 10.0 * 100.0))


def heuristic_risk(df: DataFrame) -> DataFrame:
    """Weighted heuristic risk in [0, 100]."""
    return df.select("*", heuristic_risk_expr().alias("heuristic_risk"))


def score_requests(df: DataFrame, model_risk: str | None = None) -> DataFrame:
    """Crisis override, then model risk if given (column name), else heuristic.

    ``score_source`` says which branch produced the number (the reference
    silently fell back to the heuristic on any error).
    """
    r = crisis_reason()
    crisis = r.isNotNull()
    h = heuristic_risk_expr()
    if model_risk is not None:
        base = F.coalesce(F.col(model_risk), h)
        src = F.when(F.col(model_risk).isNotNull(), F.lit("model")).otherwise(F.lit("heuristic"))
    else:
        base, src = h, F.lit("heuristic")
    return df.select(
        "*",
        F.when(crisis, F.lit(100.0)).otherwise(base).alias("risk_percent"),
        F.coalesce(crisis, F.lit(False)).alias("crisis_mode"),
        F.when(crisis, F.lit("crisis_rule")).otherwise(src).alias("score_source"),
        F.when(crisis, F.concat(F.lit(CRISIS_MESSAGE_PREFIX), r, F.lit(CRISIS_MESSAGE_SUFFIX)))
        .otherwise(F.lit(HEURISTIC_MESSAGE)).alias("message"),
    )


def risk_contributions(df: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """Heuristic terms as percent of the positive total, rounded half-even to 2.

    Output rows ``(id, feature, ord, contribution, contribution_percent)``; crisis
    rows produce no contribution rows (the reference returns an empty list).
    All-zero positives give 0.0 for every feature.  The per-id total is a row
    expression (the five terms sit on one row), so no window or shuffle is needed.
    """
    t = _terms()
    names = list(HEURISTIC_WEIGHTS)
    crisis = crisis_reason().isNotNull()
    total = None
    for n in names:
        pos = F.greatest(t[n], F.lit(0.0))
        total = pos if total is None else total + pos
    entries = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.lit(i).alias("ord"), t[n].alias("value"))
        for i, n in enumerate(names)
    ])
    base = df.where(~F.coalesce(crisis, F.lit(False))).select(
        F.col(id_col), total.alias("_total"), F.explode(entries).alias("e")
    )
    pct = F.when(F.col("_total") <= 0, F.lit(0.0)).otherwise(
        F.bround(F.greatest(F.col("e.value"), F.lit(0.0)) / F.col("_total") * 100.0, 2)
    )
    return base.select(
        F.col(id_col),
        F.col("e.feature").alias("feature"),
        F.col("e.ord").alias("ord"),
        F.col("e.value").alias("contribution"),
        pct.alias("contribution_percent"),
    )
