"""Fairness monitoring: group positive rates, disparate impact (80 % rule),
threshold sweep, group status, deviation bands, reweighing and AUC gap.

The row-sized work is one ``groupBy(group)`` with conditional sums (partial
aggregation map-side: a group holding a third of all rows is still one row
per task before the shuffle).  Everything after that runs on the small
per-group result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskops.operators.evaluate import roc_auc

# Fixed values that must equal the reference (strategy names, report lines, 80 % rule).
DI_THRESHOLD = 0.8
STRATEGY_BIASED = "reweight_and_retrain"
STRATEGY_FAIR = "monitor_only"
STRATEGY_INSUFFICIENT = "none"
REPORT_BIASED = [
    "Bias threshold crossed (DI < 0.8).",
    "Apply sample reweighting for under-represented group outcomes.",
    "Re-evaluate DI and equalized odds after retraining.",
]
REPORT_FAIR = [
    "Parity is within acceptable threshold.",
    "Continue periodic fairness monitoring.",
]
REPORT_INSUFFICIENT = ["Need at least 2 non-zero groups for bias estimation."]
SUMMARY = "Disparate impact closer to 1.0 indicates parity; below 0.8 may indicate bias."
SUMMARY_INSUFFICIENT = "Insufficient group data to compute disparate impact."


def group_col_expr(group_col: str, unknown: str = "unknown"):
    return F.coalesce(F.col(group_col).cast("string"), F.lit(unknown))


def group_positive_rate(df: DataFrame, group_col: str = "income_band", risk_col: str = "risk_percent",
                        threshold: float = 60.0) -> DataFrame:
    """Per group ``total``, ``positives`` (risk >= threshold) and ``positive_rate``; NULL group -> 'unknown'."""
    return (
        df.groupBy(group_col_expr(group_col).alias("group"))
        .agg(F.count(F.lit(1)).alias("total"),
             F.sum(F.when(F.col(risk_col) >= F.lit(float(threshold)), 1).otherwise(0)).alias("positives"))
        .select("group", "total", "positives", (F.col("positives") / F.col("total")).alias("positive_rate"))
    )


def disparate_impact(rates: DataFrame, protected_attribute: str = "income_band",
                     rate_col: str = "positive_rate") -> DataFrame:
    """min/max over the non-zero group rates; biased if DI < 0.8 (unrounded).

    Fewer than two non-zero groups -> DI 1.0, not biased, strategy 'none'.
    Returns one row; ``disparate_impact`` is rounded half-even to 3 as in the
    service, ``disparate_impact_raw`` is the exact ratio.
    """
    nz = F.col(rate_col) > 0
    agg = rates.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum(F.when(nz, 1).otherwise(0)), F.lit(0)).alias("n_nonzero_groups"),
        F.min(F.when(nz, F.col(rate_col))).alias("min_rate"),
        F.max(F.when(nz, F.col(rate_col))).alias("max_rate"),
    )
    enough = F.col("n_nonzero_groups") >= 2
    raw = F.when(enough, F.col("min_rate") / F.col("max_rate")).otherwise(F.lit(1.0))
    biased = enough & (raw < DI_THRESHOLD)
    return agg.select(
        F.lit(protected_attribute).alias("protected_attribute"),
        "n_groups", "n_nonzero_groups", "min_rate", "max_rate",
        raw.alias("disparate_impact_raw"),
        F.when(enough, F.bround(raw, 3)).otherwise(F.lit(1.0)).alias("disparate_impact"),
        F.coalesce(biased, F.lit(False)).alias("bias_detected"),
        F.when(~enough, F.lit(STRATEGY_INSUFFICIENT)).when(biased, F.lit(STRATEGY_BIASED))
        .otherwise(F.lit(STRATEGY_FAIR)).alias("mitigation_strategy"),
        F.when(~enough, F.array(*map(F.lit, REPORT_INSUFFICIENT))).when(biased, F.array(*map(F.lit, REPORT_BIASED)))
        .otherwise(F.array(*map(F.lit, REPORT_FAIR))).alias("mitigation_report"),
        F.when(~enough, F.lit(SUMMARY_INSUFFICIENT)).otherwise(F.lit(SUMMARY)).alias("summary"),
    )


def valid_thresholds(positive_threshold: float, eval_thresholds: Sequence[float]) -> list[float]:
    """Operating threshold U eval thresholds, restricted to [0, 100], sorted, distinct."""
    return sorted({float(t) for t in [positive_threshold, *eval_thresholds] if 0 <= float(t) <= 100})


def di_by_threshold(df: DataFrame, group_col: str = "income_band", risk_col: str = "risk_percent",
                    positive_threshold: float = 60.0,
                    eval_thresholds: Sequence[float] = (40.0, 50.0, 60.0, 70.0)) -> DataFrame:
    """DI per threshold in one scan (one conditional sum per threshold), then per-threshold
    min/max over non-zero group rates; thresholds with < 2 non-zero groups are omitted."""
    ts = valid_thresholds(positive_threshold, eval_thresholds)
    if not ts:
        raise ValueError("At least one threshold in [0, 100] is required")
    g = df.groupBy(group_col_expr(group_col).alias("group")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(F.when(F.col(risk_col) >= F.lit(t), 1).otherwise(0)).alias(f"c{i}") for i, t in enumerate(ts)],
    )
    arr = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"c{i}") / F.col("total")).alias("rate"))
                    for i, t in enumerate(ts)])
    long = g.select("group", F.inline(arr))
    nz = F.col("rate") > 0
    per = long.groupBy("threshold").agg(
        F.sum(F.when(nz, 1).otherwise(0)).alias("n_nonzero_groups"),
        F.min(F.when(nz, F.col("rate"))).alias("min_rate"),
        F.max(F.when(nz, F.col("rate"))).alias("max_rate"),
    )
    return per.where(F.col("n_nonzero_groups") >= 2).select(
        "threshold", "n_nonzero_groups", "min_rate", "max_rate",
        (F.col("min_rate") / F.col("max_rate")).alias("disparate_impact_raw"),
        F.bround(F.col("min_rate") / F.col("max_rate"), 3).alias("disparate_impact"),
    )


def fairness_status(rates: DataFrame, rate_col: str = "positive_rate") -> DataFrame:
    """D8: 'Fair' if rate >= 0.8 * max rate else 'Bias' (small per-group table)."""
    # the per-group table is small (one row per group): a global window over it is cheap
    mx = F.max(rate_col).over(Window.partitionBy())
    return rates.withColumn("_max", mx).select(
        "group", F.col(rate_col),
        F.when(F.col(rate_col) >= F.col("_max") * DI_THRESHOLD, F.lit("Fair")).otherwise(F.lit("Bias")).alias("status"),
    )


def fairness_deviation(rates: DataFrame, rate_col: str = "positive_rate") -> DataFrame:
    """|rate - mean| / mean > 20 % -> high_bias, > 10 % -> moderate_bias, else fair."""
    dev = F.when(F.col("_mean") > 0, F.abs(F.col(rate_col) - F.col("_mean")) / F.col("_mean")).otherwise(F.lit(0.0))
    return rates.withColumn("_mean", F.avg(rate_col).over(Window.partitionBy())).select(
        "group", F.col(rate_col), dev.alias("deviation"),
        F.when(dev > 0.2, F.lit("high_bias")).when(dev > 0.1, F.lit("moderate_bias")).otherwise(F.lit("fair"))
        .alias("band"),
    )


def reweigh(df: DataFrame, group_col: str, label_col: str) -> DataFrame:
    """Kamiran-Calders weights  w(g, y) = P(g) P(y) / P(g, y)  as a (group, label) table."""
    gy = df.groupBy(group_col_expr(group_col).alias("group"), F.col(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("n_gy"))
    # gy has (#groups x #labels) rows; the marginals are windows over that small table
    out = gy.select(
        "*",
        F.sum("n_gy").over(Window.partitionBy("group")).alias("n_g"),
        F.sum("n_gy").over(Window.partitionBy("label")).alias("n_y"),
        F.sum("n_gy").over(Window.partitionBy()).alias("n"),
    )
    return out.select("group", "label", "n_gy", "n_g", "n_y", "n",
                      ((F.col("n_g") * F.col("n_y")) / (F.col("n") * F.col("n_gy"))).alias("weight"))


def weighted_rates(df: DataFrame, group_col: str, label_col: str, weights: DataFrame | None = None) -> DataFrame:
    """Per-group positive rate of ``label_col``, optionally weighted by a D11 table."""
    base = df.select(group_col_expr(group_col).alias("group"), F.col(label_col).alias("label"))
    if weights is None:
        w = base.withColumn("w", F.lit(1.0))
    else:
        # one row per group and label: Spark broadcasts it where its size allows
        w = base.join(weights.select("group", "label", F.col("weight").alias("w")), ["group", "label"])
    return w.groupBy("group").agg(
        (F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("positive_rate"))


def mitigation_effect(df: DataFrame, group_col: str = "income_band", label_col: str = "y",
                      protected_attribute: str = "income_band") -> DataFrame:
    """DI before and after reweighing, and the improvement."""
    before = weighted_rates(df, group_col, label_col).withColumn("phase", F.lit("before"))
    after = weighted_rates(df, group_col, label_col, reweigh(df, group_col, label_col)) \
        .withColumn("phase", F.lit("after"))
    nz = F.col("positive_rate") > 0
    per = before.unionByName(after).groupBy("phase").agg(
        F.sum(F.when(nz, 1).otherwise(0)).alias("k"),
        (F.min(F.when(nz, F.col("positive_rate"))) / F.max(F.when(nz, F.col("positive_rate")))).alias("r"))
    di = F.when(F.col("k") >= 2, F.col("r")).otherwise(F.lit(1.0))
    out = per.agg(F.max(F.when(F.col("phase") == "before", di)).alias("before_di"),
                  F.max(F.when(F.col("phase") == "after", di)).alias("after_di"))
    return out.select(
        F.lit(protected_attribute).alias("protected_attribute"), "before_di", "after_di",
        (F.col("after_di") - F.col("before_di")).alias("improvement"))


def auc_gap(df: DataFrame, group_col: str = "income_band", score: str = "p", label: str = "y") -> DataFrame:
    """Exact AUC per group (groups with both classes) and the max - min gap."""
    per = roc_auc(df.withColumn("group", group_col_expr(group_col)), score, label, ["group"])
    ok = per.where(F.col("roc_auc").isNotNull())
    return ok.agg(F.count(F.lit(1)).alias("n_groups"), F.min("roc_auc").alias("min_auc"),
                  F.max("roc_auc").alias("max_auc"),
                  (F.max("roc_auc") - F.min("roc_auc")).alias("auc_gap"))
