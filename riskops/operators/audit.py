"""Data audits: exact / profile dedup (D1, D2), class balance (D3), label quality (D4),
train/test profile overlap (D15).

Dedup is a ``groupBy`` on all columns (NULL equals NULL, as pandas
``drop_duplicates``); counts come out of the same aggregation, so no row is
collected and hot duplicate groups collapse map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskops.functions.exprs import to_double
from riskops.operators.resample import profile_key


def dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_counts(df: DataFrame) -> DataFrame:
    """Rows before / after exact dedup and dropped rows (one shuffle)."""
    g = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("before_rows"), F.count(F.lit(1)).alias("after_rows")).select(
        "before_rows", "after_rows", (F.col("before_rows") - F.col("after_rows")).alias("dropped_exact_duplicate_rows"))


def profile_duplicates(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """After exact dedup, distinct profiles on ``feature_cols`` and rows that repeat a profile."""
    d = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    p = d.groupBy(profile_key(feature_cols).alias("_p")).agg(F.count(F.lit(1)).alias("_rows"))
    return p.agg(F.sum("_rows").alias("after_rows"), F.count(F.lit(1)).alias("unique_profiles_after_dedup")).select(
        "after_rows", "unique_profiles_after_dedup",
        (F.col("after_rows") - F.col("unique_profiles_after_dedup")).alias("profile_duplicate_rows_after_dedup"))


def class_balance(df: DataFrame, label_col: str, by: Sequence[str] = ()) -> DataFrame:
    """D3: value counts of the label (optionally per source)."""
    return df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("n"))


def label_quality_audit(df: DataFrame, score_col: str, threshold: float = 10.0,
                        near: tuple[float, float] = (9.0, 11.0)) -> DataFrame:
    """label = score >= threshold; positive rate / counts, rows near the threshold, min, max."""
    s = to_double(score_col)
    pos = F.coalesce(s >= F.lit(float(threshold)), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(pos.cast("double")).alias("positive_rate"),
        F.sum(pos.cast("int")).alias("positive_count"),
        F.sum((~pos).cast("int")).alias("negative_count"),
        F.sum(F.coalesce((s >= near[0]) & (s <= near[1]), F.lit(False)).cast("int")).alias("near_threshold_rows"),
        F.min(s).alias("score_min"), F.max(s).alias("score_max"),
    )


def split_overlap(train: DataFrame, test: DataFrame, profile_cols: Sequence[str]) -> DataFrame:
    """Number of distinct profiles present in both train and test (0 for group-safe splits)."""
    a = train.select(profile_key(profile_cols).alias("_p")).distinct()
    b = test.select(profile_key(profile_cols).alias("_p")).distinct()
    return a.join(b, "_p", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))
