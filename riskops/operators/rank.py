"""Exact global cumulative sums without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.
Instead (two-level prefix sum):

1. range-cut the ordering value into at most ``n_buckets`` buckets (by default
   two per shuffle partition, at least 512) using
   approximate quantiles of the *distinct* values (edges become literals in the
   plan, so every re-evaluation and every retried task sees the same cut);
2. sum each bucket (map-side partial aggregation; at most ``n_buckets`` rows per
   group) and prefix-sum that small table;
3. join the bucket offsets back and finish with a window partitioned by bucket.

The result is exact; only the bucket *boundaries* are approximate, which only
affects balance.  Equal ordering values always land in the same bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 512


def bucket_count(df: DataFrame, n_buckets: int | None = None) -> int:
    """Buckets for the two-level prefix sum: at least ``DEFAULT_BUCKETS`` and two per shuffle
    partition of the session, so the cluster's own sizing of ``spark.sql.shuffle.partitions``
    for its data keeps each bucket's window a bounded slice of the rows."""
    if n_buckets:
        return n_buckets
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(DEFAULT_BUCKETS, 2 * parts)


def _edges(df: DataFrame, col: str, n_buckets: int) -> list[float]:
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    accuracy = max(10000, 8 * n_buckets)  # rank error 1/accuracy stays well under one bucket
    row = df.select(F.percentile_approx(F.col(col).cast("double"), probs, accuracy).alias("q")).first()
    qs = row["q"] if row is not None else None
    if not qs:
        return []
    # infinite and NaN values fall into the outer buckets, which Bucketizer has anyway
    return sorted({float(q) for q in qs if q is not None and math.isfinite(q)})


def add_bucket(df: DataFrame, col: str, n_buckets: int | None = None, out: str = "_bucket") -> DataFrame:
    """Range bucket of ``col`` (monotone in ``col``; NULL ordering values -> bucket 0)."""
    edges = _edges(df, col, bucket_count(df, n_buckets))
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf")] + edges + [float("inf")]
    tmp = "_bucket_in"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    res = b.transform(df.withColumn(tmp, F.coalesce(F.col(col).cast("double"), F.lit(float("-inf")))))
    return res.drop(tmp)


def cumulative(
    df: DataFrame,
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    n_buckets: int | None = None,
    suffix: str = "_cum",
) -> DataFrame:
    """Add inclusive running sums ``<v><suffix>`` ordered by ``order_cols`` within ``group_cols``.

    ``order_cols[0]`` must be numeric; it drives the bucketing.  Rows tied on all
    order columns are summed in an arbitrary but complete order, so callers
    should pre-aggregate to one row per distinct key (they all do).
    """
    order_cols = list(order_cols)
    group_cols = list(group_cols)
    value_cols = list(value_cols)
    b = add_bucket(df, order_cols[0], n_buckets)
    # bucket totals per group: at most n_buckets rows per group
    totals = b.groupBy(*group_cols, "_bucket").agg(*[F.sum(v).alias(f"_bt_{v}") for v in value_cols])
    w_b = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols, "_bucket",
        *[F.coalesce(F.sum(f"_bt_{v}").over(w_b), F.lit(0)).alias(f"_off_{v}") for v in value_cols],
    )
    if not group_cols:
        # at most n_buckets rows (a few per shuffle partition): a proven bound, so broadcast
        offsets = F.broadcast(offsets)
    j = b.join(offsets, [*group_cols, "_bucket"], "inner")
    w_in = (Window.partitionBy(*group_cols, "_bucket").orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = j.select(
        *[c for c in b.columns if c != "_bucket"],
        *[(F.sum(v).over(w_in) + F.col(f"_off_{v}")).alias(f"{v}{suffix}") for v in value_cols],
    )
    return out


def score_histogram(
    df: DataFrame, score: str, label: str, group_cols: Sequence[str] = (), weight: str | None = None,
    positive=1,
) -> DataFrame:
    """One row per (group, distinct score): positive and negative (weighted) counts.

    Partial aggregation happens map-side; a hot score value collapses to one row
    per task before the shuffle.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1)
    is_pos = F.col(label) == F.lit(positive)
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*group_cols, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.when(is_pos, w).otherwise(F.lit(0))).alias("pos"),
            F.sum(F.when(~is_pos, w).otherwise(F.lit(0))).alias("neg"),
        )
    )
