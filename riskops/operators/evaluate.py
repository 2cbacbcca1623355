"""Model-evaluation aggregates over a ``scored`` table ``(id, label, score[, group])``.

Every metric is a DataFrame aggregation: one pass with conditional sums, or the
exact two-level prefix sum of :mod:`riskops.operators.rank`.  Only finished
metric rows (a handful, or one per distinct score for curves) come out; nothing
row-sized reaches the driver.  ``positive`` names the positive label value; the
reference flips it between scripts, so it is always explicit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskops.functions.exprs import uniform
from riskops.operators.rank import cumulative, score_histogram
from riskops.session import written


def _pred(score: str, threshold: float):
    return F.col(score) >= F.lit(float(threshold))


def _counts(df: DataFrame, score: str, label: str, threshold: float, positive=1, group_cols=()):
    y = F.col(label) == F.lit(positive)
    p = _pred(score, threshold)
    # (coalesce: over an empty input every cell is 0, not NULL)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(y & p, 1).otherwise(0)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~y & p, 1).otherwise(0)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~y & ~p, 1).otherwise(0)), F.lit(0)).alias("tn"),
        F.coalesce(F.sum(F.when(y & ~p, 1).otherwise(0)), F.lit(0)).alias("fn"),
    )


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


# ---------------------------------------------------------------- E1 / E2


def confusion_matrix(df: DataFrame, score: str = "p", label: str = "y", threshold: float = 0.5,
                     positive=1) -> DataFrame:
    """The 2x2 matrix as four rows ``(actual, predicted, n)``, zero cells kept."""
    c = _counts(df, score, label, threshold, positive)
    cells = F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
    )
    return c.select(F.inline(cells)).select("actual", "predicted", F.col("n").cast("bigint").alias("n"))


def metrics_from_counts(c: DataFrame) -> DataFrame:
    """Point metrics from ``tp, fp, tn, fn`` columns (zero_division = 0)."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec1, rec1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    prec0, rec0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    f1_0 = _safe_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    return c.select(
        "*",
        _safe_div(tp + tn, n).alias("accuracy"),
        prec1.alias("precision"), rec1.alias("recall"), f1_1.alias("f1"),
        ((prec0 + prec1) / 2).alias("precision_macro"),
        ((rec0 + rec1) / 2).alias("recall_macro"),
        ((f1_0 + f1_1) / 2).alias("f1_macro"),
        _safe_div(prec0 * s0 + prec1 * s1, n).alias("precision_weighted"),
        _safe_div(rec0 * s0 + rec1 * s1, n).alias("recall_weighted"),
        _safe_div(f1_0 * s0 + f1_1 * s1, n).alias("f1_weighted"),
        s1.alias("support_pos"), s0.alias("support_neg"),
    )


def classification_metrics(df: DataFrame, score: str = "p", label: str = "y", threshold: float = 0.5,
                           positive=1, group_cols: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class + macro / weighted averages."""
    return metrics_from_counts(_counts(df, score, label, threshold, positive, group_cols))


def classification_report(df: DataFrame, score: str = "p", label: str = "y", threshold: float = 0.5,
                          positive=1, class_names: tuple[str, str] = ("0", "1")) -> DataFrame:
    """Per-class report rows (class, precision, recall, f1_score, support) + averages."""
    m = classification_metrics(df, score, label, threshold, positive)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rows = F.array(
        F.struct(F.lit(class_names[0]).alias("class"), _safe_div(tn, tn + fn).alias("precision"),
                 _safe_div(tn, tn + fp).alias("recall"), _safe_div(2 * tn, 2 * tn + fn + fp).alias("f1_score"),
                 (tn + fp).cast("double").alias("support")),
        F.struct(F.lit(class_names[1]).alias("class"), F.col("precision"), F.col("recall"),
                 F.col("f1").alias("f1_score"), (tp + fn).cast("double").alias("support")),
        F.struct(F.lit("accuracy").alias("class"), F.col("accuracy").alias("precision"),
                 F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1_score"),
                 F.col("n").cast("double").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("precision_macro").alias("precision"),
                 F.col("recall_macro").alias("recall"), F.col("f1_macro").alias("f1_score"),
                 F.col("n").cast("double").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("precision_weighted").alias("precision"),
                 F.col("recall_weighted").alias("recall"), F.col("f1_weighted").alias("f1_score"),
                 F.col("n").cast("double").alias("support")),
    )
    return m.select(F.inline(rows))


# ---------------------------------------------------------------- E3 / E4 / E5


def roc_auc(df: DataFrame, score: str = "p", label: str = "y", group_cols: Sequence[str] = (),
            positive=1, weight: str | None = None) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney, ties count one half) per group.

    NULL when a group holds a single class (scikit-learn raises there).
    """
    h = written(score_histogram(df, score, label, group_cols, weight, positive), "histogram")  # read for the ranges, their sums and the rows
    c = cumulative(h, ["score"], ["neg"], group_cols)
    below = F.col("neg_cum") - F.col("neg")
    agg = c.groupBy(*group_cols).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("_s"),
    )
    return agg.select(
        *group_cols, "n_pos", "n_neg",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_s") / (F.col("n_pos") * F.col("n_neg")))
        .alias("roc_auc"),
    )


def _desc_curve(df, score, label, group_cols=(), positive=1):
    """Distinct scores with inclusive tp/fp counts in descending score order."""
    h = score_histogram(df, score, label, group_cols, None, positive).withColumn("_neg_score", -F.col("score"))
    h = h.withColumn("one", F.lit(1))
    c = cumulative(h, ["_neg_score"], ["pos", "neg", "one"], group_cols)
    return c.select(*group_cols, "score", "pos", "neg", F.col("pos_cum").alias("tps"),
                    F.col("neg_cum").alias("fps"), F.col("one_cum").alias("idx"))


def average_precision(df: DataFrame, score: str = "p", label: str = "y", group_cols: Sequence[str] = (),
                      positive=1) -> DataFrame:
    """Step-wise average precision  sum (R_n - R_{n-1}) P_n  over distinct thresholds."""
    c = _desc_curve(df, score, label, group_cols, positive)
    agg = c.groupBy(*group_cols).agg(
        F.sum("pos").alias("n_pos"),
        F.sum(F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps"))).alias("_s"),
    )
    return agg.select(*group_cols, "n_pos",
                      F.when(F.col("n_pos") > 0, F.col("_s") / F.col("n_pos")).alias("average_precision"))


def brier_score(df: DataFrame, score: str = "p", label: str = "y", positive=1,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """E5: mean squared difference between score and the 0/1 outcome."""
    y = F.when(F.col(label) == F.lit(positive), 1.0).otherwise(0.0)
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"),
                                       F.avg(F.pow(F.col(score) - y, 2)).alias("brier_score"))


# ---------------------------------------------------------------- E6 / E7 / E8


def _totals(h: DataFrame) -> tuple[float, float]:
    """Positive / negative totals of a score histogram (one bounded row)."""
    r = h.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return float(r["P"] or 0), float(r["N"] or 0)


def roc_curve(df: DataFrame, score: str = "p", label: str = "y", positive=1) -> DataFrame:
    """ROC points per distinct score, starting at (0,0); collinear points dropped.

    A point is dropped when the step to the next point equals the step into it
    (same (neg, pos) counts) - the scikit-learn ``drop_intermediate`` rule.  The
    neighbour is fetched by an equi-join on the running index, not by an
    unpartitioned ``lead``.
    """
    c = _desc_curve(df, score, label, (), positive)
    P, N = _totals(c)
    nxt = c.select((F.col("idx") - 1).alias("idx"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    j = c.join(nxt, "idx", "left")
    keep = (F.col("idx") == 1) | F.col("next_pos").isNull() | \
        (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    pts = j.where(keep).select(F.col("idx").cast("long").alias("idx"), F.col("score").alias("threshold"),
                               F.col("fps").cast("double").alias("fps"), F.col("tps").cast("double").alias("tps"))
    origin = c.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"),
                                            F.lit(None).cast("double").alias("threshold"),
                                            F.lit(0.0).alias("fps"), F.lit(0.0).alias("tps"))
    allp = origin.unionByName(pts)
    return allp.select(
        "idx", "threshold",
        (F.col("fps") / F.lit(N) if N > 0 else F.lit(None).cast("double")).alias("fpr"),
        (F.col("tps") / F.lit(P) if P > 0 else F.lit(None).cast("double")).alias("tpr"),
    )


def pr_curve(df: DataFrame, score: str = "p", label: str = "y", positive=1) -> DataFrame:
    """(precision, recall) per distinct score, closed by the point (1, 0)."""
    c = _desc_curve(df, score, label, (), positive)
    P, _ = _totals(c)
    pts = c.select(
        F.col("idx").cast("long").alias("idx"), F.col("score").alias("threshold"),
        _safe_div(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
        (F.col("tps") / F.lit(P) if P > 0 else F.lit(1.0)).alias("recall"),
    )
    end = c.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"), F.lit(None).cast("double").alias("threshold"),
                                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Exact linear-interpolation quantiles (numpy / ``quantile_cont`` definition).

    Counts per distinct value -> exact running count -> one aggregate with two
    conditional ``min`` per probability.  Returns a short list of numbers.
    """
    h = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    c = cumulative(h, ["v"], ["cnt"])
    n_row = h.agg(F.sum("cnt").alias("n")).first()
    n = int(n_row["n"] or 0)
    if n == 0:
        return [None for _ in probs]
    exprs, pos = [], []
    for i, q in enumerate(probs):
        h_pos = (n - 1) * float(q)
        lo = int(math.floor(h_pos))
        hi = min(lo + 1, n - 1)
        pos.append((lo, hi, h_pos - lo))
        exprs.append(F.min(F.when(F.col("cnt_cum") > lo, F.col("v"))).alias(f"lo{i}"))
        exprs.append(F.min(F.when(F.col("cnt_cum") > hi, F.col("v"))).alias(f"hi{i}"))
    r = c.agg(*exprs).first()
    out = []
    for i, (lo, hi, frac) in enumerate(pos):
        a, b = r[f"lo{i}"], r[f"hi{i}"]
        out.append(a + frac * (b - a))
    return out


def calibration_curve(df: DataFrame, score: str = "p", label: str = "y", n_bins: int = 10,
                      positive=1) -> DataFrame:
    """Quantile-binned reliability curve; bin = number of inner edges < score."""
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = exact_quantiles(df, score, probs)
    edges = [e for e in edges if e is not None]
    s = F.col(score).cast("double")
    b = F.lit(0)
    for e in edges:
        b = b + F.when(F.lit(float(e)) < s, 1).otherwise(0)
    y = F.when(F.col(label) == F.lit(positive), 1.0).otherwise(0.0)
    return (df.where(F.col(score).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("prob_true"), F.avg(s).alias("prob_pred")))


# ---------------------------------------------------------------- E9 / E10


def best_accuracy_threshold(df: DataFrame, score: str = "p", label: str = "y", positive=1,
                            decimals: int = 4) -> DataFrame:
    """Candidates are the distinct scores rounded half-even to ``decimals``; the
    lowest candidate with the highest accuracy wins; raw scores are compared.

    Candidates and data are unioned and ordered by (value, kind) with candidates
    first, so the running sums at a candidate count exactly the scores below it.
    """
    scale = float(10 ** decimals)
    h = score_histogram(df, score, label, (), None, positive)
    data = h.select(F.col("score").alias("v"), F.lit(1).alias("kind"), "pos", "neg")
    cand = (h.select((F.rint(F.col("score") * scale) / scale).alias("v")).distinct()
            .select("v", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")))
    u = data.unionByName(cand)
    c = cumulative(u, ["v", "kind"], ["pos", "neg"])
    # correct(t) = P - pos_below(t) + neg_below(t); P is constant, so maximise the difference;
    # struct order (diff, -t) makes the lowest threshold win ties.
    best = c.agg(
        F.sum("pos").alias("P"), F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.max(F.when(F.col("kind") == 0, F.struct((F.col("neg_cum") - F.col("pos_cum")).alias("d"),
                                                   (-F.col("v")).alias("nt")))).alias("b"),
    )
    return best.select(
        F.coalesce(F.bround(-F.col("b.nt"), decimals), F.lit(0.5)).alias("threshold"),
        ((F.col("P") + F.col("b.d")) / F.col("n")).alias("accuracy"),
    )


def threshold_grid(start: float = 0.25, stop: float = 0.75, num: int = 101) -> list[float]:
    """``numpy.linspace`` values (i * step + start, last point = stop)."""
    step = (stop - start) / (num - 1)
    vals = [i * step + start for i in range(num)]
    vals[-1] = stop
    return vals


def _threshold_counts(df: DataFrame, thresholds: Sequence[float], score: str, label: str, positive=1) -> DataFrame:
    """ONE scan, two conditional sums per threshold -> one row."""
    y = F.col(label) == F.lit(positive)
    s = F.col(score)
    aggs = [F.sum(F.when(y, 1).otherwise(0)).alias("P"), F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(thresholds):
        aggs.append(F.sum(F.when(y & (s >= F.lit(float(t))), 1).otherwise(0)).alias(f"tp{i}"))
        aggs.append(F.sum(F.when(~y & (s >= F.lit(float(t))), 1).otherwise(0)).alias(f"fp{i}"))
    return df.agg(*aggs)


def _rounded_metrics(tp, fp, P, n, prefix=""):
    fn, tn = P - tp, n - P - fp
    return [
        F.bround(_safe_div(tp + tn, n), 4).alias(prefix + "accuracy"),
        F.bround(_safe_div(tp, tp + fp), 4).alias(prefix + "precision"),
        F.bround(_safe_div(tp, P), 4).alias(prefix + "recall"),
        F.bround(_safe_div(2 * tp, 2 * tp + fp + fn), 4).alias(prefix + "f1"),
    ]


def metrics_at_thresholds(df: DataFrame, thresholds: Sequence[float], score: str = "p", label: str = "y",
                          positive=1) -> DataFrame:
    """Counts and metrics (rounded half-even to 4) at each threshold."""
    one = _threshold_counts(df, thresholds, score, label, positive)
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"),
                             F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
                    for i, t in enumerate(thresholds)])
    rows = one.select("P", "n", F.inline(arr))
    return rows.select("i", "threshold", "tp", "fp", *_rounded_metrics(F.col("tp"), F.col("fp"), F.col("P"), F.col("n")))


def recall_tuned_threshold(df: DataFrame, score: str = "p", label: str = "y", positive=1,
                           max_precision_drop: float = 0.04, keep_baseline_on_tie: bool = True) -> DataFrame:
    """Highest recall (then F1, then lowest threshold) among thresholds 0.25..0.75
    whose rounded precision stays >= baseline precision - ``max_precision_drop``.

    ``keep_baseline_on_tie=True`` starts from the 0.5 baseline (ties keep 0.5);
    False starts from no candidate (ties go to the lowest threshold).  One scan
    of the scores; the selection runs on the 101-row grid.
    """
    grid = threshold_grid()
    nb = len(grid)
    one = _threshold_counts(df, grid + [0.5], score, label, positive)
    base = one.select("*", *_rounded_metrics(F.col(f"tp{nb}"), F.col(f"fp{nb}"), F.col("P"), F.col("n"), "b_"))
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"),
                             F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
                    for i, t in enumerate(grid)])
    rows = base.select("P", "n", "b_precision", "b_recall", F.inline(arr))
    m = rows.select("*", *_rounded_metrics(F.col("tp"), F.col("fp"), F.col("P"), F.col("n")))
    ok = m.where(F.col("precision") >= F.greatest(F.lit(0.0), F.col("b_precision") - F.lit(max_precision_drop)))
    tie = F.when(F.lit(keep_baseline_on_tie) & (F.col("threshold") == 0.5), 1).otherwise(0)
    best = ok.agg(F.max(F.struct(F.col("recall"), F.col("f1"), tie.alias("tie"), (-F.col("i")).alias("ni"),
                                 F.struct("threshold", "accuracy", "precision", "recall", "f1",
                                          "b_precision", "b_recall").alias("m"))).alias("b"))
    return best.where(F.col("b").isNotNull()).select(
        "b.m.threshold", "b.m.accuracy", "b.m.precision", "b.m.recall", "b.m.f1",
        F.bround(F.col("b.m.recall") - F.col("b.m.b_recall"), 4).alias("recall_gain_vs_0_5"),
        F.bround(F.col("b.m.b_precision") - F.col("b.m.precision"), 4).alias("precision_drop_vs_0_5"),
    )


# ---------------------------------------------------------------- E11 / E12 bootstrap


def poisson1_cdf(kmax: int = 10) -> list[float]:
    """CDF of Poisson(1) at 0..kmax-1 (fixed values of the resampling rule)."""
    out, acc = [], 0.0
    for k in range(kmax):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


#: Modulus of the replicate hash (fixed value of the resampling rule).
HASH_MODULUS = 2**31 - 1
#: Rows of one score range, about, and the most ranges.
BOOT_RANGE, BOOT_MAX_RANGES = 50_000, 8192
#: Cells of one (rows x replicates) block of weights.
BOOT_BLOCK = 2_000_000


def replicate_coefficients(n_boot: int, seed: str) -> np.ndarray:
    """(3, n_boot) coefficients of the replicates' hash polynomials, from md5(seed:replicate)."""
    digests = [hashlib.md5(f"{seed}:{r}".encode()).hexdigest() for r in range(n_boot)]
    return np.array([[int(d[k:k + 8], 16) % HASH_MODULUS for d in digests] for k in (0, 8, 16)], np.int64)


def multiplicities(h: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """(rows, replicates) Poisson(1) draws: a pure function of each row's hash and the replicate.

    The quadratic polynomial over a prime field makes any three rows of a replicate independent.
    """
    a, b, c = coefficients
    x = h[:, None]
    g = ((a * x + b) % HASH_MODULUS * x + c) % HASH_MODULUS
    return np.searchsorted(poisson1_cdf(10), g / HASH_MODULUS, side="right")


def cell_sums(score: np.ndarray, h: np.ndarray, is_pos: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """(3, replicates) of one score range: positives, negatives, and the pairs in order inside it."""
    order = np.argsort(score, kind="stable")
    score, h, is_pos = score[order], h[order], is_pos[order]
    starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    out, step = [], max(1, BOOT_BLOCK // len(score))
    for at in range(0, coefficients.shape[1], step):
        w = multiplicities(h, coefficients[:, at:at + step])
        pos = np.add.reduceat(w * is_pos[:, None], starts, axis=0).astype(float)
        neg = np.add.reduceat(w * ~is_pos[:, None], starts, axis=0).astype(float)
        out.append([pos.sum(0), neg.sum(0), (pos * (neg.cumsum(0) - neg / 2)).sum(0)])
    return np.concatenate(out, axis=1)


def _score_cells(df: DataFrame, edges: list[float], salts: int) -> DataFrame:
    """Adds ``cell`` (increasing with ``s``), ``single`` (the cell holds one value) and ``salt``.

    Every edge is a cell of its own, so a value that many rows share is never inside a range;
    its rows are dealt to ``salts`` groups, as only their sums matter.
    """
    inf, last = float("inf"), 2 * len(edges) + 1
    s = F.col("s")
    if edges:
        cut = Bucketizer(splits=[-inf, *edges, inf], inputCol="s", outputCol="_b", handleInvalid="keep").transform(df)
    else:
        cut = df.withColumn("_b", F.lit(0.0))
    b = F.col("_b").cast("int")
    at_edge = (b >= 1) & s.eqNullSafe(F.get(F.array(*map(F.lit, edges)), b - 1)) if edges else F.lit(False)
    cell = (F.when(F.isnan(s), last + 2).when(s == inf, last + 1).when(s == -inf, -1)
            .when(at_edge, 2 * b - 1).otherwise(2 * b))
    single = F.isnan(s) | (F.abs(s) == inf) | at_edge
    return cut.withColumn("single", single).withColumn("cell", cell).drop("_b") \
        .withColumn("salt", F.when(F.col("single"), F.pmod("h", F.lit(salts))).otherwise(0))


def bootstrap_auc(df: DataFrame, id_col: str, scores: Sequence[str], label: str, n_boot: int, positive=1,
                  seed: str = "boot") -> DataFrame:
    """(which, rep, roc_auc): exact AUC of each score (by position) in each Poisson bootstrap replicate.

    A row crosses the network once for each score, into its score range; its n_boot weights are
    made there and summed at once.  What leaves a range is one row per replicate, whatever the
    number of rows, and a prefix sum over the ranges gives the AUC.  NULL for one-class replicates.
    """
    h = F.pmod(F.floor(uniform(seed, id_col) * 4294967296.0), F.lit(HASH_MODULUS))
    rows = df.where(F.col(label).isNotNull()).select(
        h.alias("h"), (F.col(label) == F.lit(positive)).alias("is_pos"),
        *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores)])
    n = rows.count()
    ranges = min(BOOT_MAX_RANGES, max(16, -(-n // BOOT_RANGE)))
    probs, accuracy = [i / ranges for i in range(1, ranges)], max(10_000, 8 * ranges)
    quantiles = rows.agg(*[F.percentile_approx(f"s{i}", probs, accuracy).alias(f"s{i}") for i in range(len(scores))]).first()
    parts = []
    for i in range(len(scores)):
        edges = sorted({q for q in quantiles[i] or [] if math.isfinite(q)})
        part = rows.where(F.col(f"s{i}").isNotNull()).select(F.lit(i).alias("which"), "h", "is_pos", F.col(f"s{i}").alias("s"))
        parts.append(_score_cells(part, edges, max(1, -(-n // BOOT_RANGE))))
    coefficients = replicate_coefficients(n_boot, seed)

    def weigh(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        score = np.zeros(len(g)) if key[3] else g["s"].to_numpy()
        pos, neg, pairs = cell_sums(score, g["h"].to_numpy(), g["is_pos"].to_numpy(bool), coefficients)
        return pd.DataFrame({"which": key[0], "cell": key[1], "single": key[3], "rep": np.arange(n_boot), "pos": pos, "neg": neg, "pairs": pairs})

    schema = "which int, cell int, single boolean, rep int, pos double, neg double, pairs double"
    sums = reduce(DataFrame.union, parts).groupBy("which", "cell", "salt", "single").applyInPandas(weigh, schema)
    cells = sums.groupBy("which", "rep", "cell", "single").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("pairs").alias("pairs"))
    before = Window.partitionBy("which", "rep").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.when(F.col("single"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("pairs"))
    pairs = F.sum(F.col("pos") * F.col("below") + F.col("inside"))
    out = (cells.withColumns({"below": F.coalesce(F.sum("neg").over(before), F.lit(0.0)), "inside": inside})
           .groupBy("which", "rep").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), pairs.alias("_s")))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select("which", "rep", F.when(both, F.col("_s") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"))


def bootstrap_auc_ci(df: DataFrame, id_col: str = "prediction_id", score: str = "p", label: str = "y",
                     n_boot: int = 1000, confidence: float = 0.95, positive=1, seed: str = "boot") -> DataFrame:
    """Percentile CI and SE of the AUC over bootstrap replicates (one-class replicates skipped)."""
    a = bootstrap_auc(df, id_col, [score], label, n_boot, positive, seed).where(F.col("roc_auc").isNotNull())
    alpha = 1 - confidence
    return a.agg(
        F.avg("roc_auc").alias("auc"),
        F.percentile("roc_auc", alpha / 2).alias("ci_lower"),
        F.percentile("roc_auc", 1 - alpha / 2).alias("ci_upper"),
        F.stddev_pop("roc_auc").alias("se"),
        F.count(F.lit(1)).alias("n_bootstraps"),
    )


def bootstrap_auc_diff(df: DataFrame, id_col: str = "prediction_id", score_a: str = "p", score_b: str = "p2",
                       label: str = "y", n_boot: int = 2000, positive=1, seed: str = "boot") -> DataFrame:
    """Paired bootstrap of AUC(a) - AUC(b) with the same replicate weights for both."""
    auc = bootstrap_auc(df, id_col, [score_a, score_b], label, n_boot, positive, seed)
    per = auc.groupBy("rep").agg(F.max(F.when(F.col("which") == 0, F.col("roc_auc"))).alias("auc_a"),
                                 F.max(F.when(F.col("which") == 1, F.col("roc_auc"))).alias("auc_b"))
    d = per.where(F.col("auc_a").isNotNull() & F.col("auc_b").isNotNull()) \
        .select((F.col("auc_a") - F.col("auc_b")).alias("d"))
    agg = d.agg(
        F.avg("d").alias("auc_diff_mean"),
        F.percentile("d", 0.025).alias("ci95_low"),
        F.percentile("d", 0.975).alias("ci95_high"),
        F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("_le"),
        F.avg(F.when(F.col("d") >= 0, 1.0).otherwise(0.0)).alias("_ge"),
        F.count(F.lit(1)).alias("n_bootstraps"),
    )
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.least(F.col("_le"), F.col("_ge"))))
    return agg.select("auc_diff_mean", "ci95_low", "ci95_high", p.alias("p_value_two_sided"), "n_bootstraps")


# ---------------------------------------------------------------- E16


def cv_summary(df: DataFrame, fold_col: str = "fold", score: str = "p", label: str = "y", threshold: float = 0.5,
               positive=1) -> DataFrame:
    """Mean and population std of per-fold AUC and F1 (out-of-fold scores)."""
    auc = roc_auc(df, score, label, [fold_col], positive).select(fold_col, "roc_auc")
    f1 = classification_metrics(df, score, label, threshold, positive, [fold_col]).select(fold_col, "f1")
    per = auc.join(f1, fold_col)
    return per.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_std"),
        F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"),
    )


def assign_folds(df: DataFrame, id_col: str, k: int = 5, seed: str = "fold", out: str = "fold") -> DataFrame:
    """Fold = floor(u(seed, id) * k): a pure function of the row id."""
    return df.withColumn(out, F.floor(uniform(seed, id_col) * k).cast("int"))
