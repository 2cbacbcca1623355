"""Per-row explanations and their aggregates.

* linear models: exact ``coef_j * (x_j - mean_j)`` columns (one projection);
* tree ensembles: Saabas path attribution over the fitted Spark trees.  The
  node arrays (bounded by model size, not data size) are read back from the
  saved model, broadcast, and walked level by level with NumPy inside
  ``mapInPandas`` (Arrow batches), so rows never leave their partition;
* global importance = mean |attribution| per feature over all rows (the
  reference sampled 100 rows);
* waterfall = running totals per row (window partitioned by row id).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskops.operators.models import dealt
from riskops.session import scratch_path


def shares(df: DataFrame, id_col: str, cols: Mapping[str, F.Column], value_name: str, out: str = "share_percent",
           positive_only: bool = False) -> DataFrame:
    """One row per feature with its percent of the row total (|v| or max(v,0)), rounded half-even to 2; all-zero rows -> 0.

    The total is taken in the row, before it is laid out by feature: nothing is shuffled. Nulls do not add to it.
    """
    part = (lambda v: F.greatest(v, F.lit(0.0))) if positive_only else F.abs
    names = list(cols)
    d = df.select(id_col, F.array(*cols.values()).alias("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + F.coalesce(part(v), F.lit(0.0)))
    d = d.select(id_col, total.alias("_t"), F.posexplode("_v").alias("ord", value_name))
    v = part(F.col(value_name))
    return d.select(id_col, F.array(*map(F.lit, names))[F.col("ord")].alias("feature"), "ord", value_name,
                    F.when(F.col("_t") <= 0, F.lit(0.0)).otherwise(F.bround(v / F.col("_t") * 100.0, 2)).alias(out))


def linear_attribution(df: DataFrame, coefficients: Mapping[str, float], id_col: str,
                       means: Mapping[str, float] | None = None) -> DataFrame:
    """G19 (linear): attribution_j = coef_j * (x_j - mean_j); share = |attr| / sum |attr| in %."""
    if means is None:
        r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(coefficients)]).first()
        means = {c: r[f"m{i}"] for i, c in enumerate(coefficients)}
    cols = {c: (F.col(c).cast("double") - F.lit(float(means[c]))) * F.lit(float(w)) for c, w in coefficients.items()}
    return shares(df, id_col, cols, "attribution")


def logistic_coefficients(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """Coefficients of the last LogisticRegression stage (in the scaled feature space)."""
    lr = model.stages[-1]
    return {f: float(c) for f, c in zip(features, lr.coefficients.toArray())}


def importance_contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """Feature importance x |value| per row, normalised to % of the positive total."""
    imp = model.stages[-1].featureImportances.toArray()
    cols = {f: F.abs(F.col(f).cast("double")) * F.lit(float(imp[i])) for i, f in enumerate(features)}
    return shares(df, id_col, cols, "contribution", "contribution_percent", positive_only=True)


def global_importance(attr: DataFrame, value_col: str = "attribution") -> DataFrame:
    """Mean |attribution| per feature over all rows, ranked."""
    g = attr.groupBy("feature").agg(F.avg(F.abs(value_col)).alias("mean_abs_attribution"),
                                    F.count(F.lit(1)).alias("rows"))
    w = Window.orderBy(F.col("mean_abs_attribution").desc(), F.col("feature"))  # one row per feature
    return g.withColumn("rank", F.row_number().over(w))


def attribution_waterfall(attr: DataFrame, id_col: str, base: float | F.Column = 0.0,
                          value_col: str = "attribution") -> DataFrame:
    """Per row, contributions by |value| desc with running start / end values."""
    w = Window.partitionBy(id_col).orderBy(F.abs(value_col).desc(), F.col("feature"))
    b = base if isinstance(base, F.Column) else F.lit(float(base))
    run = F.sum(value_col).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return attr.select(id_col, "feature", value_col, F.row_number().over(w).alias("step"),
                       (b + run - F.col(value_col)).alias("start"), (b + run).alias("end"))


# ------------------------------------------------------------------ tree attribution (Saabas)


def tree_nodes(model, spark) -> tuple[list[dict], list[float], str]:
    """Read the fitted ensemble's nodes back from its saved form (bounded by model size)."""
    path = scratch_path(spark, f"tree-export-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").collect()
    md = spark.read.parquet(os.path.join(path, "treesMetadata"))
    tid, wcol = ("treeID", "weights") if "treeID" in md.columns else ("_1", md.columns[-1])
    meta = md.select(tid, wcol).collect()
    weights = [0.0] * len(meta)
    for r in meta:
        weights[int(r[0])] = float(r[1])
    kind = "gbt" if "GBT" in type(model).__name__ else "rf"
    return [r.asDict() for r in nodes], weights, kind


def _pack(nodes: list[dict], n_trees: int, kind: str):
    size = max(r["id"] for r in nodes) + 1
    feat = np.full((n_trees, size), -1, dtype=np.int64)
    thr = np.zeros((n_trees, size))
    left = np.full((n_trees, size), -1, dtype=np.int64)
    right = np.full((n_trees, size), -1, dtype=np.int64)
    val = np.zeros((n_trees, size))
    for r in nodes:
        t, i = int(r["treeID"]), int(r["id"])
        left[t, i], right[t, i] = r["leftChild"], r["rightChild"]
        if r["leftChild"] >= 0:
            feat[t, i] = r["featureIndex"]
            thr[t, i] = r["leftCategoriesOrThreshold"][0]
        if kind == "rf":
            stats = np.asarray(r["impurityStats"], dtype=float)
            val[t, i] = stats[1] / stats.sum() if stats.sum() > 0 and len(stats) > 1 else 0.0
        else:
            val[t, i] = r["prediction"]
    return feat, thr, left, right, val


def tree_attribution(model: PipelineModel, df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """G19 (trees): Saabas attribution per row and feature for RF (probability) or GBT (margin).

    Additive: ``base + sum(attribution) = prediction`` (RF probability of class 1,
    GBT margin).  Output ``(id, feature, attribution, base)``.
    """
    spark = df.sparkSession
    ens = model.stages[-1]
    nodes, weights, kind = tree_nodes(ens, spark)
    n_trees = len(weights)
    packed = _pack(nodes, n_trees, kind)
    tw = np.asarray(weights) if kind == "gbt" else np.full(n_trees, 1.0 / n_trees)
    bc = spark.sparkContext.broadcast((packed, tw))
    nf = len(features)
    names = list(features)
    x = model.transform(dealt(df, anew=False)).select(F.col(id_col).cast("string").alias("id"),
                                   vector_to_array("features").alias("x"))

    def run(batches):
        (feat, thr, left, right, val), w = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["x"].to_numpy()).astype(float)
            n = X.shape[0]
            attr = np.zeros((n, nf))
            base = 0.0
            rows = np.arange(n)
            for t in range(feat.shape[0]):
                node = np.zeros(n, dtype=np.int64)
                base += w[t] * val[t, 0]
                while True:
                    f = feat[t, node]
                    active = f >= 0
                    if not active.any():
                        break
                    fa = np.where(active, f, 0)
                    go_left = X[rows, fa] <= thr[t, node]
                    child = np.where(go_left, left[t, node], right[t, node])
                    child = np.where(active, child, node)
                    delta = (val[t, child] - val[t, node]) * w[t]
                    attr[rows[active], fa[active]] += delta[active]  # a row is met once
                    node = child
            out = pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), nf), "feature": np.tile(names, n),
                                "attribution": attr.reshape(-1), "base": base})
            yield out

    res = x.mapInPandas(run, "id string, feature string, attribution double, base double")
    return res.withColumnRenamed("id", id_col)
