"""Exact Shapley values of tree ensembles (G19), path-dependent, in polynomial time.

A leaf adds ``v`` to the prediction if the row passes every split above it. Splits on one
feature together are one interval, so for a leaf with ``k`` features on its path a row is only
a pattern of ``k`` bits (inside the interval or not), and a feature that is not known passes with
the share of training weight that does (cover). The subset sums of Shapley's formula are kept as one weight for
each subset size: ``extend`` takes a feature into them, ``without`` takes it out again. Both run for many
leaves and all their patterns at once (for the patterns that occur, where a leaf has many features); a row then
only looks its pattern up. Neighbouring leaves have most of their intervals in common, so their tables are added up to one, by
the patterns of all their intervals, and are looked up once.

The ensemble's intervals, covers and values are bounded by the model and go to the tasks in one
broadcast; rows never leave their partition. ``base + sum(attributions)`` is the prediction: the
probability of a class (forest) or the margin (boosted trees).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskops.operators.explain import tree_nodes
from riskops.operators.models import dealt


@dataclass(frozen=True)
class Leaf:
    """A leaf's value and, for each feature on its path, the interval a row must lie in and the cover share that does.

    A value passes if it is above ``low`` and not above ``high``; a bound that no split sets is null. NaN goes to the right.
    """

    value: float
    features: tuple[int, ...]
    low: tuple[float | None, ...]
    high: tuple[float | None, ...]
    cover: tuple[float, ...]


def leaves(nodes: dict[int, dict], value, cover) -> list[Leaf]:
    """The leaves of one tree; ``nodes`` by id with featureIndex, threshold and children, ``value`` and ``cover`` of a node."""
    out, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            feats = tuple(sorted(path))
            out.append(Leaf(float(value(node)), feats, *(tuple(path[f][k] for f in feats) for k in range(3))))
            continue
        f, threshold, whole = int(node["featureIndex"]), float(node["threshold"]), cover(node)
        low, high, share = path.get(f, (None, None, 1.0))
        for child, bounds in (
            (node["leftChild"], (low, threshold if high is None else min(high, threshold))),
            (node["rightChild"], (threshold if low is None else max(low, threshold), high)),
        ):
            part = cover(nodes[child]) / whole if whole > 0 else 0.5
            todo.append((child, {**path, f: (*bounds, share * part)}))
    return out


def extend(weights: list[np.ndarray], zero: np.ndarray, one: np.ndarray) -> list[np.ndarray]:
    """Weights by subset size after a feature with cover ``zero`` (a row for each leaf) and pass bits ``one`` (a column for each pattern) has come in."""
    n = len(weights)
    stay = [w * (zero * ((n - size) / (n + 1))) for size, w in enumerate(weights)]
    grow = [w * (one * ((size + 1) / (n + 1))) for size, w in enumerate(weights)]
    return [stay[0], *(a + b for a, b in zip(stay[1:], grow)), grow[-1]]


def without(weights: list[np.ndarray], zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The sum of the weights from which a feature is taken out again."""
    n = len(weights) - 1
    passed, failed, ahead = 0.0, 0.0, weights[n]
    for size in range(n - 1, -1, -1):
        # a passing feature: from the largest subset down; a failing one only scaled the weights
        own = ahead * ((n + 1) / (size + 1))
        passed = passed + own
        ahead = weights[size] - own * (zero * ((n - size) / (n + 1)))
        failed = failed + weights[size] * ((n + 1) / (n - size))
    return np.where(one > 0, passed, np.divide(failed, zero, out=np.zeros_like(failed), where=zero > 0))


def pattern_values(value: np.ndarray, cover: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Shapley values of leaves with as many features (a row of ``cover`` each) for patterns of passed features (a bit each):
    leaves x features x patterns."""
    bits = (patterns >> np.arange(cover.shape[1])[:, None]) & 1
    zeros = [c[:, None] for c in cover.T]
    weights = [np.ones((len(cover), len(patterns)))]
    for zero, one in zip(zeros, bits):
        weights = extend(weights, zero, one)
    return np.stack([value[:, None] * (one - zero) * without(weights, zero, one) for zero, one in zip(zeros, bits)], axis=1)


#: Most features of a leaf whose patterns are all laid out, numbers in such a table, and rows whose patterns are taken together.
TABLE_FEATURES, TABLE_VALUES, BLOCK_ROWS = 8, 1 << 20, 1 << 14
#: Most different intervals of leaves that are looked up together, and rows that a task explains at a time.
MERGED_BITS, TASK_ROWS = 10, 1 << 16


def patterns_of(leaf: Leaf, at_most: Callable[[int, float], np.ndarray], dtype) -> np.ndarray:
    """A bit for each feature of the leaf that a row passes; ``at_most`` tells of a feature which rows are not above a bound."""
    out = 0
    for k, (f, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
        passes = at_most(f, high) if low is None else ~at_most(f, low) if high is None else at_most(f, high) > at_most(f, low)
        out = out + passes * dtype(1 << k)
    return out


def neighbours(part: Sequence[tuple[Leaf, float]], most: int) -> Iterator[tuple[list[int], dict[tuple, int]]]:
    """Runs of leaves that have at most so many different intervals (one leaf may have more), and a bit for each interval."""
    run: list[int] = []
    bits: dict[tuple, int] = {}
    for i, (leaf, _) in enumerate(part):
        own = list(zip(leaf.features, leaf.low, leaf.high))
        if run and len(bits) + sum(c not in bits for c in own) > most:
            yield run, bits
            run, bits = [], {}
        for c in own:
            bits.setdefault(c, len(bits))
        run.append(i)
    if run:
        yield run, bits


def merged_table(part: Sequence[tuple[Leaf, float]], tables: np.ndarray, run: list[int], bits: dict[tuple, int]) -> dict[int, np.ndarray]:
    """The leaves' values by feature, added up for each pattern of all their intervals."""
    patterns = np.arange(1 << len(bits))
    bit = [(patterns >> k) & 1 for k in range(len(bits))]
    out: dict[int, np.ndarray] = {}
    for i in run:
        leaf = part[i][0]
        own = sum(bit[bits[c]] << k for k, c in enumerate(zip(leaf.features, leaf.low, leaf.high)))
        for f, values in zip(leaf.features, tables[i]):
            more = values.take(own)
            out[f] = out[f] + more if f in out else more
    return out


def shapley(trees: Sequence[Sequence[Leaf]], scale: Sequence[float], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Values for each row and feature of ``x``, and the expected prediction."""
    out, base = np.zeros(x.shape[::-1]), 0.0
    by_size: dict[int, list[tuple[Leaf, float]]] = {}
    for tree, share in zip(trees, scale):
        for leaf in tree:
            base += share * leaf.value * float(np.prod(leaf.cover))
            if leaf.features and len(x):
                by_size.setdefault(len(leaf.features), []).append((leaf, share))
    columns = np.ascontiguousarray(x.T)
    blocks = [slice(start, start + BLOCK_ROWS) for start in range(0, len(x), BLOCK_ROWS)]
    at_most = [cache(lambda f, bound, rows=rows: columns[f, rows] <= bound) for rows in blocks]
    # a table of 2^bits patterns pays if there are some times as many rows
    most = min(MERGED_BITS, len(x).bit_length() - 3)
    for size, own in by_size.items():
        laid_out = size <= TABLE_FEATURES
        step = max(1, (TABLE_VALUES >> size) // size) if laid_out else 1
        for first in range(0, len(own), step):
            part = own[first:first + step]
            value, cover = np.array([leaf.value * share for leaf, share in part]), np.array([leaf.cover for leaf, _ in part])
            if not laid_out:  # only the patterns that occur
                for rows, test in zip(blocks, at_most):
                    patterns, of = np.unique(patterns_of(part[0][0], test, np.int64), return_inverse=True)
                    for f, values in zip(part[0][0].features, pattern_values(value, cover, patterns)[0]):
                        out[f, rows] += values[of]
                continue
            tables = pattern_values(value, cover, np.arange(1 << size))
            for run, bits in neighbours(part, most):
                table = merged_table(part, tables, run, bits) if len(run) > 1 else dict(zip(part[run[0]][0].features, tables[run[0]]))
                both = Leaf(0.0, *(tuple(c[k] for c in bits) for k in range(3)), ())
                for rows, test in zip(blocks, at_most):
                    index = patterns_of(both, test, np.uint8 if len(bits) <= 8 else np.uint16).astype(np.intp)
                    for f, values in table.items():
                        out[f, rows] += values.take(index, mode="clip")
    return out.T, base


def ensemble(model: PipelineModel, spark, class_index: int = 1) -> tuple[list[list[Leaf]], list[float]]:
    """Leaves and scale of each tree of the pipeline's last stage (forest: probability of the class; boosted: margin)."""
    rows, weights, kind = tree_nodes(model.stages[-1], spark)
    trees: list[dict[int, dict]] = [{} for _ in weights]
    for r in rows:
        bound = r["leftCategoriesOrThreshold"]
        if r["leftChild"] >= 0 and r.get("numCategories", -1) != -1:
            raise ValueError("splits on categories have no interval")
        trees[int(r["treeID"])][int(r["id"])] = {**r, "threshold": bound[0] if r["leftChild"] >= 0 else None}
    if kind == "rf":
        cover = lambda n: float(sum(n["impurityStats"]))
        value = lambda n: n["impurityStats"][class_index] / sum(n["impurityStats"]) if sum(n["impurityStats"]) else 0.0
        return [leaves(t, value, cover) for t in trees], [1.0 / len(trees)] * len(trees)
    return [leaves(t, lambda n: n["prediction"], lambda n: float(n["impurityStats"][0])) for t in trees], list(weights)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined until they have so many rows: what is laid out for a batch serves more of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def tree_shap(model: PipelineModel, df: DataFrame, features: Sequence[str], id_col: str, class_index: int = 1) -> DataFrame:
    """(id, feature, attribution, share_percent, base) for each row and feature.

    ``share_percent`` is the absolute value's part of the row's total, rounded half-even to 2 digits; 0 if all are zero.
    Rows with equal or null ids are explained one by one; null features go the way the pipeline's imputer sends them.
    """
    spark = df.sparkSession
    trees = spark.sparkContext.broadcast(ensemble(model, spark, class_index))
    names = list(features)
    x = model.transform(dealt(df, anew=False)).select(F.col(id_col).alias("id"), vector_to_array("features").alias("x"))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, TASK_ROWS):
            own = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            values, base = shapley(*trees.value, own)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists, pa.array(np.full(len(own), base))], ["id", "v", "base"])

    schema = T.StructType([T.StructField("id", x.schema["id"].dataType), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("base", T.DoubleType())])
    total = F.aggregate("v", F.lit(0.0), lambda a, v: a + F.abs(v))
    rows = x.mapInArrow(explain, schema).withColumn("total", total)
    rows = rows.select("id", "base", "total", F.posexplode("v").alias("k", "attribution"))
    share = F.when(F.col("total") <= 0, F.lit(0.0)).otherwise(F.bround(F.abs("attribution") / F.col("total") * 100.0, 2))
    return rows.select(F.col("id").alias(id_col), F.array(*map(F.lit, names))[F.col("k")].alias("feature"), "attribution", share.alias("share_percent"), "base")
