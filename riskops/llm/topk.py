"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are sparse rows of (term, weight). Candidates are dealt to blocks by a hash of their
id, queries to blocks of bounded size; each pair of blocks is one group: the candidates
become postings by term, each query's terms scatter their weighted postings into a dense row
of scores, a partition selects the k best, and a per-query merge takes the best of the blocks.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part;
nor do rows with a null id; rows that repeat both id and vector count once; a query never
meets rows with its own id; vectors of unequal length share their leading terms; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
Scores beyond 64 bits are held at the ends of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, SCALE = 5, 256
#: Vectors of a block.
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 1024


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and weights: floor(scale * component) as whole doubles, of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        rows.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & good.eqNullSafe(True))
        .select("vec_id", F.transform("x", lambda v: v * scale - F.pmod(v * scale, F.lit(1.0))).alias("weights"))
    )


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, best first, ties to the smaller id; ids are sorted."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.append(above, np.flatnonzero(scores == least)[: k - len(above)])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))]


def block_scores(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one block for each query of one block."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids = rows["vec_id"].to_numpy()
    terms = int(max(map(len, rows["weights"]), default=0))
    dense = np.zeros((terms, len(rows)))
    for i, w in enumerate(rows["weights"]):
        dense[: len(w), i] = w
    longest = max([terms, *map(len, queries["weights"])])
    peak = max([np.abs(dense).max(initial=0), *(np.abs(w).max(initial=0) for w in queries["weights"])])
    kind = np.int64 if peak * peak * max(longest, 1) < 2**62 and peak < 2**53 else object
    as_kind = (lambda w: w.astype(np.int64)) if kind is np.int64 else (lambda w: np.array([int(v) for v in w], object))
    postings = []
    for t in range(terms):
        at = np.flatnonzero(dense[t])
        postings.append((slice(None) if len(at) == len(rows) else at, as_kind(dense[t, at])))
    out: list[tuple[int, int, int]] = []
    for query, w in zip(queries["vec_id"], queries["weights"]):
        scores = np.zeros(len(rows), kind)
        for t in np.flatnonzero(w[:terms]):
            at, weights = postings[t]
            scores[at] += int(w[t]) * weights
        if kind is object:
            scores = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores], np.int64)
        a, b = np.searchsorted(ids, [query, query + 1])
        others, own = np.delete(scores, slice(a, b)), np.delete(ids, slice(a, b))
        out += [(query, int(own[i]), int(others[i])) for i in best(others, own, k)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best vectors of each query, its own id aside."""
    vectors = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "weights").distinct(), "vectors")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "weights").distinct()
    queries = written(queries, "queries")
    n_rows = max(1, -(-vectors.count() // CANDIDATE_BLOCK))
    n_queries = max(1, -(-queries.count() // QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        """Each block of ``df`` beside every block of the other side: blocks meet, not rows."""
        own_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(own)
        return df.select("vec_id", "weights", own_block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def pair(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return block_scores(q, r, k)

    left = dealt(queries, "qb", n_queries, "cb", n_rows).groupBy("qb", "cb")
    right = dealt(vectors, "cb", n_rows, "qb", n_queries).groupBy("qb", "cb")
    found = left.cogroup(right).applyInPandas(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
