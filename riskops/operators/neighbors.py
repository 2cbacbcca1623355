"""Exact nearest neighbours inside the minority class and SMOTE rows.

Rows with equal vectors are folded into one (with its smallest ids), so a pile of copies costs
one vector. The different vectors are dealt to cells around pivots, which are drawn from the vectors
themselves: where rows lie dense, pivots do, however dense the cloud. A first pass inside the
cells gives each vector an upper bound of the distance to its k-th neighbour. By the triangle
inequality a vector s can only serve a cell with pivot p if ``|s - p|`` is at most the cell's reach, the
greatest ``|q - p| + bound(q)`` over its vectors q; s goes to those cells only. Cells with many vectors
or many that may serve them are cut into blocks of bounded size, whose best k are merged.

Distances that decide are summed entry by entry, in order; ties go to the smaller id. Where distances do not
differ much (many dimensions without structure) the bounds cut little, and the work nears that of
comparing all blocks; results stay exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskops.functions.exprs import uniform
from riskops.operators.resample import class_rank, draws
from riskops.session import ensure_checkpoint_dir

#: Vectors of a cell, about, most pivots, and vectors of one side of a block.
CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS = 512, 4096, 8192
#: Queries that a block compares at once.
QUERY_ROWS = 256
#: What rounding may add to a bound, as a part of the vectors' size.
SLACK = 1e-9


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column, which all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(q: np.ndarray, q_id: np.ndarray, s: np.ndarray, s_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, candidate's row, squared distance) of the k nearest candidates with another id, ties to smaller ids.

    Products choose who may be among them; their distances are then summed entry by entry.
    """
    rows, others, dist = [], [], []
    s_norm = np.einsum("ij,ij->i", s, s)
    for at in range(0, len(q), QUERY_ROWS):
        own, own_id = q[at : at + QUERY_ROWS], q_id[at : at + QUERY_ROWS]
        norm = np.einsum("ij,ij->i", own, own)
        rough = norm[:, None] + s_norm[None, :] - 2 * (own @ s.T)
        rough[own_id[:, None] == s_id[None, :]] = np.inf
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(own), np.inf)
        edge = edge + SLACK * (norm + (s_norm.max() if len(s) else 0.0))
        i, j = np.nonzero((rough <= edge[:, None]) & np.isfinite(rough))
        d = np.zeros(len(i))
        for c in range(q.shape[1]):
            d += (own[i, c] - s[j, c]) ** 2
        order = np.lexsort((s_id[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        keep = place < k
        rows.append(i[keep] + at)
        others.append(j[keep])
        dist.append(d[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, others, dist))


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", v, v)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * (v @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def knn(distinct: DataFrame, k: int, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vid, other, square): the k nearest other rows of each row of ``distinct`` (vid, v), whose vectors have one length."""
    spark = distinct.sparkSession
    ensure_checkpoint_dir(spark)
    id_type = distinct.schema["vid"].dataType
    out = T.StructType([T.StructField("vid", id_type), T.StructField("other", id_type), T.StructField("square", T.DoubleType())])
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], out)
    many = min(MOST_PIVOTS, -(-n // cell_rows))
    drawn = distinct.select("v").orderBy(F.xxhash64("v"), "vid").limit(many).collect()  # at most MOST_PIVOTS rows
    pivots = spark.sparkContext.broadcast(np.array([r.v for r in drawn], float))
    size = float(np.abs(pivots.value).max(initial=0.0)) + 1.0

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = pivot_distances(vectors(b.column("v")), pivots.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "d"])

    fields = [T.StructField("vid", id_type), T.StructField("v", T.ArrayType(T.DoubleType()))]
    cells = distinct.select("vid", "v").mapInArrow(to_cells, T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())]))
    cells = cells.checkpoint()
    shape = {r.cell: (r.n, r.radius) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()}  # a row a pivot

    # upper bounds from the cell's own vectors, a bounded chunk of them at a time
    chunks = F.create_map(*[F.lit(x) for c, (m, _) in shape.items() for x in (c, -(-m // block_rows))])

    def own_bounds(key, group):
        v, vid = vectors(group.column("v")), group.column("vid").to_numpy()
        i, _, d = nearest(v, vid, v, vid, k)
        last = np.zeros(len(v))
        np.maximum.at(last, i, np.sqrt(d))
        last[np.bincount(i, minlength=len(v)) < k] = np.inf
        reach = (group.column("d").to_numpy() + last).max()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "reach": pa.array([float(reach)])})

    dealt = cells.withColumn("chunk", F.pmod(F.xxhash64("vid"), chunks[F.col("cell")]).cast("int"))
    reached = dealt.groupBy("cell", "chunk").applyInArrow(own_bounds, "cell int, reach double").groupBy("cell").agg(F.max("reach").alias("reach"))
    found = {r.cell: r.reach for r in reached.collect()}  # a row a pivot
    known = np.array(sorted(shape))
    centre, radius, held = pivots.value[known], np.array([shape[c][1] for c in known]), np.array([shape[c][0] for c in known])
    reach = np.full(many, -1.0)
    for at, c in enumerate(known):
        own = found[c]
        if not np.isfinite(own):  # too few of its own: whole cells around it that hold k others
            far = pivot_distances(centre[at : at + 1], centre)[0] + radius
            order = np.argsort(far)
            enough = np.searchsorted(np.cumsum(held[order]), k + 1)
            own = 2 * radius[at] + (far[order[enough]] if enough < len(order) else np.inf)
        reach[c] = own * (1 + SLACK) + SLACK * size

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, cell = np.nonzero(pivot_distances(vectors(b.column("v")), pivots.value) <= reach[None, :])
                yield pa.RecordBatch.from_arrays([b.column("vid").take(pa.array(row)), pa.array(cell.astype(np.int32))], ["vid", "cell"])

    serving = cells.select("vid", "v").mapInArrow(serve, T.StructType([fields[0], T.StructField("cell", T.IntegerType())]))
    # number of queries' and candidates' parts of each cell, and the number of its first block
    asked = {r.cell: r["count"] for r in serving.groupBy("cell").count().collect()}  # a row a pivot
    parts, first = [], 0
    for c in known.tolist():
        a, b = -(-shape[c][0] // block_rows), -(-asked.get(c, 1) // block_rows)
        parts.append((c, a, b, first))
        first += a * b
    plan = F.broadcast(spark.createDataFrame(parts, "cell int, a int, b int, first long"))  # a row a pivot
    part = lambda of: F.pmod(F.xxhash64("vid"), F.col(of))
    queries = cells.select("vid", "v", "cell").join(plan, "cell")
    at = F.col("first") + part("a") * F.col("b")
    queries = queries.select("vid", "v", F.explode(F.sequence(at, at + F.col("b") - 1)).alias("block"))
    at = F.col("first") + part("b")
    candidates = serving.join(plan, "cell").select("vid", F.explode(F.sequence(at, at + F.col("b") * (F.col("a") - 1), F.col("b").cast("long"))).alias("block"))
    candidates = candidates.join(cells.select("vid", "v"), "vid").select("vid", "v", "block")

    def compare(left, right):
        q_id, s_id = left.column("vid").to_numpy(), right.column("vid").to_numpy()
        if not len(q_id) or not len(s_id):
            return pa.table({"vid": left.column("vid").slice(0, 0), "other": left.column("vid").slice(0, 0), "square": pa.array([], pa.float64())})
        i, j, d = nearest(vectors(left.column("v")), q_id, vectors(right.column("v")), s_id, k)
        return pa.table({"vid": left.column("vid").take(pa.array(i)), "other": right.column("vid").take(pa.array(j)), "square": pa.array(d)})

    best = queries.groupBy("block").cogroup(candidates.groupBy("block")).applyInArrow(compare, out)
    w = Window.partitionBy("vid").orderBy("square", "other")
    return best.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def whole_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is not null, holds only finite entries and has the most frequent length (ties: the longest)."""
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))
    m = df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(id_col, v.alias("v"))
    lengths = sorted((r["count"], r.d) for r in m.groupBy(F.size("v").alias("d")).count().collect())  # a row a length
    return m.where(F.size("v") == (lengths[-1][1] if lengths else 0))


def smote_neighbors(df: DataFrame, id_col: str, vec_col: str, label_col: str, minority=1, k: int = 5,
                    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbor_id, rank, distance): the k nearest minority rows of each minority row (all others, if fewer), ties to smaller ids.

    Rows whose id or vector is null, or whose vector holds null or non-finite entries or has another length than most, take no part.
    """
    m = whole_vectors(df.where(F.col(label_col) == F.lit(minority)), id_col, vec_col)
    # one row for each different vector, named by its least id; of its rows only the k + 1 least ids can be anyone's neighbours
    w = Window.partitionBy("v").orderBy(id_col)
    few = m.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    ensure_checkpoint_dir(df.sparkSession)
    piles = few.groupBy("v").agg(F.sort_array(F.collect_list(id_col)).alias("ids")).withColumn("vid", F.col("ids")[0]).checkpoint()
    near = knn(piles.select("vid", "v"), k, cell_rows, block_rows)
    others = near.join(piles.select(F.col("vid").alias("other"), "ids"), "other").select("vid", "square", F.explode("ids").alias("nid"))
    rows = others.union(piles.select("vid", F.lit(0.0).alias("square"), F.explode("ids").alias("nid")))
    top = F.slice(F.sort_array(F.collect_list(F.struct("square", "nid"))), 1, k + 1)  # at most (k + 1) ** 2 of a vector
    lists = rows.groupBy("vid").agg(top.alias("near")).join(piles.select("vid", "v"), "vid")
    own = m.join(lists, "v").select(id_col, F.slice(F.filter("near", lambda r: r.nid != F.col(id_col)), 1, k).alias("near"))
    own = own.select(id_col, F.posexplode("near").alias("rank", "n"))
    return own.select(id_col, F.col("n.nid").alias("neighbor_id"), (F.col("rank") + 1).alias("rank"), F.sqrt("n.square").alias("distance"))


def smote_rows(df: DataFrame, neighbors: DataFrame, id_col: str, vec_col: str, label_col: str, minority=1,
               n_new: int | None = None, seed: str = "smote") -> DataFrame:
    """``n_new`` synthetic minority rows ``x + g * (x_nn - x)``; without it, as many as the largest class has more.

    Draw j takes a row by u(seed, j) with replacement, one of its neighbours by u(seed:nn, j) and the
    gap g by u(seed:gap, j). Rows without neighbours are not drawn.
    """
    if n_new is None:
        sizes = df.where(F.col(label_col).isNotNull()).groupBy(label_col).count()
        n_new = sizes.agg((F.max("count") - F.coalesce(F.max(F.when(F.col(label_col) == F.lit(minority), F.col("count"))), F.lit(0))).alias("n")).first().n or 0
    own = whole_vectors(df.where(F.col(label_col) == F.lit(minority)), id_col, vec_col)
    degree = neighbors.groupBy(id_col).agg(F.max("rank").alias("degree"))
    ranked = class_rank(own.join(degree, id_col).withColumn("_class", F.lit(1)), id_col, "_class", seed)
    n = own.join(degree, id_col).count()
    out = T.StructType([T.StructField("draw", T.LongType()), df.schema[id_col], T.StructField(vec_col, T.ArrayType(T.DoubleType())), df.schema[label_col]])
    if not n or n_new <= 0:
        return df.sparkSession.createDataFrame([], out)
    drawn = draws(df.sparkSession, int(n_new)).withColumn("class_rank", F.floor(uniform(seed, "draw") * F.lit(n)))
    x = drawn.join(ranked, "class_rank").select("draw", id_col, "v", (F.floor(uniform(seed + ":nn", "draw") * F.col("degree")) + 1).cast("int").alias("rank"), uniform(seed + ":gap", "draw").alias("g"))
    x = x.join(neighbors.select(id_col, "rank", "neighbor_id"), [id_col, "rank"])
    x = x.join(own.select(F.col(id_col).alias("neighbor_id"), F.col("v").alias("vn")), "neighbor_id")
    new = F.zip_with("v", "vn", lambda p, q: p + F.col("g") * (q - p))
    return x.select("draw", id_col, new.alias(vec_col), F.lit(minority).cast(df.schema[label_col].dataType).alias(label_col))
