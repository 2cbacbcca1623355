"""neighbours equal brute force, also on dense piles, copies and odd rows; SMOTE rows lie between neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TINY
from riskops.operators import neighbors as NB
from riskops.sources import adapters as A

SCHEMA = "id long, v array<double>, y int"


def table(spark, tmp_path, rows):
    path = str(tmp_path / "rows")
    rows = [(None if i is None else int(i), v and [None if c is None else float(c) for c in v], y) for i, v, y in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def brute(rows, k):
    """Differences summed entry by entry, ties to smaller ids."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for at, i in enumerate(ids):
        d = np.zeros(len(ids))
        for c in range(x.shape[1]):
            d += (x[at, c] - x[:, c]) ** 2
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(np.sqrt(d[j]))) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.neighbor_id, r.distance))
    return out


def spread_and_cloud(r):
    cloud = [(1000 + i, list(0.5 + 1e-4 * r.normal(size=6))) for i in range(600)]
    return [(i, list(r.normal(size=6))) for i in range(200)] + cloud


CASES = {
    "spread and a dense cloud of different vectors": spread_and_cloud,
    "a third of the rows are one vector": lambda r: [(i, [0.25] * 4 if i % 3 == 0 else list(r.normal(size=4))) for i in range(300)],
    "whole numbers, many ties": lambda r: [(int(i), list(map(float, r.integers(0, 4, 3)))) for i in r.permutation(400)],
    "one dimension": lambda r: [(i, [float(r.normal())]) for i in range(150)],
    "far from zero": lambda r: [(i, list(1e6 + r.normal(size=3))) for i in range(200)],
    "fewer than k": lambda r: [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 1.0])],
    "all equal": lambda r: [(i, [1.0, 2.0]) for i in range(40)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("cells,block", [(16, 32), (NB.CELL_ROWS, NB.BLOCK_ROWS)])
def test_neighbours_equal_brute_force(spark, tmp_path, case, cells, block):
    rows = CASES[case](np.random.default_rng(3))
    t = table(spark, tmp_path, [(i, v, 1) for i, v in rows] + [(10_000 + i, [0.0] * len(rows[0][1]), 0) for i in range(9)])
    got = found(NB.smote_neighbors(t, "id", "v", "y", 1, k=5, cell_rows=cells, block_rows=block))
    assert got == {i: n for i, n in brute(rows, 5).items() if n}


def test_bounds_leave_far_cells_out(spark, tmp_path, monkeypatch):
    """Ten clusters: blocks compare far fewer pairs than all."""
    r = np.random.default_rng(5)
    rows = [(i, list(100.0 * (i % 10) + r.normal(size=3))) for i in range(1000)]
    t = table(spark, tmp_path, [(i, v, 1) for i, v in rows])
    seen = spark.sparkContext.accumulator(0)
    plain = NB.nearest

    def counted(q, q_id, s, s_id, k):
        seen.add(len(q) * len(s))
        return plain(q, q_id, s, s_id, k)

    monkeypatch.setattr(NB, "nearest", counted)
    near = NB.smote_neighbors(t, "id", "v", "y", 1, k=5, cell_rows=25)
    assert near.count() == 5000
    assert seen.value < 0.45 * 1000 * 1000


def test_rows_that_take_no_part(spark, tmp_path):
    rows = [(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
            (7, [1.0], 1), (8, [], 1), (None, [0.5, 0.0], 1), (9, [0.0, 0.1], None), (10, [0.0, 0.2], 0)]
    assert found(NB.smote_neighbors(table(spark, tmp_path, rows), "id", "v", "y")) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    for few in ([], rows[:1], rows[9:]):
        t = table(spark, tmp_path, few)
        near = NB.smote_neighbors(t, "id", "v", "y")
        assert near.collect() == [] and NB.smote_rows(t, near, "id", "v", "y").collect() == []


def test_smote_rows_lie_between_neighbours(spark):
    v = A.vectors(spark, TINY)
    nb = NB.smote_neighbors(v, "row_id", "embedding", "y", 1, k=5)
    s = NB.smote_rows(v, nb, "row_id", "embedding", "y", 1).collect()
    assert len(s) == v.where("y = 0").count() - v.where("y = 1").count()
    x = {r.row_id: np.array(r.embedding, float) for r in v.where("y = 1").collect()}
    near = {}
    for r in nb.collect():
        near.setdefault(r.row_id, []).append(r.neighbor_id)
    for r in s:
        new = np.array(r.embedding)
        off = [np.linalg.norm(new - x[r.row_id]) + np.linalg.norm(new - x[n]) - np.linalg.norm(x[n] - x[r.row_id]) for n in near[r.row_id]]
        assert min(off) < 1e-9 and r.y == 1
    assert len(NB.smote_rows(v, nb, "row_id", "embedding", "y", 1, n_new=7).select("draw").distinct().where(F.col("draw") < 7).collect()) == 7
