"""op12 against numpy's eigenvalues and whole-number sums; counts against eigenvalues; hostile tables."""

import numpy as np
import pytest

from riskops.llm import whitening as W

FIELDS = "vec_id long, embedding array<double>, x string, n string"


def table(spark, tmp_path, rows):
    path = str(tmp_path / "vectors")
    spark.createDataFrame([(i, v, "x", "n") for i, v in rows], FIELDS).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_inertia_counts_and_solves():
    r = np.random.default_rng(1)
    for _ in range(200):
        n = int(r.integers(1, 25))
        a = r.integers(-2, 3, (int(r.integers(1, 25)), n)).astype(float)
        shifted = a.T @ a - r.normal() * 5 * np.eye(n)
        steps, below = W.factor(shifted)
        assert below == (np.linalg.eigvalsh(shifted) < 0).sum()
        b = r.normal(size=n)
        assert np.allclose(shifted @ W.solve(steps, b), b, atol=1e-6)


@pytest.mark.parametrize("values", [
    [9, 7, 5, 4, 3, 2, 1, 0.5, 0.1], [5, 5, 5, 4, 3, 3, 2, 1, 1], [1] * 9, [3, 0, 0, 0, 0, 0, 0, 0, 0], [0] * 9,
    [10, 10 - 1e-9, 10 - 2e-9, 9, 1, 1, 1, 1, 1], [1, 1 - 1e-13, 1 - 3e-13, 0.5, 0.4, 0.3, 0.2, 0.1, 0.1], [1, 1e-3, 1e-6, 1e-9, 1e-12, 0, 0, 0, 0],
])
def test_leading_pairs(values):
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(9, 9)))[0]
    v = q @ np.diag(values).astype(float) @ q.T
    v = (v + v.T) / 2
    e, x = W.Spectrum(v).leading(8)
    top = max(max(values), 1e-300)
    many = min(8, sum(u > 1e-13 * top for u in values))
    assert len(e) == many and np.all(np.diff(e) <= 1e-12 * top)
    assert np.allclose(e, np.sort(values)[::-1][:many], atol=1e-13 * top)
    assert np.allclose(x @ x.T, np.eye(many), atol=1e-9) and np.allclose(v @ x.T, x.T * e, atol=1e-11 * top)


def by_hand(rows, many=8):
    kept = [(i, np.floor(1024 * np.array(v, float)).astype(int) + 100000) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    many = int((e[:many] > 1e-9).sum())
    white = z @ u[:, :many] / np.sqrt(e[:many])
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), white, e[:many] / e.sum()


def test_whitened_rows_equal_numpy(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(int(i), list(map(float, v))) for i, v in enumerate(r.normal(size=(300, 12)) * np.linspace(0.1, 1, 12))]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, None), (901, []), (902, [0.1] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [0.5, 0.5])]
    ids, n, deviation, white, explained = by_hand([x for x in rows if x[0] != 905])
    out = W.whiten(table(spark, tmp_path, rows)).toPandas()
    assert len(out) == len(ids) * 8 and set(out.n) == {n} and out.identity_error.max() < 1e-10 and out.identity_error.nunique() == 1
    got = {}
    for g in out.itertuples():
        got.setdefault((None if g.vec_id != g.vec_id else int(g.vec_id), g.component), []).append((g.deviation, g.whitened, g.explained))
    flip = {}
    for k in range(8):
        for i, d, w in zip(ids, deviation, white[:, k]):
            for a, b, c in got[(i, k + 1)]:
                flip.setdefault(k, np.sign(b * w))
                assert a == d and abs(b * flip[k] - w) < 1e-9 and abs(c - explained[k]) < 1e-12


def test_wide_values_and_dealing_do_not_matter(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(int(i), list(map(float, v))) for i, v in enumerate(r.normal(size=(200, 5)) * 1e6)]
    t = table(spark, tmp_path, rows)
    one, two = (W.fit(x.select("vec_id", W.grid("embedding").alias("x"))) for x in (t.coalesce(1), t.repartition(7)))
    assert one.n == two.n == 200 and one.sums == two.sums and np.array_equal(one.values, two.values) and np.array_equal(one.vectors, two.vectors)
    huge = [(i, [c * 2.0**7 for c in v]) for i, v in rows]
    out = W.whiten(table(spark, tmp_path, huge)).toPandas()
    assert len(out) == 1000 and out.identity_error.max() < 1e-9


def test_no_variance_gives_no_rows(spark, tmp_path):
    for rows in ([], [(1, [0.5, 0.25])], [(k, [0.5, 0.25]) for k in range(5)], [(1, None)], [(1, [])]):
        out = W.whiten(table(spark, tmp_path, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    two = W.whiten(table(spark, tmp_path, [(1, [0.5, 0.0]), (2, [0.25, 0.0])])).collect()
    assert len(two) == 2 and sorted(round(r.whitened, 9) for r in two) == [-1, 1]
