"""the scores' histogram is grouped once, then read for the ranges, their sums and the rows."""

from riskops.operators import evaluate as E


def test_histogram_is_read_not_grouped_again(spark, monkeypatch):
    rows = [(g, i % 7 / 7, int(i % 3 == 0)) for g in "ab" for i in range(60)]
    d = spark.createDataFrame([*rows, ("c", 0.5, 1), ("a", None, 1), (None, 0.2, 0), (None, 0.4, 1)], "g string, p double, y int")
    plans, plain = [], E.cumulative

    def seen(h, *args, **kw):
        plans.append(h._jdf.queryExecution().optimizedPlan().toString())
        return plain(h, *args, **kw)

    monkeypatch.setattr(E, "cumulative", seen)
    got = {r.g: (r.n_pos, r.n_neg, r.roc_auc) for r in E.roc_auc(d, "p", "y", ["g"]).collect()}
    assert plans and "Aggregate" not in plans[0]

    def auc(part):
        pos, neg = [p for _, p, y in part if y], [p for _, p, y in part if not y]
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))

    want = auc([r for r in rows if r[0] == "a"])
    assert got["a"][:2] == got["b"][:2] == (20, 40) and abs(got["a"][2] - want) < 1e-12 and got["c"][2] is None
