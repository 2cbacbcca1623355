"""Draws of oversampling: dealt to as many tasks as they need, whatever the planner makes of the short rows before them."""

from pyspark.sql import functions as F

from riskops.operators import resample as R


def test_draws_are_laid_out_by_many_tasks(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    want = sorted(map(tuple, R.oversample(df, "id", "y").collect()))
    assert len(want) == 4000 and sum(y for _, y, _ in want) == 2000
    monkeypatch.setattr(R, "DRAW_RANGE", 50)
    monkeypatch.setattr(R, "TASK_RANGES", 8)
    got = R.oversample(df, "id", "y")
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and ", 10), REPARTITION_BY_NUM" in plan  # 4,000 draws, 400 a task


def test_one_short_class_and_null_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, y string")
    got = R.oversample(df, "id", "y").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {"a": 2, "b": 2}
    assert R.oversample(df.where("y = 'a'"), "id", "y").count() == 2
