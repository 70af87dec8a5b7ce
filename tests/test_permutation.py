"""Permutation importance at size: one shuffle for all features, each row predicted once."""

from __future__ import annotations

from pyspark.sql import functions as F

from joinscout.operators import models


def test_permuted_rows_take_one_shuffle_and_no_join(spark, monkeypatch):
    monkeypatch.setattr(models, "PERMUTED", 300)
    df = spark.range(1000).select((F.col("id") % 7).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("y"), F.col("id").cast("double").alias("t"))
    out = models.permuted(df, ["x", "y"], "t")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == 3000
    whole = sorted((r.x, r.y, r.t) for r in df.where("y is not null").collect())
    assert sorted((r[1], r[2], r[3]) for r in rows if r[0] is None and r[2] is not None) == whole
    moved = [r for r in rows if r[0] == "y"]
    assert sorted(r[2] for r in moved if r[2] is not None) == sorted(r[1] for r in whole) and sum(r[2] is None for r in moved) == 200  # null moves like a value
    assert sum(r[2] == 2 * r[3] for r in moved) < 100 and {(r[1], r[3]) for r in moved} == {(float(i % 7), float(i)) for i in range(1000)}


def test_metrics_predict_once(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, float("nan")), (float("inf"), 1.0), (2.0, 3.0), (4.0, 4.0)], "y double, p double")
    guess = F.udf(lambda v: v, "double")
    out = models.regression_metrics(df.select("y", guess("p").alias("prediction")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("<lambda>(") for line in plan.splitlines()) == 1
    r = out.first()
    assert (r.n, r.mae, r.rmse, r.mape, r.r2) == (2, 0.5, 0.5**0.5, 0.25, 0.5)
    by = models.regression_metrics(df.withColumnRenamed("p", "prediction").withColumn("g", F.col("y") > 1), by=("g",)).collect()
    assert [(x.g, x.n) for x in by] == [(True, 2)]  # a group without a usable row gives none
    assert models.regression_metrics(df.withColumnRenamed("p", "prediction").where("y is null")).first().n == 0
