"""Exact percentiles without a task that holds a column."""

from pyspark.sql import functions as F

from joinscout.operators import profile


def test_exact_percentiles(spark):
    rows = [(float(i * 37 % 1009), None if i % 3 else float(i % 7), None) for i in range(3000)] + [(float("nan"), -0.0, None), (None, 0.0, None), (1e300, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = {r.column: r for r in profile.numeric_profile(df, ["a", "b", "c"], exact=True).collect()}
    for c in "abc":
        want = df.agg(*[F.percentile(c, p / 100) for p in (50, 95, 99)]).first()
        assert (got[c].p50, got[c].p95, got[c].p99) == tuple(want)
    one = profile.numeric_profile(df.limit(1).select(F.lit(4.0).alias("a")), ["a"], exact=True).first()
    assert (one.p50, one.p99) == (4.0, 4.0)
    assert profile.numeric_profile(df.limit(0), ["a"], exact=True).first().p50 is None


def test_no_aggregate_of_all_values(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"))
    plan = profile.numeric_profile(df, ["a"], exact=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
