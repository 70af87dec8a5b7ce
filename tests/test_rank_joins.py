"""Rank correlation: one join of rows for all features, against plain ranks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinscout.operators import stats


def ranks(v):
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2


def test_spearman_joins_rows_once(spark):
    draw = random.Random(4)
    some = lambda v: None if draw.random() < 0.2 else v
    rows = [(some(draw.gauss(0, 1)), some(float(draw.randrange(3))), some(draw.gauss(0, 1) * 1e6), 7.0, None, some(float("nan") if draw.random() < 0.1 else float(draw.randrange(40)))) for _ in range(900)]
    names = ["a", "b", "c", "same", "none"]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, none double, y double").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stats.spearman(df, names, "y")
        assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1
        got = {r.feature: (r.correlation, r.n) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got) == {"a", "b", "c", "same"}
    for i, name in enumerate(names[:3]):
        both = np.array([(r[i], r[5]) for r in rows if r[i] is not None and r[5] is not None and r[5] == r[5]])
        assert got[name][0] == pytest.approx(np.corrcoef(ranks(both[:, 0]), ranks(both[:, 1]))[0, 1], abs=1e-9) and got[name][1] == len(both)
    assert got["same"][0] == 0.0


def test_a_constant_has_no_correlation_on_many_rows(spark):
    df = spark.range(700_000).select(F.lit(3.0).alias("same"), (F.col("id") % 1000).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    got = {r.feature: r.correlation for r in stats.spearman(df, ["same", "x"], "y").collect()}
    assert got["same"] == 0.0 and 0 < got["x"] < 0.01
    assert {r.correlation for r in stats.spearman(df, ["y", "x"], "same").collect()} == {0.0}
