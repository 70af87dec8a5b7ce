import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from joinscout.operators import joins

L, R = "k long, a long", "k long, x long"


def asof(spark, left, right, **kw):
    l = spark.createDataFrame(left, "rid long, t long")
    r = spark.createDataFrame(right, "seq long, u long, x long")
    out = joins.asof_join(l, r, "t", "u", order="seq", **kw)
    return [row.x for row in out.orderBy("rid").collect()]


def test_backward_within_tolerance_keeps_null_keys_and_order(spark):
    left = [(0, 3), (1, 1), (2, None), (3, 2)]
    assert asof(spark, left, [(0, 2, 200), (1, 4, 400)], tolerance=2, direction="backward") == [200, None, None, 200]


def test_nearest_may_use_the_future_and_prefers_the_past_on_ties(spark):
    assert asof(spark, [(0, 1)], [(0, 2, 200)], tolerance=2) == [200]
    assert asof(spark, [(0, 3)], [(0, 2, 2), (1, 4, 4)]) == [2]


def test_empty_right_gives_nulls(spark):
    assert asof(spark, [(0, 1), (1, None)], [], tolerance=2) == [None, None]
    assert asof(spark, [], [(0, 1, 1)]) == []


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 0, 3])
def test_asof_against_pandas(spark, direction, tolerance):
    rng = np.random.default_rng(len(direction) + (tolerance or 7))
    left = pd.DataFrame({"rid": range(60), "t": rng.integers(0, 80, 60)})
    right = pd.DataFrame({"seq": range(40), "u": np.sort(rng.integers(0, 80, 40))})
    right["x"] = right.seq + 100
    want = pd.merge_asof(left.sort_values("t", kind="stable"), right, left_on="t", right_on="u", direction=direction, tolerance=tolerance).sort_values("rid").x
    got = asof(spark, left.values.tolist(), right.values.tolist(), direction=direction, tolerance=tolerance)
    assert got == [None if np.isnan(v) else int(v) for v in want]


def test_first_per_key_drops_null_keys_and_takes_the_first(spark):
    r = spark.createDataFrame([(1, 3), (1, 2), (None, 1), (2, 9)], R)
    assert sorted(map(tuple, joins.first_per_key(r, ["k"], ["x"]).collect())) == [(1, 2), (2, 9)]


def test_exact_join_needs_equal_types(spark):
    l, r = spark.createDataFrame([(1, 2)], L), spark.createDataFrame([(1.0, 5)], "k2 double, x long")
    assert joins.exact_left_join(l, r, "k", "k2") is None


def test_exact_join_never_multiplies_reduced_rows(spark):
    l = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], L)
    r = spark.createDataFrame([(1, 5), (1, 4)], "j long, x long")
    out = joins.exact_left_join(l, r, "k", "j", ["x"]).orderBy("a").collect()
    assert [(x.a, x.x) for x in out] == [(1, 4), (2, 4), (3, None)]


def test_null_safe_join_meets_nulls(spark):
    l, r = spark.createDataFrame([(None, 1), (2, 2)], L), spark.createDataFrame([(None, 7)], R)
    assert sorted((x.a, x.x) for x in joins.left_join_on(l, r, ["k"], null_safe=True).collect()) == [(1, 7), (2, None)]


def test_quality_and_diagnostics(spark):
    base = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], L)
    joined = joins.exact_left_join(base, spark.createDataFrame([(1, 5)], "j long, x long"), "k", "j")
    assert not joins.passes_quality(joined, "j", 0.65) and joins.passes_quality(joined, "j", 0.3)
    d = joins.join_diagnostics(base, joined).first()
    assert (d.n_added, d.n_all_null, round(d.mean_missing, 6)) == (2, 0, 0.666667)


def test_asof_by_entity(spark):
    l = spark.createDataFrame([("a", 5, 0), ("b", 5, 1)], "e string, t long, rid long")
    r = spark.createDataFrame([("a", 4, 1), ("b", 9, 2)], "e string, u long, x long")
    out = joins.asof_join(l, r, "t", "u", by=["e"], direction="backward", order="x").orderBy("rid").select("x").collect()
    assert [x.x for x in out] == [1, None]


def test_fold_joins_prefixes(spark):
    base = spark.createDataFrame([(1, 1)], L)
    out = joins.fold_joins(base, {"t": spark.createDataFrame([(1, 5)], R)}, "k").first()
    assert out["t__x"] == 5
    assert F is not None
