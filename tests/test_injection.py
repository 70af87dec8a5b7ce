"""Random injection and the budget join at size: all rounds, rows written once, forests without an object a row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from joinscout.operators import forests, selection

SMALL = "/root/testdata/sf0.001"


def table(spark, n=3000):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    rows = spark.range(n).select(*[u(k).alias(f"x{k}") for k in range(4)])
    return rows.select("*", (5 * F.col("x1") + F.col("x3")).alias("y"), (F.col("x2") > 0.4).cast("double").alias("c"))


def test_budget_join_keeps_no_rows_but_files(spark, monkeypatch):
    def kept(*_):
        raise AssertionError("rows are kept in memory and on local disk")

    for how in ("persist", "cache"):
        monkeypatch.setattr(type(spark.range(1)), how, kept)
    monkeypatch.setattr(forests, "PIECE", 0)  # as if the rows were many
    found = [r.feature for r in __spark_entry__.queries()["budget_join"](spark, SMALL).collect()]
    assert "lineitem__l_quantity" in found


def test_random_injection_is_decided_by_ten_rounds(spark, monkeypatch):
    seen, decide = [], selection.stable_features
    monkeypatch.setattr(selection, "stable_features", lambda votes, threshold: seen.append(votes) or decide(votes, threshold))
    found = [r.feature for r in __spark_entry__.queries()["random_injection"](spark, SMALL).collect()]
    (votes,) = seen
    assert len(votes) == 10 and all(len(v) == 4 for v in votes)  # a part of one round is all or nothing
    assert [i for i in range(4) if sum(v[i] for v in votes) > 1] == [["l_quantity", "l_discount", "l_tax", "l_linenumber"].index(f) for f in found]


@pytest.mark.parametrize("regression", [True, False])
def test_forests_agree_by_level_and_by_tree(spark, monkeypatch, regression):
    df, xs, y = table(spark), ["x0", "x1", "x2", "x3"], "y" if regression else "c"

    def found(piece, rows):
        monkeypatch.setattr(forests, "PIECE", piece)
        counted, few = forests.condensed(rows, xs, y, 4)
        assert few == bool(piece)
        return forests.importances(counted, few, y, [xs, xs[:3]], [1, 2], regression)

    by_tree, by_level = found(10**9, df), found(0, df)
    for a, b in zip(by_tree, by_level, strict=True):
        assert abs(sum(a.values()) - 1) < 1e-9 and abs(sum(b.values()) - 1) < 1e-9
        assert all(abs(a[c] - b[c]) < 0.05 for c in a)  # other draws of the rows
        best = "x1" if regression else "x2"
        assert max(a, key=a.get) == best and a[best] > 0.6
    assert found(10**9, df.repartition(7)) == by_tree


def test_a_tree_is_that_of_all_pairs(spark):
    """The cut of a root against every cut of every feature, by squares about the mean."""
    rng = np.random.default_rng(3)
    bins, y, n = rng.integers(0, 6, (400, 3)).astype(np.int8), rng.integers(-50, 50, 400), rng.poisson(1, 400)
    tree = forests.Tree(1, 0, 3, 3)
    sums = tree.sums(bins.ravel(), np.arange(400) * 3, np.arange(3), n, [y])
    ((_, j, b, gain),) = forests.best_cuts(sums, True)
    square = lambda m: float((n[m] * (y[m] - np.average(y[m], weights=n[m])) ** 2).sum())
    gains = {(f, k): square(n >= 0) - square(bins[:, f] <= k) - square(bins[:, f] > k) for f in range(3) for k in range(5)}
    assert max(gains, key=gains.get) == (tree.tried[0, j], b) and abs(max(gains.values()) - gain) < 1e-6


def test_values_and_draws():
    assert list(forests.cut_points(np.repeat([1.0, 2.0, 3.0], 341))[0]) == [1, 2, 3]
    cuts, median = forests.cut_points(list(range(1, 1024)))
    assert len(cuts) == 31 and median == 512 and list(forests.binned(np.array([0.0, 32.0, 33.0, 2000.0, np.nan]), cuts, median)) == [0, 0, 1, 31, 15]
    drawn = np.concatenate([forests._drawn(np.arange(100_000), 5, t) for t in range(4)])
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02
    quantiles = forests.weighted_quantiles(np.array([2.0, 1.0, np.nan]), np.array([1, 3, 9]))
    assert (quantiles == np.repeat([1.0, 2.0], [768, 255])).all()


def test_rows_of_no_target_and_no_value(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, None, None), (None, None, 3.0), (float("nan"), None, 4.0)], "a double, e double, y double")
    for piece in (forests.PIECE, 0):
        counted, few = forests.condensed(df, ["a", "e"], "y", 2) if piece else (df.where("y is not null").withColumn("a", F.nanvl("a", F.lit(None).cast("double"))), False)
        assert counted.count() <= 3
        assert forests.importances(counted, few, "y", [["a", "e"]], [1])[0] == {"a": 0.0, "e": 0.0}  # missing values are the median, so all are equal
    assert selection.random_injection(df, [], "y") == [] and selection.random_injection(df, ["a"], "y", rounds=0) == []


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("label", [-1.0, 0.5])
def test_labels_that_are_no_classes_are_refused(spark, few, label):
    rows = spark.createDataFrame([(1.0, 0.0, 1), (2.0, label, 1)], "a double, y double, __n long")
    with pytest.raises(ValueError, match="labels"):
        forests.importances(rows, few, "y", [["a"]], [1], regression=False)
