import math

import numpy as np
import pandas as pd

from joinscout.operators import selection, stats


def test_relevance_ties_go_by_name(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 4), (4, 4, 3)], "b long, a long, y long")
    assert [(r.feature, round(r.score, 6)) for r in stats.relevance(df, ["b", "a"], "y").collect()] == [("a", 0.8), ("b", 0.8)]


def test_spearman_matches_pandas_with_ties_and_nulls(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"a": rng.integers(0, 9, 80).astype(float), "b": rng.normal(size=80), "y": rng.integers(0, 5, 80).astype(float)})
    p.loc[::7, "a"] = np.nan
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in p.itertuples(index=False)], "a double, b double, y double")
    got = {r.feature: r.correlation for r in stats.spearman(df, ["a", "b"], "y").collect()}
    for c in ("a", "b"):
        q = p[[c, "y"]].dropna().rank()
        assert abs(got[c] - np.corrcoef(q[c], q.y)[0, 1]) < 1e-9


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, y double")
    assert stats.pearson(df, ["a"], "y").first().correlation == 0
    assert stats.relevance(df, ["a"], "y").collect() == []


def test_bins_and_entropy(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(10)], "x double, y double")
    assert [r.x for r in stats.bin_uniform(df, ["x"]).collect()] == [min(int(i / 9 * 5), 4) for i in range(10)]
    mi = stats.mutual_information(df, ["x"], "y").first()
    assert abs(mi.mi - math.log(2)) < 1e-9 and abs(mi.h_conditional) < 1e-9


def test_redundancy_refuses_a_single_candidate_with_parity(spark):
    df = spark.createDataFrame([(float(i), float(i * 7 % 5), float(i % 3)) for i in range(30)], "a double, b double, y double")
    assert stats.redundancy(df, ["a"], ["b"], "y").collect() == []
    assert len(stats.redundancy(df, ["a"], ["b"], "y", parity=False).collect()) == 1


def test_path_score():
    assert stats.path_score([0.5, 0.7], [0.2]) == 0.6 + 0.2
    assert stats.path_score([], [1.0]) is None and stats.path_score([0.5], []) is None and stats.path_score([0.5], None) == 0.5


def test_noise_counts():
    assert selection.before_noise([2, 4, 1, 3], [False, False, True, True], 2) == [0, 1]
    assert selection.before_noise([1, 2, 3, 4], [False, False, True, True], 2) == [0, 0]
    assert selection.stable_features([[1, 1]], 0) == [0, 1]
    assert selection.stable_features([[1, 0], [0, 0]], 0.5) == [] and selection.stable_features([[1, 0], [0, 0]], 0.49) == [0]
    assert selection.stable_features([], 0) == []


def test_noise_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert len(selection.inject_noise(df, ["a", "b"], 0.0)[1]) == 0
    out, names = selection.inject_noise(df, ["a", "b"], 1.5)
    assert len(names) == 3 and len(out.columns) == 5


def test_selection_blocks_and_falls_back(spark):
    df = spark.createDataFrame([(i, (i * 13) % 7, i) for i in range(20)], "user_id long, load long, y long")
    s = selection.select_features(df, "y", 5)
    assert s.features == ["load"] and s.blocked == ["user_id"]
    only = selection.select_features(df.select("user_id", "y"), "y", 5)
    assert only.features == ["user_id"]
