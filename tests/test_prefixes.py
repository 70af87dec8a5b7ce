"""Joins of path prefixes are made once, whoever asks for them; and helpers on the driver that no table decides."""

import pytest

from joinscout.api import AugmentationConfig, ablation, augment_features, sweep
from joinscout.functions import columns, policy, scalars
from joinscout.plans import graph, paths, search


@pytest.fixture(scope="module")
def lk(spark):
    base = spark.createDataFrame([(i, i % 20, i % 7, float((i % 20) ** 2 + 3 * (i % 7))) for i in range(300)], "id long, a long, b long, y double")
    one = spark.createDataFrame([(k, float(k * k), k % 5) for k in range(20)], "a long, size double, c long")
    two = spark.createDataFrame([(k, float(3 * k)) for k in range(7)], "b long, weight double")
    three = spark.createDataFrame([(k, float(k)) for k in range(3)], "c long, far double")
    links = [("base", "one", "a", "a", 1.0), ("base", "two", "b", "b", 1.0), ("one", "three", "c", "c", 1.0)]
    return search.Lake({"base": base, "one": one, "two": two, "three": three}, graph.edges(spark, links), {"one": ["a"], "two": ["b"], "three": ["c"]})


def test_a_sweep_joins_each_prefix_once(lk):
    c = AugmentationConfig("y", split_key="base__id", algorithm="Ridge")
    out = sweep("base", lk, c, ks=tuple(range(1, 21)), value_ratios=(0.5, 0.99))
    assert [r["approach"] for r in out] == [f"k={k}" for k in range(1, 21)] + ["value_ratio=0.5", "value_ratio=0.99"]
    trie = search.prefixes(lk, "base", search.Settings("y"))
    found = search.search(lk, "base", search.Settings("y"), trie)
    alone = trie.made
    assert alone == len(trie.tables) and {r["joins_made"] for r in out} == {alone}  # twenty-two searches, the joins of one
    assert [r["n_features"] for r in out[:3]] == [1, 2, 3] and out[0]["path"] in found.ranking
    assert any("three" in r for r in found.refused)  # three of five values of c are there


def test_tries_go_on(spark, lk, tmp_path):
    s = search.Settings("y", value_ratio=0.5)
    first = search.prefixes(lk, "base", s, str(tmp_path))
    want = search.search(lk, "base", s, first)
    again = search.prefixes(lk, "base", s, str(tmp_path))
    assert search.search(lk, "base", s, again) == want and again.made == 0 and first.made > 3
    path = paths.best_paths(want.ranking)[0]
    assert sorted(map(tuple, search.replay(lk, path, s, again).collect())) == sorted(map(tuple, search.replay(lk, path, s).select(search.replay(lk, path, s, again).columns).collect()))
    half = search.prefixes(lk, "base", search.Settings("y", sample=50), str(tmp_path))
    assert half.frame("base").count() == 50 and half.made == 1  # another sample is another table
    broken = again.place(path)
    import os

    os.remove(f"{broken}/_SUCCESS")  # a table whose write hasn't ended is made anew
    third = search.prefixes(lk, "base", s, str(tmp_path))
    third.frame(path)
    assert third.made == 1 and os.path.exists(f"{broken}/_SUCCESS")


def test_ablation_shares_joins(lk):
    c = AugmentationConfig("y", split_key="base__id", algorithm="Ridge")
    out = ablation("base", lk, c, {"plain": {}, "pearson": {"relevance": "pearson"}, "sampled": {"sample": 100}})
    assert out[0]["joins_made"] == out[1]["joins_made"] and [r["approach"] for r in out] == ["plain", "pearson", "sampled"]
    res = augment_features("base", lk, c)
    assert res.table.count() == 300 and max(r["score"] for r in res.results) > 0.9


def test_driver_helpers():
    names = ["a", "kpi__ts", "other__ts", "time"]
    assert [columns.time_column(names, k) for k in ("time", "ts", "nope")] == ["time", "kpi__ts", None]
    assert [columns.shown_path(p, "/a") for p in ("/a/b/c.csv", "/a", "/z/u/x.csv")] == ["b/c.csv", ".", "x.csv"]
    assert [policy.infer_policies(*x) for x in ((["time", "N"], "y"), (["a"], "lat99"), (["a"], "y"))] == [["time-private", "workload-private"], ["target-proxy-private"], ["none"]]
    found = search.Found({"a": 0.0, "a--a|k|k|b": 0.75, "a--a|k|k|c": 0.75}, {"a--a|k|k|b": ["b__x"], "a--a|k|k|c": ["c__x", "c__user_id"]}, [])
    ranking = search.plus_ranking(found)
    assert paths.best_paths(ranking) == ["a--a|k|k|b", "a--a|k|k|c"] and [round(ranking[p], 3) for p in paths.best_paths(ranking)] == [0.74, 0.615]
    ranking = {"a": 0.95, "a--a|k|k|d": 0.5, "a--a|k|k|b--b|j|j|c": 0.9, "a--a|k|k|b": 0.9, "a--a|k|k|e": 0.1}
    assert paths.best_paths(ranking, 4) == ["a--a|k|k|b", "a--a|k|k|b--b|j|j|c", "a--a|k|k|d"]
    name = paths.extend(paths.extend("a", paths.Step("a", "k", "l", "b")), paths.Step("b", "m", "n", "c"))
    assert [(x.source, x.source_column, x.target_column, x.target) for x in paths.parse(name)[1]] == [("a", "k", "l", "b"), ("b", "m", "n", "c")]
    assert [scalars.tolerance_seconds(t) for t in ("60", "5min", "200ms", "1h", "1d", "-3", "x")] == [60.0, 300.0, 0.2, 3600.0, 86400.0, None, None]
    import hashlib

    assert scalars.run_id(b="x", a=1) == hashlib.sha1(b'{"a": 1, "b": "x"}').hexdigest()[:12]
    with pytest.raises(KeyError):
        policy.policy_patterns(["unknown"])
    assert policy.policy_patterns(["all"]) == [p for ps in policy.POLICIES.values() for p in ps] and policy.policy_patterns(["none"]) == []
