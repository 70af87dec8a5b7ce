"""Learners: names of columns, importance by permutation, extra trees, nearest neighbours, text codes, Poisson draws."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinscout.operators import augment, models, trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(600):
        a, b, c = float(rng.randint(0, 1)), rng.random(), rng.random()
        out.append((i, a, b, c, 3 * a + 0.1 * rng.random() + (b > 0.5) * 0.5, float(a + (b > 0.5))))
    return spark.createDataFrame(out, "id long, x double, y double, c double, t double, k double").repartition(4).cache()


@pytest.mark.parametrize("name", models.LEARNERS)
def test_any_names_and_every_learner(rows, name):
    """Features called as the pipeline's own columns once were, and a target called y."""
    model = models.fit(rows, ["x", "y", "c"], "t", name)
    score = models.regression_metrics(models.predict(model, rows, ["x", "y", "c"], "t")).first().r2
    assert score > (0.8 if name != "Ridge" else 0.0)
    again = models.predict(models.fit(rows.withColumnsRenamed({"y": "prediction", "t": "y"}), ["x", "prediction", "c"], "y", name), rows.withColumnsRenamed({"y": "prediction", "t": "y"}), ["x", "prediction", "c"], "y")
    assert models.regression_metrics(again).first().r2 == pytest.approx(score, abs=0.02)


@pytest.mark.parametrize("name", ["ExtraTrees", "KNeighbors", "RandomForest"])
def test_classes(rows, name):
    model = models.fit(rows, ["x", "y", "c"], "k", name, regression=False)
    assert models.classification_metrics(models.predict(model, rows, ["x", "y", "c"], "k")).first().accuracy > 0.95


def test_permutation_importance(rows):
    model = models.fit(rows, ["x", "y", "c"], "t", "RandomForest")
    found = models.permutation_importance(model, rows, ["x", "y", "c"], "t")
    assert found["x"] > 1.5 and 0.0 < found["y"] < 0.3 and abs(found["c"]) < 0.05  # a binary feature that decides the target
    out = models.permuted(rows, ["x", "y", "c"], "t").withColumnsRenamed({"__f0": "x", "__f1": "y", "__f2": "c"})
    whole = [tuple(r) for r in rows.select("x", "y", "c").collect()]
    for i, f in enumerate(["x", "y", "c"]):
        got = [tuple(r) for r in out.where(F.col("feature") == f).select("x", "y", "c").collect()]
        assert Counter(r[i] for r in got) == Counter(r[i] for r in whole)  # a permutation of the values
        rest = lambda r: tuple(v for j, v in enumerate(r) if j != i)  # noqa: B023, E731
        assert Counter(map(rest, got)) == Counter(map(rest, whole))  # the others are as they were
    classes = models.fit(rows, ["x", "c"], "k", "RandomForest", regression=False)
    assert models.permutation_importance(classes, rows, ["x", "c"], "k", regression=False)["x"] > 0.2


def test_learner_names():
    assert models.learner_name("LightGBM") == models.learner_name("XGBoost") == "BoostedTrees" and models.learner_name("KNeighbors") == "KNeighbors"
    with pytest.raises(ValueError, match="learner"):
        models.learner("Unknown", True)


def plain_trees(x, y, classes, of):
    """One tree after the other on the whole table."""
    lo, unit = y.min(), (y.max() - y.min()) / (1 << 20) or 1.0
    whole = y.astype(int) if classes else np.round((y - lo) / unit).astype(int)
    tried = x.shape[1] if not classes else max(1, round(x.shape[1] ** 0.5))
    out = []
    for t in range(of.trees):
        leaves, todo = {}, [(1, np.arange(len(x)), 0)]
        while todo:
            i, here, depth = todo.pop()
            target = whole[here]
            counts = np.bincount(target, minlength=classes) if classes else None
            leaves[i] = counts / counts.sum() if classes else np.array([lo + unit * target.sum() / len(target)])
            if depth == of.depth or len(here) < of.least or len(set(target.tolist())) == 1:
                continue
            best = None
            for f in trees.candidates(of.seed, t, i, x.shape[1], tried):
                v = x[here, f]
                if v.max() > v.min():
                    at = v.min() + (v.max() - v.min()) * trees.drawn(of.seed, t, i, f, 1)
                    at = at if at > v.min() else v.max()
                    cost = 0.0
                    for part in (target[v < at], target[v >= at]):
                        if classes:
                            cost += len(part) - (np.bincount(part) ** 2).sum() / len(part) if len(part) else 0
                        else:
                            cost += float((part.astype(float) ** 2).sum() - part.astype(float).sum() ** 2 / len(part)) if len(part) else 0
                    if best is None or cost < best[0] - 1e-6 * abs(best[0]):
                        best = cost, f, at
            if best:
                _, f, at = best
                leaves[i] = (f, at)
                todo += [(2 * i, here[x[here, f] < at], depth + 1), (2 * i + 1, here[x[here, f] >= at], depth + 1)]
        out.append(leaves)
    answers = []
    for row in x:
        total = 0
        for leaves in out:
            i = 1
            while isinstance(leaves[i], tuple):
                f, at = leaves[i]
                i = 2 * i + int(row[f] >= at)
            total = total + leaves[i]
        answers.append(float(np.argmax(total)) if classes else float(total[0] / of.trees))
    return answers


@pytest.mark.parametrize("classes", [0, 3])
def test_extra_trees(spark, rows, classes):
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["x", "y", "c"], outputCol="features").transform(rows)
    of = trees.ExtraTrees("features", "k" if classes else "t", not classes, seed=5, trees=3, depth=4)
    got = {r.id: r.prediction for r in of.fit(data).transform(data).collect()}
    again = {r.id: r.prediction for r in of.fit(data.repartition(7)).transform(data).collect()}
    assert got == again
    table = [tuple(r) for r in rows.orderBy("id").collect()]
    want = plain_trees(np.array([r[1:4] for r in table]), np.array([r[5 if classes else 4] for r in table]), classes, of)
    assert [got[r[0]] for r in table] == pytest.approx(want)
    other = trees.ExtraTrees("features", "t", True, seed=6, trees=3, depth=4).fit(data)
    assert other.trees[0] != of.fit(data).trees[0] if not classes else True
    assert trees.ExtraTrees().fit(data.limit(0).withColumn("label", F.col("t"))).trees[0][1].answer == (0.0,)


def test_text_codes(spark, monkeypatch):
    monkeypatch.setattr(models, "LEVELS", 3)
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(["b"] * 5 + ["a"] * 5 + ["c"] * 3 + [f"rare{i}" for i in range(20)] + [None])], "v string, y double")
    got = {r.v: r.code for r in models.text_codes(df.withColumn("code", F.col("v")), ["code"]).collect()}
    assert [got[v] for v in ("a", "b", "c")] == [0.0, 1.0, 2.0] and got[None] == 3.0 + models.SHARED
    assert all(3 <= got[f"rare{i}"] < 3 + models.SHARED for i in range(20))
    ready, names = models.prepare(df.withColumn("w", F.concat("v", F.lit("!"))), "y")
    assert names == ["v", "w"]  # many levels, still features


@pytest.mark.parametrize("ratio", [0.5, 14.0, 40.0])
def test_draws_have_no_cap(spark, ratio):
    df = spark.range(4000).select("id", augment._times(42, F.col("id"), ratio).alias("n"))
    r = df.agg(F.avg("n").alias("m"), F.var_samp("n").alias("v"), F.max("n").alias("top")).first()
    assert r.m == pytest.approx(ratio, abs=4 * math.sqrt(ratio / 4000)) and r.v == pytest.approx(ratio, rel=0.12) and r.top > ratio + 2 * math.sqrt(ratio)


def test_distribution_distance_by_slabs(spark, monkeypatch):
    monkeypatch.setattr(augment, "SLABS", 8)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=500), np.round(rng.normal(0.5, 2, 700), 1)
    frames = [spark.createDataFrame([(float(v), float(i % 3)) for i, v in enumerate(x)] + [(None, 1.0)], "x double, y double").repartition(3) for x in (a, b)]
    got = {r.column: r for r in augment.distribution_distance(*frames, ["x", "y"]).collect()}
    at = np.sort(np.unique(np.concatenate([a, b])))
    fa, fb = ((x[None, :] <= at[:, None]).mean(1) for x in (a, b))
    assert got["x"].ks == pytest.approx(np.abs(fa - fb).max()) and got["x"].wasserstein == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(at)).sum())
    plan = augment.distribution_distance(*frames, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "slab" in plan and augment.distribution_distance(frames[0].limit(0), frames[1], ["x"]).first().ks is None


def test_forests_take_rows_in_pieces_of_bounded_size(spark, monkeypatch):
    """Rows of one partition are dealt to as many as their number asks for, none is lost, and nothing stays cached."""
    from pyspark.sql import functions as F

    from joinscout.operators import models

    monkeypatch.setattr(models, "PIECE", 300)
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("a"), (F.col("id") * 7 % 13).alias("b"), (F.col("id") * 2.0).alias("y"))
    sizes = [r["count"] for r in models.spread(df).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 30 and max(sizes) <= 110 and sum(sizes) == 3000
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before = set(kept().keySet())  # of other tests
    model = models.fit(df, ["a", "b"], "y", "RandomForest")
    assert models.regression_metrics(models.predict(model, df, ["a", "b"], "y")).first().r2 > 0.9
    assert set(kept().keySet()) <= before
