"""Nearest rows, the learner, imputers and centroid decomposition, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinscout.operators import lowrank, neighbours, timeseries


def plain_nearest(queries, points, k, same=False, need=None):
    out = {}
    for q, x in queries:
        scores = []
        for p, y in points:
            both = [d for d in range(len(x)) if x[d] is not None and y[d] is not None]
            if not both or same and p == q or need and y[need[q]] is None:
                continue
            acc = 0.0
            for d in both:
                acc += (x[d] - y[d]) ** 2
            scores.append((acc if len(both) == len(x) else acc * (len(x) / len(both)), p))
        out[q] = [(p, d) for d, p in sorted(scores)[:k]]
    return out


def got_nearest(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append((r.p, r.d2))
        assert r["rank"] == len(out[r.q])
    return out


def cloud(rng, n, missing=0.0):
    points = [(i, [float(rng.randint(0, 12)), rng.choice([0.0, 50.0]) + rng.random(), rng.gauss(0, 3)]) for i in range(n)]
    points += [(n + i, [1.0, 2.0, 3.0]) for i in range(n // 3)]  # a third of all in one place
    return [(i, [None if rng.random() < missing else v for v in x]) for i, x in points]


@pytest.mark.parametrize(("missing", "same"), [(0.0, False), (0.0, True), (0.3, True)])
def test_nearest(spark, monkeypatch, missing, same):
    monkeypatch.setattr(neighbours, "AIM", 20)
    monkeypatch.setattr(neighbours, "CHUNK", 30)
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    points = cloud(random.Random(4), 150, missing)
    queries = points if same else [(1000 + i, x) for i, x in cloud(random.Random(5), 40, missing)]
    schema = "{} long, x array<double>"
    got = got_nearest(neighbours.nearest(spark, spark.createDataFrame(queries, schema.format("q")).repartition(3), spark.createDataFrame(points, schema.format("p")).repartition(4), 4, same))
    want = {q: r for q, r in plain_nearest(queries, points, 4, same).items() if r}
    assert got == want


def test_cells_prune(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "AIM", 20)
    rng = np.random.default_rng(1)
    sample = rng.random((800, 2))
    cells = neighbours.cut_cells(sample, np.full(800, 3), 800)
    assert 40 <= len(cells) <= 80
    inside = np.array([np.all([(sample[:, d] >= at) == above for d, at, above in c.cuts], axis=0) for c in cells])
    assert (inside.sum(0) == 1).all()  # each point is in one cell
    box = [(sample[i].min(0).tolist(), sample[i].max(0).tolist(), int(i.sum())) for i in inside]
    directory = neighbours.Directory(list(range(len(cells))), [3] * len(cells), [n for _, _, n in box], [1] * len(cells), [b[0] for b in box], [b[1] for b in box])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(sample.tolist()), pa.array([-1] * 800, pa.int32()), pa.array([0.002] * 800)], names=["__q", "__x", "__need", "__bound"])
    met = sum(b.num_rows for first in (True, False) for b in neighbours._pairs(directory, 3, first, ["__q"])([batch]))
    assert met < 800 * len(cells) * 0.2


def test_nearest_edges(spark):
    q = spark.createDataFrame([(1, [1.0, None]), (2, [None, None]), (None, [float("nan"), 3.0])], "q long, x array<double>")
    p = spark.createDataFrame([("b", [1.0, 3.0]), ("a", [1.0, 3.0]), ("c", [None, None]), (None, [9.0, None])], "p string, x array<double>")
    got = {(r.q, r["rank"], r.p, r.d2) for r in neighbours.nearest(spark, q, p, 2).collect()}
    assert got == {(1, 1, "a", 0.0), (1, 2, "b", 0.0), (None, 1, "a", 0.0), (None, 2, "b", 0.0)}
    assert neighbours.nearest(spark, q.limit(0), p, 2).count() == 0 and neighbours.nearest(spark, q, p.limit(0), 2).count() == 0
    assert neighbours.nearest(spark, q, p.where("p = 'c'"), 2).count() == 0


def test_neighbour_impute(spark):
    rng = random.Random(9)
    rows = [(i, *[None if rng.random() < 0.25 else float(rng.randint(0, 9)) + i / 1000 for _ in range(3)], "text") for i in range(120)] + [(500, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, t string").repartition(3)
    out = neighbours.neighbour_impute(df, ["a", "b", "c"], 3)
    assert out.columns == df.columns
    got = {r.id: (r.a, r.b, r.c) for r in out.collect()}
    points = [(r[0], list(r[1:4])) for r in rows]
    means = [sum(v) / len(v) for v in ([r[c] for r in rows if r[c] is not None] for c in (1, 2, 3))]
    for i, x in points:
        for c in range(3):
            want = x[c]
            if want is None:
                near = plain_nearest([(i, x)], points, 3, need={i: c})[i]
                want = sum(dict(points)[p][c] for p, _ in near) / len(near) if near else means[c]
            assert got[i][c] == pytest.approx(want), (i, c)


# ---- centroid decomposition ----


def plain_centroids(x, missing, rank, tolerance):
    """The same with the whole matrix in one place."""
    rounds, before = 0, None
    while True:
        found, rest = [], x.copy()
        for j in range(rank):
            z = np.ones(len(x)) if before is None or j >= len(before) else np.where(rest @ before[j] >= 0, 1, -1)
            c = z @ rest
            for _ in range(lowrank.STEPS if before is None else 0):
                d = np.where(rest @ c >= 0, 1, -1) @ rest
                if np.linalg.norm(d) <= np.linalg.norm(c) * (1 + 1e-12):
                    break
                c = d
            found.append(c / np.linalg.norm(c))
            rest = rest - np.outer(rest @ found[-1], found[-1])
        if rounds and change < tolerance or rounds == lowrank.ROUNDS:
            return x
        r = np.stack(found, 1)
        new = np.where(missing, x @ r @ r.T, x)
        change = np.sqrt(((new - x) ** 2).sum() / (x[missing] ** 2).sum())
        x, before, rounds = new, found, rounds + 1


def test_centroid_impute(spark):
    rng = np.random.default_rng(2)
    t = np.arange(400)
    base = np.stack([np.sin(t / 3), np.sign(np.sin(t / 7)) * (t % 5)])
    truth = (base.T @ rng.normal(size=(2, 6))) + 0.05 * rng.normal(size=(400, 6)) + 7
    hidden = rng.random(truth.shape) < 0.1
    hidden[100:112, 2] = True  # a gap that a line can't cross
    rows = [(int(i), *[None if hidden[i, c] else float(truth[i, c]) for c in range(6)]) for i in t]
    names = [f"s{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "at long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    out = lowrank.centroid_impute(df, names, "at")
    got = np.array([[r[n] for n in names] for r in out.orderBy("at").collect()])
    lines = np.array([[r[n] for n in names] for r in timeseries.impute(df, names, "at", [], "linear").orderBy("at").collect()])
    for c in range(6):
        seen = ~hidden[:, c]
        assert lines[:, c] == pytest.approx(np.interp(t, t[seen], truth[seen, c]))
    observed = np.where(hidden, np.nan, truth)
    mean, std = np.nanmean(observed, 0), np.nanstd(observed, 0)
    want = plain_centroids((lines - mean) / std, hidden, 2, 1e-3) * std + mean
    assert got == pytest.approx(want, abs=1e-6) and (got[~hidden] == truth[~hidden]).all()
    error = lambda a: math.sqrt(((a - truth)[hidden] ** 2).mean())
    assert error(got) < 0.3 * error(lines)
    again = lowrank.centroid_impute(df.repartition(2), names, "at")
    assert np.array([[r[n] for n in names] for r in again.orderBy("at").collect()]) == pytest.approx(got, abs=1e-9)


def test_centroid_edges(spark):
    df = spark.createDataFrame([(1, 1.0, None, None), (None, 2.0, 4.0, None), (3, None, float("nan"), None), (3, 4.0, 8.0, None)], "t long, a double, b double, c double")
    got = sorted(((r.t or 0, r.a, r.b, r.c) for r in lowrank.centroid_impute(df, ["a", "b", "c"], "t").collect()), key=str)
    assert len(got) == 4 and all(r[1] is not None and r[2] is not None and r[3] is None for r in got)
    assert lowrank.centroid_impute(df.limit(0), ["a", "b"], "t").count() == 0
    assert lowrank.centroid_impute(df, ["a"], "t").where("a is null").count() == 1  # one series alone has nothing to go by


def test_slabbed_impute_of_series(spark):
    rng = random.Random(1)
    rows = [(k, t if rng.random() > 0.02 else None, None if rng.random() < 0.4 else float(rng.randint(0, 99))) for k in ("a", "b", None) for t in rng.sample(range(5000), 300)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {}
    for m in ("fill", "linear"):
        for r in timeseries.impute(df, ["v"], "t", ["k"], m).where("t is not null").collect():
            got[m, r.k, r.t] = r.v
    for k in ("a", "b", None):
        mine = sorted((t, v) for kk, t, v in rows if kk == k and t is not None)
        seen = [(t, v) for t, v in mine if v is not None]
        for t, _ in mine:
            back, ahead = [v for u, v in seen if u <= t], [v for u, v in seen if u >= t]
            assert got["fill", k, t] == (back[-1] if back else ahead[0])
            assert got["linear", k, t] == pytest.approx(float(np.interp(t, [u for u, _ in seen], [v for _, v in seen])))
    plan = timeseries.impute(df, ["v"], "t", ["k"], "linear")._jdf.queryExecution().executedPlan().toString()
    assert F.lit(1) is not None and "__slab" in plan


@pytest.mark.parametrize("block", [8192, 1])
def test_windows_and_deltas_over_slabs_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(timeseries, "BLOCK", block)
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 3000), i, None if rng.random() < 0.1 else rng.random()) for k in ("a", None) for i in range(400)] + [("b", 5, 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double").repartition(3)
    got = {(r.k, r.start): (r.window, r.y) for r in timeseries.sliding_windows(df, "v", "t", ["k"], size=7, stride=3, horizon=2, tie="i").collect()}
    want, deltas = {}, []
    for k in ("a", None, "b"):
        mine = sorted((t, i, v) for kk, t, i, v in rows if kk == k)
        deltas += [(k, t, i, None if j == 0 else float(t - mine[j - 1][0])) for j, (t, i, _) in enumerate(mine)]
        for s in range(0, len(mine) - 8, 3):
            want[k, s] = ([v for _, _, v in mine[s : s + 7] if v is not None], mine[s + 8][2])
    assert got == want
    found = timeseries.with_delta(df, "t", ["k"], "i").collect()
    assert sorted(((r.k, r.t, r.i, r.delta) for r in found), key=repr) == sorted(deltas, key=repr)
    alone = timeseries.with_delta(df.drop("k"), "t", [], "i").agg(F.sum("delta"), F.count("delta")).first()
    assert tuple(alone) == (max(r[1] for r in rows) - min(r[1] for r in rows), len(rows) - 1)


def test_equal_rows_are_met_once(spark, monkeypatch, tmp_path):
    """Of points that are equal in what a group of queries has only the first few by key are met, and equal queries once; results as in plain."""
    monkeypatch.setattr(neighbours, "work_dir", lambda spark, name: str(tmp_path / "n"))
    points = [(i, [float(i % 5), float(i)]) for i in range(400)]
    queries = [(i, [float(i % 5) + 0.25, None]) for i in range(100)]
    got = neighbours.nearest(spark, spark.createDataFrame(queries, "q long, x array<double>"), spark.createDataFrame(points, "p long, x array<double>"), 2).collect()
    assert sorted((r.q, r["rank"], r.p) for r in got) == [(i, k + 1, i % 5 + 5 * k) for i in range(100) for k in (0, 1)]
    assert spark.read.parquet(str(tmp_path / "n" / "points")).count() == 10
    assert spark.read.parquet(str(tmp_path / "n" / "pairs1")).count() == 5
