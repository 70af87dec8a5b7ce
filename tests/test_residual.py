"""The residual-stack forecaster: gradient, training against the moving average, seeds, and going on after a failure."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from joinscout.operators import models, residual, timeseries


def test_gradient():
    rng = np.random.default_rng(0)
    w = residual.start_weights(5, 4, 3, 1) + 0.1 * rng.normal(size=len(residual.start_weights(5, 4, 3, 1)))
    x, y = rng.normal(size=(7, 5)), rng.normal(size=7)
    g, loss = residual.gradient(w, x, y, 4, 3)
    assert loss == pytest.approx(((residual.forward(w, x, 4, 3)[0] - y) ** 2).sum())
    for i in rng.choice(len(w), 40, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (((residual.forward(w + s, x, 4, 3)[0] - y) ** 2).sum() for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(t), float(10 + 5 * np.sin(t / 4 + k) + 2 * np.sin(t / 1.7) + 0.2 * rng.normal())) for k in range(4) for t in range(400)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    return timeseries.sliding_windows(df, "v", "t", ["k"], size=12, stride=1, horizon=1).cache()


def test_beats_the_moving_average(spark, windows, tmp_path):
    train, test = windows.where("start < 300"), windows.where("start >= 300")
    model = residual.fit(train, 12, epochs=12, workers=2)
    assert model.losses[-1] < 0.5 * model.losses[0]
    out = timeseries.naive_forecasts(model.predict(test))
    mine, naive = models.regression_metrics(out).first(), models.regression_metrics(out, prediction="naive_moving_average").first()
    assert mine.n == naive.n == test.count() and mine.rmse < 0.4 * naive.rmse


def test_seed_partitioning_and_resuming(spark, windows, tmp_path, monkeypatch):
    odd = windows.select("window", "y").unionByName(spark.createDataFrame([([1.0] * 11, 1.0), ([None] * 12, 1.0), ([1.0] * 12, None), ([float("nan")] * 12, 2.0)], "window array<double>, y double"))
    want = residual.fit(odd, 12, epochs=3, workers=2, seed=5)
    again = residual.fit(odd.repartition(7), 12, epochs=3, workers=2, seed=5, folder=str(tmp_path / "a"))
    assert np.allclose(want.weights, again.weights, rtol=0, atol=1e-6) and want.losses == pytest.approx(again.losses)
    assert not np.allclose(residual.fit(odd, 12, epochs=1, workers=2, seed=6).weights, want.weights)
    # a fit that ends early goes on from its folder
    residual.fit(odd, 12, epochs=2, workers=2, seed=5, folder=str(tmp_path / "b"))
    real = residual._epoch

    def failing(*args):
        run = real(*args)

        def broken(batches):
            raise RuntimeError("lost")
            yield from run(batches)

        return broken

    monkeypatch.setattr(residual, "_epoch", failing)
    with pytest.raises(Exception, match="lost"):
        residual.fit(odd, 12, epochs=3, workers=2, seed=5, folder=str(tmp_path / "b"))
    monkeypatch.setattr(residual, "_epoch", real)
    resumed = residual.fit(odd, 12, epochs=3, workers=2, seed=5, folder=str(tmp_path / "b"))
    assert np.allclose(resumed.weights, want.weights, rtol=0, atol=1e-6)


def test_no_rows(spark, windows):
    empty = residual.fit(windows.limit(0), 12, epochs=2, workers=2)
    assert empty.predict(windows.limit(3)).where(F.col("prediction").isNotNull()).count() == 3


def test_steps_of_an_epoch_are_bounded():
    """Tasks meet at most STEPS times and once to end, over all rows, whatever their number."""
    rng, met = np.random.default_rng(4), []
    n = residual.BATCH * residual.STEPS * 2 + 7
    x, y = rng.normal(size=(n, 5)), rng.normal(size=n)
    w = residual.start_weights(5, 4, 2, 1)
    state = {"w": w, "m": np.zeros_like(w), "v": np.zeros_like(w), "t": 0}

    def share(text):
        met.append(json.loads(text)["n"])
        return [text]

    rows = pd.DataFrame({"window": list(x), "y": y})
    (out,) = residual._epoch(state, 4, 2, 3e-3, share, per_step=3)(iter([rows[:1000], rows[1000:]]))
    assert len(met) <= residual.STEPS + 1 and sum(met) == n and out.n[0] == n
    (one,) = residual._epoch(state, 4, 2, 3e-3, lambda t: [t], per_step=10**6)(iter([rows]))
    g, _ = residual.gradient(w, x, y, 4, 2)
    assert one.t[0] == 1 and np.allclose(one.w[0], residual.adam(state, g / n, 3e-3)["w"])


def test_fit_bounds_its_steps(spark, windows, monkeypatch):
    monkeypatch.setattr(residual, "BATCH", 64)
    monkeypatch.setattr(residual, "STEPS", 4)
    seen, real = [], residual._epoch
    monkeypatch.setattr(residual, "_epoch", lambda *args: seen.append(args[-1]) or real(*args))
    fitted = residual.fit(windows, 12, epochs=1, workers=2)
    n = windows.count()
    assert seen == [seen[0]] and n / 2 / 64 / 4 <= seen[0] <= n / 2 / 64 / 4 + 2 and len(fitted.losses) == 1
