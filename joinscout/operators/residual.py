"""A residual-stack forecaster: blocks that each explain a part of the window and of what follows, trained data-parallel in barrier tasks.

A block is two layers with a backcast and a forecast head; the backcast is taken from the window before the next block sees it, and forecasts add up. Rows
are dealt to `workers` tasks by hash and stay there; an epoch is one job in which all tasks go through their rows together: each step every task sends
its gradient's sum and takes everybody's, added up in the order of tasks, so all make the same update and only one returns the weights. These are written
to the folder after each epoch, so a fit that was interrupted goes on from there and ends with the same weights. Tasks wait for each other once a step (about a
second, whatever is sent), so an epoch has at most STEPS steps: with more rows a step's gradient is over more of them, added up batch by batch. A task holds one batch of rows.
"""

from __future__ import annotations

import base64
import itertools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_dir

#: Rows of a task's batch, and steps of an epoch at most.
BATCH, STEPS = 256, 32


def start_weights(size: int, hidden: int, blocks: int, seed: int):
    """All weights as one vector: of each block two layers, backcast and forecast, each with its offsets."""
    import numpy as np

    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(blocks):
        for rows, cols, scale in ((size, hidden, (2 / size) ** 0.5), (hidden, hidden, (2 / hidden) ** 0.5), (hidden, size, 0.1 / hidden**0.5), (hidden, 1, 0.1 / hidden**0.5)):
            parts += [rng.normal(size=rows * cols) * scale, np.zeros(cols)]
    return np.concatenate(parts)


def _shapes(size: int, hidden: int) -> list[tuple[int, int]]:
    return [s for rows, cols in ((size, hidden), (hidden, hidden), (hidden, size), (hidden, 1)) for s in ((rows, cols), (1, cols))]


def _parts(weights, size: int, hidden: int, blocks: int) -> list[list]:
    out, at = [], 0
    for _ in range(blocks):
        block = []
        for rows, cols in _shapes(size, hidden):
            block.append(weights[at : at + rows * cols].reshape(rows, cols))
            at += rows * cols
        out.append(block)
    return out


def forward(weights, x, hidden: int, blocks: int):
    """Forecasts of windows x, and what each block has seen and made, for the gradient."""
    import numpy as np

    total, kept = np.zeros(len(x)), []
    for w1, b1, w2, b2, wb, bb, wf, bf in _parts(weights, x.shape[1], hidden, blocks):
        h1 = np.maximum(x @ w1 + b1, 0)
        h2 = np.maximum(h1 @ w2 + b2, 0)
        total = total + (h2 @ wf + bf)[:, 0]
        kept.append((x, h1, h2))
        x = x - (h2 @ wb + bb)
    return total, kept


def gradient(weights, x, y, hidden: int, blocks: int):
    """The sum over rows of the squared error's gradient, and of the squared error."""
    import numpy as np

    made, kept = forward(weights, x, hidden, blocks)
    error = made - y
    parts = _parts(weights, x.shape[1], hidden, blocks)
    out: list = [None] * blocks
    d_rest = np.zeros_like(x)  # with respect to what the next block sees
    d_total = (2 * error)[:, None]
    for i in range(blocks - 1, -1, -1):
        w1, _, w2, _, wb, _, wf, _ = parts[i]
        seen, h1, h2 = kept[i]
        d_back = -d_rest
        d2 = (d_total @ wf.T + d_back @ wb.T) * (h2 > 0)
        d1 = (d2 @ w2.T) * (h1 > 0)
        out[i] = [seen.T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ d_back, d_back.sum(0), h2.T @ d_total, d_total.sum(0)]
        d_rest = d_rest + d1 @ w1.T
    return np.concatenate([g.ravel() for block in out for g in block]), float((error * error).sum())


def adam(state: dict, grad, rate: float) -> dict:
    """One step; state: w, m, v, t."""
    import numpy as np

    t = state["t"] + 1
    m, v = 0.9 * state["m"] + 0.1 * grad, 0.999 * state["v"] + 0.001 * grad * grad
    w = state["w"] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"w": w, "m": m, "v": v, "t": t}


def _epoch(state: dict, hidden: int, blocks: int, rate: float, share, per_step: int = 1):
    """One pass over a task's rows in step with the others, per_step batches a step. share: sends a text and returns all tasks' in order (a barrier's allGather if None)."""

    def run(batches) -> Iterator:
        import numpy as np
        import pandas as pd

        if share is None:
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
            gather, first = context.allGather, context.partitionId() == 0
        else:
            gather, first = share, True

        def pieces():
            """Batches of BATCH rows, however the rows come."""
            x, y = [], []
            for part in batches:
                x += part["window"].tolist()
                y += part["y"].tolist()
                while len(y) >= BATCH:
                    yield np.array(x[:BATCH], float), np.array(y[:BATCH], float)
                    x, y = x[BATCH:], y[BATCH:]
            if y:
                yield np.array(x, float), np.array(y, float)

        now, rows, loss, n = state, pieces(), 0.0, 0
        while True:
            grad, error, own = np.zeros_like(now["w"]), 0.0, 0
            for piece in itertools.islice(rows, per_step):
                more, wrong = gradient(now["w"], *piece, hidden, blocks)
                grad, error, own = grad + more, error + wrong, own + len(piece[1])
            sent = json.dumps({"n": own, "e": error, "g": base64.b64encode(grad.tobytes()).decode() if own else ""})
            told = [json.loads(t) for t in gather(sent)]
            count = sum(t["n"] for t in told)
            if not count:
                break
            total = np.zeros_like(grad)
            for t in told:
                if t["g"]:
                    total += np.frombuffer(base64.b64decode(t["g"]))
            now, loss, n = adam(now, total / count, rate), loss + sum(t["e"] for t in told), n + count
        if first:
            yield pd.DataFrame({"w": [now["w"].tolist()], "m": [now["m"].tolist()], "v": [now["v"].tolist()], "t": [now["t"]], "loss": [loss / max(n, 1)], "n": [n]})

    return run


_STATE = "w array<double>, m array<double>, v array<double>, t long, loss double, n long"


class ResidualStack:
    """Weights, and the scale of the values they were trained on."""

    def __init__(self, weights, size: int, hidden: int, blocks: int, mean: float, spread: float, losses: list[float]):
        self.weights, self.size, self.hidden, self.blocks, self.mean, self.spread, self.losses = weights, size, hidden, blocks, mean, spread, losses

    def predict(self, windows: DataFrame) -> DataFrame:
        """windows with `prediction`; null where the window isn't whole."""
        weights, size, hidden, blocks, mean, spread = self.weights, self.size, self.hidden, self.blocks, self.mean, self.spread

        @F.pandas_udf("double")
        def predicted(x):
            import numpy as np
            import pandas as pd

            out = np.full(len(x), np.nan)
            rows = np.array([[np.nan] * size if v is None or len(v) != size else [np.nan if u is None else u for u in v] for v in x], float).reshape(len(x), size)
            whole = np.isfinite(rows).all(1)
            if whole.any():
                out[whole] = forward(weights, (rows[whole] - mean) / spread, hidden, blocks)[0] * spread + mean
            return pd.Series(out)

        return windows.withColumn("prediction", F.nullif(predicted(F.col("window").cast("array<double>")), F.lit(float("nan"))))


def fit(windows: DataFrame, size: int, hidden: int = 32, blocks: int = 3, epochs: int = 10, rate: float = 3e-3, seed: int = 42, workers: int | None = None, folder: str | None = None) -> ResidualStack:
    """Train on windows(window, y); those with a null or a number that isn't finite are left out.

    workers: tasks that run at once, as a barrier needs them (a quarter of the session's slots unless given); weights depend on it, on the seed and on the rows, not on how rows
    are partitioned. folder: where each epoch's weights go; epochs that are there already aren't done again.
    """
    import numpy as np

    spark = windows.sparkSession
    workers = workers or max(1, spark.sparkContext.defaultParallelism // 4)
    folder = (folder or work_dir(spark, "residual")).rstrip("/")
    x, y = F.col("window").cast("array<double>"), F.col("y").cast("double")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = windows.select(x.alias("window"), y.alias("y"), F.xxhash64(x, y).alias("place")).where((F.size("window") == size) & finite(F.col("y")) & F.forall("window", finite))
    stats = rows.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    mean, spread = stats.m or 0.0, stats.s or 1.0
    scaled = rows.select(F.transform("window", lambda v: (v - mean) / spread).alias("window"), ((F.col("y") - mean) / spread).alias("y"), "place")
    scaled.repartition(workers, "place").write.parquet(f"{folder}/rows", mode="ignore")
    most = spark.read.parquet(f"{folder}/rows").groupBy(F.pmod(F.hash("place"), F.lit(workers))).count().agg(F.max("count")).first()[0] or 0  # rows of the fullest task
    per_step = max(1, -(-most // (BATCH * STEPS)))
    weights = start_weights(size, hidden, blocks, seed)
    state = {"w": weights, "m": np.zeros_like(weights), "v": np.zeros_like(weights), "t": 0}
    jvm = spark.sparkContext._jvm
    losses = []
    for epoch in range(epochs):
        path = f"{folder}/epoch={epoch:05d}"
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            dealt = spark.read.parquet(f"{folder}/rows").repartition(workers, "place").sortWithinPartitions("place", "window", "y").drop("place")
            dealt.mapInPandas(_epoch(state, hidden, blocks, rate, None, per_step), _STATE, barrier=True).write.mode("overwrite").parquet(path)
        r = spark.read.schema(_STATE).parquet(path).first()  # one row: the weights
        if r is None:
            break
        state = {"w": np.array(r.w), "m": np.array(r.m), "v": np.array(r.v), "t": r.t}
        losses.append(r.loss)
    return ResidualStack(state["w"], size, hidden, blocks, mean, spread, losses)
