"""Completion of correlated series by centroid decomposition.

The matrix has a row a time and a column a series. Its centroid decomposition takes, one after the other, the direction c = X'z whose sign
vector z makes it long, and takes that direction out of the rows. The sign vector is never held: z = sign(Xc) is found anew from c where the rows
are, and a step needs only the blocks' sums of z_i x_i, one number a series. Directions are orthonormal, so what k of them keep of
a row is RR'x, and missing cells are filled with that, again and again, until they don't change. All state is the directions of the rounds so
far; a task goes through them again for its own rows, so nothing is checkpointed but the matrix, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_dir

#: Rounds of filling, and steps of a direction, at most; both end sooner as a rule.
ROUNDS, STEPS = 30, 50


def completed(x, missing, rounds: list):
    """Rows after the fills of some rounds of directions (each series x k), and the last round's squared change and size of the missing cells."""
    import numpy as np

    changed = size = 0.0
    for r in rounds:
        kept = np.where(missing, (x @ r) @ r.T, x)
        changed, size = float(((kept - x) ** 2).sum()), float((x[missing] ** 2).sum())
        x = kept
    return x, changed, size


def _rows(batch, width: int):
    import numpy as np

    x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x, batch.column("__m").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(-1, width) if len(x) else np.zeros((0, width), bool)


def _sums(width: int, rounds: list, directions: list, towards) -> Callable:
    """Of each block: the sum of z_i x_i, x_i without the directions found so far and z the signs along `towards` (ones if None); change and size."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(width + 2)
        for batch in batches:
            x, changed, size = completed(*_rows(batch, width), rounds)
            for r in directions:
                x = x - np.outer(x @ r, r)
            z = np.ones(len(x)) if towards is None else np.where(x @ towards >= 0, 1.0, -1.0)
            total += [*(z @ x), changed, size]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 2), pa.int32()), pa.array(total)], names=["i", "v"])

    return run


class Centroids:
    """Directions of a matrix of rows (__x: values, __m: which are missing), by jobs that return one number a series."""

    def __init__(self, matrix: DataFrame, width: int, rank: int):
        self.matrix, self.width, self.rank = matrix.select("__x", "__m"), width, rank
        self.rounds: list = []

    def _sum(self, directions: list, towards) -> tuple:
        import numpy as np

        parts = self.matrix.mapInArrow(_sums(self.width, self.rounds, directions, towards), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        out = np.zeros(self.width + 2)
        for r in parts.collect():  # a row a series
            out[r.i] = r.v
        return out[:-2], out[-2], out[-1]

    def directions(self, before: list | None) -> tuple[list, float]:
        """k directions of the rows as filled so far; and how much the round before changed, as a part of what it filled.

        The first ones go on until the sign vector stays. Later ones take a single step from those of the round before, as rows change little
        from round to round and the next round goes on.
        """
        import numpy as np

        found, change = [], 0.0
        for j in range(self.rank):
            c, changed, size = self._sum(found, before[j] if before is not None and j < len(before) else None)
            if j == 0:
                change = (changed / size) ** 0.5 if size > 0 else 0.0
            for _ in range(STEPS if before is None else 0):
                longer = self._sum(found, c)[0]
                if np.linalg.norm(longer) <= np.linalg.norm(c) * (1 + 1e-12):
                    break
                c = longer
            norm = np.linalg.norm(c)
            if norm <= 1e-12:
                break
            found.append(c / norm)
        return found, change

    def fit(self, tolerance: float) -> list:
        """The rounds' directions until a round changes less than `tolerance` of what it fills."""
        import numpy as np

        found = None
        for n in range(ROUNDS + 1):
            found, change = self.directions(found)
            if not found or n == ROUNDS or n and change < tolerance:
                break
            self.rounds.append(np.stack(found, 1))
        return self.rounds


def centroid_impute(df: DataFrame, columns: list[str], time: str, rank: int = 2, tolerance: float = 1e-3, start: Callable | None = None) -> DataFrame:
    """Fill nulls and NaN of `columns`, series over the rows' times, by a centroid decomposition of rank `rank` at most (one less than the series).

    Series are scaled by their observed mean and spread, and cells start on the line between their neighbours in time. A series without any value stays as it is;
    cells of rows that have no time count like others. What the driver holds is directions: series x rank x rounds.
    """
    clean = df.withColumns({c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns})
    stats = clean.agg(*[f.alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count(c)), ("m", F.avg(c)), ("s", F.stddev_pop(c)))]).first()
    use = [(i, c) for i, c in enumerate(columns) if stats[f"n{i}"]]
    spread = {i: stats[f"s{i}"] or 1.0 for i, _ in use}
    k = min(rank, len(use) - 1)
    if k < 1:
        return clean
    begun = (start or _lines)(clean, [c for _, c in use], time)
    missing = F.array(*[F.col(c).isNull() for _, c in use])
    scaled = F.array(*[F.coalesce((F.col(f"__start{j}") - stats[f"m{i}"]) / spread[i], F.lit(0.0)) for j, (i, _) in enumerate(use)])
    path = work_dir(df.sparkSession, "centroids")
    begun.select(*clean.columns, scaled.alias("__x"), missing.alias("__m")).write.parquet(path)
    matrix = df.sparkSession.read.parquet(path)
    rounds = Centroids(matrix, len(use), k).fit(tolerance)
    width = len(use)

    @F.pandas_udf("array<double>")
    def filled(x, m):
        import numpy as np
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(completed(np.array(x.tolist(), float).reshape(-1, width), np.array(m.tolist(), bool).reshape(-1, width), rounds)[0]))

    out = matrix.withColumn("__y", filled("__x", "__m"))
    return out.withColumns({c: F.coalesce(c, F.get("__y", F.lit(j)) * spread[i] + stats[f"m{i}"]) for j, (i, c) in enumerate(use)}).select(*df.columns)


def _lines(df: DataFrame, columns: list[str], time: str) -> DataFrame:
    """`__start<i>`: the column on the line between its neighbours in time."""
    from .timeseries import impute

    raw = df.withColumns({f"__start{i}": F.col(c) for i, c in enumerate(columns)})
    return impute(raw, [f"__start{i}" for i in range(len(columns))], time, [], "linear")
