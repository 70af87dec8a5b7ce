"""Random forests for the importance of features, all forests of several rounds grown together.

The same forests as pyspark.ml's (20 trees, five levels, 32 bins, a bootstrap of the rows for each tree, a third or the root of the features tried at a node),
which keep an object a row and tree on disk or in memory. Here a row is written once, as a byte a column, and a tree's draws of it are hashes made anew
in each pass. A level of all trees is one job: tasks add up sums a bin, and a row a node reaches the driver. Cuts come from all rows' quantiles.
Tables with few distinct rows are counted first; a row that occurs n times is drawn as often as n rows are, and each tree is grown in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_dir
from .trees import candidates

TREES, DEPTH, BINS = 20, 5, 32
#: Quantiles that tell a column's values; if they are fewer than BINS, each has a bin.
FINE = 1024
#: Values of the distinct rows that a task may hold, so trees are grown in one task; rows of a piece that sums are made of otherwise.
PIECE, CHUNK = 4_000_000, 1 << 16
COUNT, ROW, ID, Y = "__n", "__row", "__id", "__y"
#: Poisson(1) by 16 bits of a hash.
DRAWS = np.searchsorted(np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 13)])]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def condensed(df: DataFrame, columns: list[str], target: str, width: int) -> tuple[DataFrame, bool]:
    """Columns and target as numbers (null for NaN) of the rows that have a target, with their count COUNT; and whether distinct rows, `width` values each, are few. If not, rows stay as they are."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    rows = df.select(*map(number, columns), number(target)).where(F.col(target).isNotNull())
    distinct = rows.agg(F.approx_count_distinct(F.xxhash64(*rows.columns), 0.02)).first()[0]
    if distinct * (width + 2) > PIECE:
        return rows.withColumn(COUNT, F.lit(1)), False
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(COUNT)), True


def cut_points(quantiles: list[float] | np.ndarray | None) -> tuple[np.ndarray, float]:
    """Where a column is cut, from its FINE - 1 quantiles (none, if it has no value), and its median: it is cut at each of its values, or if they are many at every FINE / BINS-th quantile."""
    if quantiles is None:
        return np.zeros(0), 0.0
    some = np.unique(quantiles)
    return some if len(some) < BINS else np.unique(np.asarray(quantiles)[FINE // BINS - 1 :: FINE // BINS]), float(quantiles[FINE // 2 - 1])


def binned(x: np.ndarray, cuts: np.ndarray, median: float) -> np.ndarray:
    """The bin of each value, the number of cuts below it; NaN is the median."""
    return np.searchsorted(cuts, np.where(np.isnan(x), median, x)).astype(np.int8)


def weighted_quantiles(x: np.ndarray, n: np.ndarray) -> np.ndarray | None:
    known = ~np.isnan(x)
    x, n = x[known], n[known]
    order = np.argsort(x, kind="stable")
    below = np.cumsum(n[order])
    return x[order][np.searchsorted(below, np.arange(1, FINE) * (below[-1] / FINE))] if len(x) else None


class Tree:
    """Cuts by heap number (root 1); a node without one sends all its rows to the left, to a child that isn't open."""

    def __init__(self, seed: int, tree: int, width: int, tried: int):
        self.seed, self.tree, self.width, self.m = seed, tree, width, tried
        self.feature, self.cut, self.level = np.zeros(1 << DEPTH, np.int64), np.full(1 << DEPTH, BINS, np.int64), 0
        self.open, self.gains = np.ones(1, bool), np.zeros(width)
        self.tried = self._tried()

    def _tried(self) -> np.ndarray:
        first = 1 << self.level
        return np.array([sorted(candidates(self.seed, self.tree, first + i, self.width, self.m)) if o else [0] * self.m for i, o in enumerate(self.open)], np.int64)

    def slots(self, flat: np.ndarray, start: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The place among the level's nodes of each row; `place` tells where a feature stands in a row."""
        at, column = np.ones(len(start), np.int64), place.take(self.feature)
        for _ in range(self.level):
            at = 2 * at + (flat.take(start + column.take(at)) > self.cut.take(at))
        return at - (1 << self.level)

    def sums(self, flat: np.ndarray, start: np.ndarray, place: np.ndarray, drawn: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
        """Rows and sums of `ys` a node, tried feature and bin, of open nodes."""
        slot = self.slots(flat, start, place)
        by = np.flatnonzero((drawn > 0) & self.open.take(slot))
        slot, start, n = slot.take(by), start.take(by), len(self.open)
        w = drawn.take(by).astype(float)
        parts, base, columns = [w, *[w * y.take(by) for y in ys]], slot * BINS, place.take(self.tried)
        out = np.zeros((len(parts), n, self.m, BINS))
        for j in range(self.m):
            to = base + flat.take(start + columns[:, j].take(slot))
            for k, p in enumerate(parts):
                out[k, :, j] = np.bincount(to, weights=p, minlength=n * BINS).reshape(n, BINS)
        return out

    def grow(self, best: list[tuple[int, int, int, float]]) -> None:
        """Cut the level's nodes: (node's place, tried feature's place, bin, gain), and go on to the next."""
        n = len(self.open)
        cut = np.zeros(n, bool)
        for i, j, b, gain in best:
            f = self.tried[i, j]
            self.feature[n + i], self.cut[n + i], cut[i] = f, b, True
            self.gains[f] += gain
        self.level, self.open = self.level + 1, np.repeat(cut, 2)
        if self.level < DEPTH:
            self.tried = self._tried()


def best_cuts(sums: np.ndarray, regression: bool) -> list[tuple[int, int, int, float]]:
    """For each node that a cut makes purer the best: how much the squares about the mean, or rows times Gini impurity, fall."""
    sums = sums.astype(float)
    left = np.cumsum(sums, axis=3)
    whole = left[..., -1:]
    left = left[..., :-1]

    def score(a: np.ndarray) -> np.ndarray:
        squares = (a[1:] ** 2).sum(0) + (0.0 if regression else (a[0] - a[1:].sum(0)) ** 2)
        return squares / np.maximum(a[0], 1.0)

    parts = score(left) + score(whole - left)
    gain = parts - score(whole)
    gain[(left[0] < 1) | (whole[0] - left[0] < 1) | (gain <= 1e-12 * parts)] = 0.0
    out = []
    for i, g in enumerate(gain):
        j, b = divmod(int(g.argmax()), BINS - 1)
        if g[j, b] > 0:
            out.append((i, j, b, float(g[j, b])))
    return out


def _drawn(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row, four trees from a hash."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + tree // 4 * 0x2545F4914F6CDD1D) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return DRAWS.take(x.view(np.uint16)[tree % 4 :: 4])


def _classes(lowest: float, highest: float, whole: bool) -> int:
    if lowest < 0 or not whole:
        raise ValueError("labels of a classification must be 0, 1, 2, ...")
    return int(highest) + 1


def _parts(y: np.ndarray, classes: int) -> list[np.ndarray]:
    return [y == k for k in range(1, classes)] if classes else [y]


def _bytes(column: pa.BinaryArray, width: int) -> np.ndarray:
    """All bytes of a column of binaries of one width."""
    _, ends, data = column.buffers()
    first = int(np.frombuffer(ends, np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(data, np.int8, len(column) * width, first) if len(column) else np.zeros(0, np.int8)


def importances(rows: DataFrame, few: bool, target: str, forests: list[list[str]], seeds: list[int], regression: bool = True) -> list[dict[str, float]]:
    """For each forest, a list of columns, the importance of each: its share of the trees' gains. `rows` and `few` are of `condensed`; labels of a classification are 0, 1, 2, ..."""
    columns = list(dict.fromkeys(c for f in forests for c in f))
    places = [np.array([columns.index(c) for c in f], np.int64) for f in forests]
    tried = lambda f: max(1, int(np.ceil(len(f) / 3 if regression else len(f) ** 0.5)))
    trees = [Tree(seeds[r], t, len(f), tried(f)) for r, f in enumerate(forests) for t in range(TREES)]
    gains = _grown_here(rows, target, columns, places, trees, regression) if few else _grown(rows, target, columns, places, trees, regression)
    out = []
    for r, f in enumerate(forests):
        each = [g / g.sum() for g in gains[r * TREES : (r + 1) * TREES] if g.sum() > 0]
        total = np.sum(each, axis=0) / len(each) if each else np.zeros(len(f))
        out.append(dict(zip(f, total.tolist(), strict=True)))
    return out


def _grown_here(rows: DataFrame, target: str, columns: list[str], places: list[np.ndarray], trees: list[Tree], regression: bool) -> list[np.ndarray]:
    """Gains of trees that are each grown in one task, of at most about PIECE values."""
    spark = rows.sparkSession
    found = rows.select(*columns, target, COUNT).toArrow()
    x = np.stack([found[c].to_numpy() for c in range(len(columns) + 2)]) if len(found) else np.zeros((len(columns) + 2, 0))
    x = x.astype(float)[:, np.lexsort(x)]
    if not x.shape[1]:
        return [t.gains for t in trees]
    n, y = x[-1].astype(np.int64), x[-2]
    classes = 0 if regression else _classes(y.min(), y.max(), bool((y == np.floor(y)).all()))
    ys = _parts(y - (y * n).sum() / n.sum() if regression else y.astype(np.int64), classes)
    flat = np.stack([binned(v, *cut_points(weighted_quantiles(v, n))) for v in x[:-2]], axis=1).ravel()
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.arange(len(n)) * width
        for batch in batches:
            for i in batch.column(0).to_pylist():
                tree = trees[i]
                drawn = np.random.default_rng([tree.seed, tree.tree]).poisson(n)
                for _ in range(DEPTH):
                    tree.grow(best_cuts(tree.sums(flat, start, places[i // TREES], drawn, ys), regression))
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([tree.gains.tolist()], pa.list_(pa.float64()))], names=["tree", "gains"])

    tasks = min(len(trees), spark.sparkContext.defaultParallelism)
    got = spark.range(0, len(trees), 1, tasks).mapInArrow(run, "tree long, gains array<double>").collect()
    return [np.array(r.gains) for r in sorted(got, key=lambda r: r.tree)]


def _grown(rows: DataFrame, target: str, columns: list[str], places: list[np.ndarray], trees: list[Tree], regression: bool) -> list[np.ndarray]:
    """Gains of trees that are grown level by level, on rows written once as a byte a column."""
    spark = rows.sparkSession
    at = F.array(*[F.lit(i / FINE) for i in range(1, FINE)])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean"), F.min(target).alias("lo"), F.max(target).alias("hi"), F.bool_and(F.col(target) == F.floor(target)).alias("whole"), *[F.percentile_approx(c, at, 4 * FINE).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    cuts = [cut_points(stats[f"q{i}"]) for i in range(len(columns))]
    classes = 0 if regression else _classes(stats.lo, stats.hi, stats.whole)
    # whole units of the target's distance to its mean, so that sums don't depend on their order
    unit = (stats.hi - stats.lo) / (1 << min(30, 60 - int(stats.n).bit_length())) or 1.0
    scaled = F.round((F.col(target) - stats.mean) / unit) if regression else F.col(target)
    width = len(columns)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.stack([binned(batch.column(i).to_numpy(zero_copy_only=False), *c) for i, c in enumerate(cuts)], axis=1)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * width
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([packed, batch.column(width), batch.column(width + 1)], names=[ROW, Y, ID])

    schema = f"{ROW} binary, {Y} long, {ID} long"
    path = work_dir(spark, "forests")
    rows.select(*columns, scaled.cast("long").alias(Y), F.monotonically_increasing_id().alias(ID)).mapInArrow(to_bins, schema).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    kinds = classes or 2

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((kinds, len(t.open), t.m, BINS), np.int64) for t in trees]

        def add(some: list[pa.RecordBatch]) -> None:
            piece = pa.Table.from_batches(some)
            flat = np.concatenate([_bytes(b.column(0), width) for b in some])
            y, ids, start = piece[Y].to_numpy(), piece[ID].to_numpy(), np.arange(len(piece)) * width
            ys = _parts(y, classes)
            for i, t in enumerate(trees):
                if t.open.any():
                    totals[i] += t.sums(flat, start, places[i // TREES], _drawn(ids, t.seed, t.tree), ys).astype(np.int64)

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + len(batch)
            if size >= CHUNK:
                add(held)
                held, size = [], 0
        if size:
            add(held)
        for i, t in enumerate(trees):
            if t.open.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([totals[i].tobytes()], pa.binary())], names=["tree", "sums"])

    def best(group: pa.Table) -> pa.Table:
        i = group["tree"][0].as_py()
        total = np.zeros((kinds, len(trees[i].open), trees[i].m, BINS), np.int64)
        for chunk in group["sums"].chunks:
            for s in chunk:
                total += np.frombuffer(s.as_buffer(), np.int64).reshape(total.shape)
        found = best_cuts(total, regression)
        return pa.table([pa.array([i] * len(found), pa.int64()), *[pa.array([f[c] for f in found], k) for c, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]], names=["tree", "node", "feature", "bin", "gain"])

    for _ in range(DEPTH):
        chosen: list[list] = [[] for _ in trees]
        for r in table.mapInArrow(level, "tree long, sums binary").groupBy("tree").applyInArrow(best, "tree long, node long, feature long, bin long, gain double").collect():  # a row a node
            chosen[r.tree].append((r.node, r.feature, r.bin, r.gain))
        for t, c in zip(trees, chosen, strict=True):
            t.grow(sorted(c))
    return [t.gains for t in trees]
