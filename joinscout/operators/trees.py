"""Extremely randomised trees: every tree on all rows, each node cut at a random place of a few random features, grown level by level.

A level of all trees is two jobs over the rows. The first gives each node's range of its candidate features; thresholds are drawn within the
ranges, from a hash of seed, tree, node and feature. The second gives each candidate's sums on both sides, and the driver keeps the best. Rows are only
routed, never moved or rewritten; the driver holds the trees (nodes) and one level's sums (nodes x candidates), whatever the rows. Sums are added up
in whole units of 2^-20 of the target's spread, so trees are equal on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_dir


#: Sums of squares are carried as multiples of this and a rest, so that whole numbers hold them.
SPLIT = 1 << 30


class Node(NamedTuple):
    """A node's answer (one number a class, or the mean), and where it is cut, if it is."""

    answer: tuple[float, ...]
    feature: int = -1
    threshold: float = 0.0


#: Trees: a dictionary from heap numbers (root 1, then 2i and 2i + 1) to nodes.
Trees = list[dict[int, Node]]


def drawn(seed: int, *parts: int) -> float:
    """A uniform number in [0, 1) from a hash."""
    return int.from_bytes(blake2b(repr((seed, *parts)).encode(), digest_size=6).digest(), "little") / (1 << 48)


def candidates(seed: int, tree: int, node: int, width: int, tried: int) -> list[int]:
    """`tried` features, by smallest hash."""
    return sorted(range(width), key=lambda f: drawn(seed, tree, node, f, 0))[:tried]


class Flat(NamedTuple):
    """A tree as arrays over its nodes, in the order of their heap numbers; the root is at 0. A node's children stand at 2i and 2i + 1 of `child`; a leaf's are itself."""

    heap: object
    feature: object
    threshold: object
    child: object
    levels: int


def flat(tree: dict[int, Node]) -> Flat:
    import numpy as np

    heap = sorted(tree)
    place = {i: at for at, i in enumerate(heap)}
    cut = [tree[i].feature >= 0 for i in heap]
    child = [place[2 * i + side] if c else place[i] for i, c in zip(heap, cut, strict=True) for side in (0, 1)]
    return Flat(np.array(heap, np.int64), np.array([max(tree[i].feature, 0) for i in heap], np.int64), np.array([tree[i].threshold for i in heap], float), np.array(child, np.int64), heap[-1].bit_length() - 1)


def reached(tree: Flat, x):
    """The place among the tree's nodes of the leaf that each row reaches; all rows go down a level at once."""
    import numpy as np

    at, values, start = np.zeros(len(x), np.int64), x.ravel(), np.arange(len(x)) * x.shape[1]
    for _ in range(tree.levels):
        at = tree.child.take(2 * at + (values.take(start + tree.feature.take(at)) >= tree.threshold.take(at)))
    return at


def route(tree: dict[int, Node], x):
    """The heap number of the leaf that each row reaches."""
    made = flat(tree)
    return made.heap[reached(made, x)]


def _table(batch):
    import numpy as np

    y = batch.column("y").to_numpy(zero_copy_only=False)
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return (x.reshape(len(y), -1) if len(y) else np.zeros((0, 0))), y


def _slots(tree: Flat, nodes: dict[int, list]):
    """The nodes in order, and for each node of the tree its place among them (-1: it isn't one)."""
    import numpy as np

    order = sorted(nodes)
    place = {i: s for s, i in enumerate(order)}
    return order, np.array([place.get(int(i), -1) for i in tree.heap], np.int64)


def _ranges(trees: Trees, open_nodes: list[dict[int, list[int]]]):
    """(tree, node, feature, lo, hi) of a task's rows."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        work = []
        for t, nodes in enumerate(open_nodes):
            if nodes:
                tree = flat(trees[t])
                order, slots = _slots(tree, nodes)
                tried = np.array([nodes[i] for i in order], np.int64)
                work.append((t, tree, order, slots, tried, np.full(tried.shape, np.inf), np.full(tried.shape, -np.inf)))
        for batch in batches:
            x, _ = _table(batch)
            for _, tree, _, slots, tried, lo, hi in work if len(x) else []:
                slot = slots.take(reached(tree, x))
                by = np.argsort(slot.astype(np.int16) if len(tried) < 1 << 15 else slot, kind="stable")  # short numbers are sorted by radix
                slot = slot.take(by)
                first = np.searchsorted(slot, 0)
                by, slot = by[first:], slot[first:]
                if not len(by):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                here, values, start = slot[starts], x.ravel(), by * x.shape[1]
                for j in range(tried.shape[1]):
                    v = values.take(start + tried[:, j].take(slot))
                    lo[here, j] = np.minimum(lo[here, j], np.minimum.reduceat(v, starts))
                    hi[here, j] = np.maximum(hi[here, j], np.maximum.reduceat(v, starts))
        rows = [(t, i, int(f), float(low), float(high)) for t, _, order, _, tried, lo, hi in work for i, fs, ls, hs in zip(order, tried, lo, hi, strict=True) for f, low, high in zip(fs, ls, hs, strict=True) if not (low == np.inf and high == -np.inf)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*rows, strict=True)], names=["tree", "node", "feature", "lo", "hi"])

    return run


def _sums(trees: Trees, cuts: list[dict[int, list[tuple[int, float]]]], classes: int):
    """(tree, node, cut, side, j, s) of a task's rows; a side's sums are class counts, or rows, sum and sum of squares in two parts."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        work, kinds = [], classes or 4
        for t, nodes in enumerate(cuts):
            if nodes:
                tree = flat(trees[t])
                order, slots = _slots(tree, nodes)
                most = max(map(len, nodes.values()))
                padded = [[*nodes[i], *[(0, np.inf)] * (most - len(nodes[i]))] for i in order]  # a node may have fewer cuts
                feature = np.array([[f for f, _ in some] for some in padded], np.int64)
                at = np.array([[a for _, a in some] for some in padded], float)
                real = np.array([[c < len(nodes[i]) for c in range(most)] for i in order])
                work.append((t, tree, order, slots, feature, at, real, np.zeros((len(order), most, 2, kinds), np.int64)))
        for batch in batches:
            x, y = _table(batch)
            whole = y.astype(np.int64)
            square = whole * whole
            # sums of a batch's parts are below 2^53, so they are exact as doubles
            parts = [] if classes else [whole.astype(float), (square // SPLIT).astype(float), (square % SPLIT).astype(float)]
            for _, tree, order, slots, feature, at, _, total in work if len(x) else []:
                slot = slots.take(reached(tree, x))
                by = np.flatnonzero(slot >= 0)
                slot, n = slot.take(by), len(order)
                some, values, start = [p.take(by) for p in parts], x.ravel(), by * x.shape[1]
                for c in range(feature.shape[1]):
                    place = 2 * slot + (values.take(start + feature[:, c].take(slot)) >= at[:, c].take(slot))
                    if classes:
                        total[:, c] += np.bincount(place * classes + whole[by], minlength=2 * n * classes).reshape(n, 2, classes)
                    else:
                        total[:, c, :, 0] += np.bincount(place, minlength=2 * n).reshape(n, 2)
                        for j, p in enumerate(some):
                            total[:, c, :, j + 1] += np.bincount(place, weights=p, minlength=2 * n).astype(np.int64).reshape(n, 2)
        out = []
        for t, _, order, _, _, _, real, total in work:
            s, c, side, j = np.nonzero(total * real[:, :, None, None])
            out.append([np.full(len(s), t), np.array(order, np.int64)[s], c, side, j, total[s, c, side, j]])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["tree", "node", "cut", "side", "j", "s"])

    return run


def impurity(sums: list[float], classes: int) -> float:
    """Rows times Gini impurity, or squares about the mean."""
    n = sum(sums) if classes else sums[0]
    if not n:
        return 0.0
    return n - sum(s * s for s in sums) / n if classes else sums[2] - sums[1] * sums[1] / n


class ExtraTrees(Estimator):
    """Rows of a null label take no part; labels of a classification are 0, 1, 2, ... Depth counts cuts; a node of fewer than `least` rows isn't cut."""

    def __init__(self, features: str = "features", label: str = "label", regression: bool = True, seed: int = 42, trees: int = 20, depth: int = 8, least: int = 2):
        super().__init__()
        self.features, self.label, self.regression, self.seed, self.trees, self.depth, self.least = features, label, regression, seed, trees, depth, least

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        spark = dataset.sparkSession
        rows = dataset.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y")).where("y is not null")
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.max(F.size("x")).alias("width")).first()
        if not stats.n:
            return ExtraTreesModel(self, [{1: Node((0.0,))}] * self.trees, 0)
        # whole units, so that sums don't depend on their order
        unit = (stats.hi - stats.lo) / (1 << 20) or 1.0
        classes = 0 if self.regression else int(stats.hi) + 1
        scaled = F.round((F.col("y") - stats.lo) / unit) if self.regression else F.col("y")
        path = work_dir(spark, "trees")
        rows.select("x", scaled.alias("y")).write.parquet(path)
        rows = spark.read.parquet(path)
        tried = max(1, stats.width if self.regression else round(stats.width**0.5))
        trees: Trees = [{1: Node(())} for _ in range(self.trees)]
        todo: list[dict[int, list[int]]] = [{1: candidates(self.seed, t, 1, stats.width, tried)} for t in range(self.trees)]

        def answer(sums: list[float]) -> tuple[float, ...]:
            return tuple(s / sum(sums) for s in sums) if classes else (stats.lo + unit * sums[1] / sums[0],)

        first = [0.0] * (classes or 4)
        for r in rows.groupBy("y").count().collect() if classes else []:  # a row a class
            first[int(r.y)] = r["count"]
        if not classes:
            mean = rows.agg(F.sum(F.col("y").cast("long"))).first()[0]
            first = [stats.n, mean, 0, 0]
        trees = [{1: Node(answer(first))} for _ in range(self.trees)]
        for _ in range(self.depth):
            if not any(todo):
                break
            seen = rows.mapInArrow(_ranges(trees, todo), "tree long, node long, feature long, lo double, hi double").groupBy("tree", "node", "feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
            cuts: list[dict] = [{} for _ in trees]
            for r in sorted(seen):
                if r.hi > r.lo:
                    at = r.lo + (r.hi - r.lo) * drawn(self.seed, r.tree, r.node, r.feature, 1)
                    cuts[r.tree].setdefault(r.node, []).append((r.feature, at if at > r.lo else r.hi))
            sums = rows.mapInArrow(_sums(trees, cuts, classes), "tree long, node long, cut long, side long, j long, s long").groupBy("tree", "node", "cut", "side", "j").agg(F.sum("s").alias("s")).collect()
            sides: dict = {}
            for r in sums:
                sides.setdefault((r.tree, r.node), {}).setdefault(r.cut, ([0] * len(first), [0] * len(first)))[r.side][r.j] = r.s
            todo = [{} for _ in trees]
            for (t, i), found in sorted(sides.items()):
                if not classes:
                    found = {c: tuple([s[0], s[1], s[2] * SPLIT + s[3]] for s in both) for c, both in found.items()}
                c, (below, above) = min(sorted(found.items()), key=lambda x: sum(impurity(s, classes) for s in x[1]))
                n = [sum(s) if classes else s[0] for s in (below, above)]
                if not all(n) or sum(n) < self.least:
                    continue
                f, at = cuts[t][i][c]
                trees[t][i] = trees[t][i]._replace(feature=int(f), threshold=float(at))
                for child, s, m in ((2 * i, below, n[0]), (2 * i + 1, above, n[1])):
                    trees[t][child] = Node(answer(s))
                    pure = max(s) == m if classes else impurity(s, 0) < 1
                    if m >= self.least and not pure:
                        todo[t][child] = candidates(self.seed, t, child, stats.width, tried)
        return ExtraTreesModel(self, trees, classes)


class ExtraTreesModel(Model):
    """The mean of the trees' answers; the class of the largest mean part, the smallest of several."""

    def __init__(self, of: ExtraTrees, trees: Trees, classes: int):
        super().__init__()
        self.of, self.trees, self.classes = of, trees, classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        import numpy as np
        import pyarrow as pa

        classes = self.classes
        whole = [(flat(t), np.array([t[i].answer for i in sorted(t)], float)) for t in self.trees]

        @F.arrow_udf("double")
        def predicted(x):
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
            total = np.zeros((len(rows), max(classes, 1)))
            for made, answers in whole:
                total += answers[reached(made, rows)]
            return pa.array(total.argmax(1).astype(float) if classes else total[:, 0] / len(whole))

        return dataset.withColumn("prediction", predicted(vector_to_array(self.of.features)))
