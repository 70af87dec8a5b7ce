"""Exact top-k by inner product: ball trees over shards, searched by branch and bound.

Shards are files of bounded size in the shared folder, each with its vectors in the order of a ball tree's leaves and the
nodes' centres and radii. A search task holds a block of queries and goes over the shards; a node can hold no
score above q.c + |q| r, so children are visited in falling order of that bound and left out where it is below the query's current k-th
score, which goes along from leaf to leaf and from shard to shard. Shards hold neighbouring vectors and are opened in falling order of the bound of
their root, which stands in the manifest; those that can't have a better score for any query of the block aren't opened.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .sstable import _filesystem

#: Vectors a shard and a leaf, queries a block, and depth down to which each query has its own order of children.
SHARD, LEAF, BLOCK, OWN_ORDER = 16_384, 128, 256, 3
#: Centres that vectors are dealt to shards by, and sampled vectors for each.
CELLS, SAMPLED = 1024, 16


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component; null if the vector is null or has a null, NaN or infinite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(wide, lambda x: F.floor(F.lit(scale) * x).cast("long")))


def matrix(column, kind: type = np.int64) -> np.ndarray:
    """An Arrow column of lists as a matrix; shorter vectors are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(lengths.max()) if len(lengths) else 0), kind)
    if len(lengths) and (lengths == out.shape[1]).all():
        return values.reshape(out.shape).astype(kind)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


class BallTree:
    """Nodes in preorder: centre, radius, rows [first, end) and the right child (0 in a leaf); the left child comes next."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        centres, radii, spans, right = [], [], [], []

        def build(first: int, end: int) -> int:
            me = len(radii)
            part = vectors[order[first:end]].astype(np.float64)
            centre = part.mean(0)
            centres.append(centre)
            radii.append(float(np.sqrt(((part - centre) ** 2).sum(1).max())))
            spans.append((first, end))
            right.append(0)
            if end - first > LEAF:
                axis = int(np.argmax(part.var(0))) if part.shape[1] else 0
                middle = (end - first) // 2
                if part.shape[1]:
                    order[first:end] = order[first:end][np.argpartition(part[:, axis], middle, kind="introselect")]
                build(first, first + middle)
                right[me] = build(first + middle, end)
            return me

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii, self.spans, self.right = np.array(centres), np.array(radii), np.array(spans), np.array(right)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> BallTree:
        tree = object.__new__(BallTree)
        with np.load(io.BytesIO(raw)) as f:
            vars(tree).update({k: f[k] for k in f.files})
        return tree


class Search:
    """The k best of a block of queries so far; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.seen = 0

    def bound(self, tree: BallTree, node: int, who: np.ndarray) -> np.ndarray:
        """The largest whole score a node can have, with room for rounding."""
        c = tree.centres[node]
        b = self.qf[who] @ c + self.norm[who] * tree.radii[node]
        return np.floor(b + 1e-6 * (1 + np.abs(b)))

    def over(self, tree: BallTree) -> None:
        width = max(self.q.shape[1], tree.vectors.shape[1])
        q = np.pad(self.q, ((0, 0), (0, width - self.q.shape[1])))
        v = np.pad(tree.vectors, ((0, 0), (0, width - tree.vectors.shape[1])))
        tree.centres = np.pad(tree.centres, ((0, 0), (0, width - tree.centres.shape[1])))
        most = width * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0))
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # products and sums stay exact
        self.qf, self.qx, self.v = q.astype(np.float64), q.astype(kind), v.astype(kind)
        everyone = np.arange(len(self.ids))
        self._visit(tree, 0, everyone, self.bound(tree, 0, everyone), 0)

    def _visit(self, tree: BallTree, node: int, who: np.ndarray, bound: np.ndarray, depth: int) -> None:
        live = bound >= self.score[who, -1]
        who = who[live]
        if not len(who):
            return
        if not tree.right[node]:
            self._leaf(tree, node, who)
            return
        left, right = node + 1, int(tree.right[node])
        a, b = self.bound(tree, left, who), self.bound(tree, right, who)
        first = a >= b if depth < OWN_ORDER else np.full(len(who), bool(a.mean() >= b.mean()))
        for side in (first, ~first):
            if side.any():
                x, y = (left, a[side]), (right, b[side])
                for child, limit in (x, y) if side is first else (y, x):
                    self._visit(tree, child, who[side], limit, depth + 1)

    def _leaf(self, tree: BallTree, node: int, who: np.ndarray) -> None:
        first, end = tree.spans[node]
        self.seen += len(who) * int(end - first)
        ids = tree.ids[first:end]
        score = (self.qx[who] @ self.v[first:end].T).astype(np.int64)
        own = ids[None, :] == self.ids[who][:, None]
        better = (score >= self.score[who, -1][:, None]) & ~own
        some = better.any(1)
        who, score, better = who[some], score[some], better[some]
        if not len(who):
            return
        low = np.iinfo(np.int64).min
        s = np.concatenate([self.score[who], np.where(better, score, low)], 1)
        i = np.concatenate([self.found[who], np.where(better, ids[None, :], np.iinfo(np.int64).max)], 1)
        take = np.lexsort((i, -np.maximum(s, low + 1)), axis=1)[:, : self.k]
        self.score[who], self.found[who] = np.take_along_axis(s, take, 1), np.take_along_axis(i, take, 1)


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """At most `cells` centres of a sample, by halving it along its widest axis again and again."""
    todo, out = [sample.astype(np.float64)], []
    while todo:
        part = todo.pop(0)
        if len(part) < 2 or len(todo) + len(out) + 1 >= cells:
            out.append(part.mean(0))
            continue
        axis = int(np.argmax(part.var(0))) if part.shape[1] else 0
        order = np.argsort(part[:, axis], kind="stable") if part.shape[1] else np.arange(len(part))
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return np.array(out)


def nearest_cell(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors(id, v) and the number of the centre that each is nearest to."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x = matrix(part.column("v")).astype(np.float64)
                width = max(x.shape[1], centres.shape[1])
                c = np.pad(centres, ((0, 0), (0, width - centres.shape[1])))
                x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                cell = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    return vectors.mapInArrow(run, "id long, v array<long>, cell int")


def write_trees(spark: SparkSession, vectors: DataFrame, shard: int = SHARD) -> tuple[DataFrame, np.ndarray]:
    """Ball trees of vectors(id, v) as files in the shared folder: the manifest (path, n, centre, radius), a row a tree, and the centres the trees were dealt by.

    Vectors are dealt by the nearest of at most CELLS centres of a bounded sample, so a tree lies together in space; a cell of more vectors than a shard has
    is cut by hash. The centres only decide what lies where: bounds make every answer exact whatever they are.
    """
    scratch = Scratch(spark, "balltree")
    folder = scratch.folder("trees")
    cells = max(1, min(CELLS, -(-vectors.count() // shard)))
    found = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLED * cells).select("v").collect() if cells > 1 else []  # at most SAMPLED * CELLS vectors
    width = max((len(r.v) for r in found), default=0)
    centres = centres_of(np.array([[*r.v, *[0] * (width - len(r.v))] for r in found], np.float64).reshape(len(found), width), cells) if found else np.zeros((1, 0))
    dealt = scratch.save(nearest_cell(vectors, centres), "cells")
    sizes = dealt.groupBy("cell").count().collect()  # at most CELLS rows
    cuts = F.create_map(*[F.lit(x) for r in sizes for x in (r.cell, -(-r["count"] // shard))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = dealt.withColumn("cut", F.pmod(F.xxhash64("id", F.lit(2)), F.element_at(cuts, F.col("cell"))).cast("int"))
    parts = max(1, sum(-(-r["count"] // shard) for r in sizes))

    def run(batches):
        import pyarrow as pa

        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        at_cell = None

        def flush():
            width = max(r.shape[1] for r in rows)
            tree = BallTree(np.concatenate(ids), np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]))
            name = f"{uuid.uuid4().hex}.npz"
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(tree.to_bytes())
            kinds = (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.float64())
            values = (f"{folder}/{name}", len(tree.ids), tree.centres[0].tolist(), float(tree.radii[0]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["path", "n", "centre", "radius"])

        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("cell", "cut")], 1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                if first == end:
                    continue
                if ids and (tuple(place[first]) != at_cell or sum(map(len, ids)) + end - first > 2 * shard):
                    yield flush()
                    ids, rows = [], []
                at_cell = tuple(place[first])
                ids.append(batch.column("id").slice(first, end - first).to_numpy())
                rows.append(matrix(batch.column("v").slice(first, end - first)))
        if ids:
            yield flush()

    trees = dealt.repartition(parts, "cell", "cut").sortWithinPartitions("cell", "cut", "id").mapInArrow(run, "path string, n long, centre array<double>, radius double")
    return scratch.save(trees, "manifest"), centres


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, block: int = BLOCK, report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query over all vectors but those of its own id.

    vectors and queries have id and v (whole numbers); rows with a null in either take no part. Ties go to the smaller id; with fewer than
    k others all are returned. Vectors of different length are compared as if filled up with zeros. Of rows that repeat an id each is a
    candidate, and each such query has its own answer. Empty tables give an empty result. With `report` a last column `shards` says how many trees the query's block opened.
    """
    good = F.col("id").isNotNull() & F.col("v").isNotNull()
    manifest, centres = write_trees(spark, vectors.where(good).select(F.col("id").cast("long").alias("id"), "v"), shard)
    place = manifest.scratch_path
    asked = nearest_cell(queries.where(good).select(F.col("id").cast("long").alias("id"), "v"), centres)
    parts = max(1, -(-asked.count() // block))

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, root = _filesystem(place)
        shards = pq.read_table(root, filesystem=files)
        paths, radii = shards.column("path").to_pylist(), shards.column("radius").to_numpy()
        roots = matrix(shards.column("centre").combine_chunks(), np.float64) if len(paths) else np.zeros((0, 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * block):
                part = batch.slice(at, 2 * block)
                search = Search(part.column("id").to_numpy(), matrix(part.column("v")), k)
                width = max(search.q.shape[1], roots.shape[1])
                q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (search.q.astype(np.float64), roots))
                bound = q @ c.T + search.norm[:, None] * radii
                bound = np.floor(bound + 1e-6 * (1 + np.abs(bound)))  # as Search.bound, with room for rounding
                opened = 0
                for i in np.argsort(-bound.max(0), kind="stable").tolist():
                    if (bound[:, i] < search.score[:, -1]).all():
                        continue
                    opened += 1
                    with files.open_input_file(_filesystem(paths[i])[1]) as f:
                        search.over(BallTree.from_bytes(f.read()))
                hit = search.found < np.iinfo(np.int64).max
                who, rank = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(search.ids[who]), pa.array((rank + 1).astype(np.int32)), pa.array(search.found[hit]), pa.array(search.score[hit]), pa.array(np.full(len(who), opened, np.int32))],
                    names=["query_id", "rank", "vec_id", "score", "shards"],
                )

    near = asked.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")  # queries that lie together are searched together
    out = near.mapInArrow(run, "query_id long, rank int, vec_id long, score long, shards int")
    return out if report else out.drop("shards")
