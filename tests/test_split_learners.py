"""What tasks of extra trees and of nearest rows do and hand on: sums once a task, leaves instead of whole chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from joinscout.operators import neighbours, trees


def test_a_task_of_extra_trees_hands_on_each_sum_once():
    draw = np.random.default_rng(1)
    x, y = draw.random((600, 3)), draw.integers(0, 1 << 20, 600).astype(float)
    batches = [pa.RecordBatch.from_arrays([pa.array(list(x[a : a + 200])), pa.array(y[a : a + 200])], names=["x", "y"]) for a in (0, 200, 400)]
    tree = {1: trees.Node((0.0,), 0, 0.5), 2: trees.Node((0.0,)), 3: trees.Node((0.0,))}
    low = x[:, 0] < 0.5
    got = [tuple(r.values()) for b in trees._ranges([tree], [{2: [0, 2], 3: [1, 2]}])(iter(batches)) for r in b.to_pylist()]
    want = [(0, i, f, x[rows, f].min(), x[rows, f].max()) for i, rows, fs in ((2, low, (0, 2)), (3, ~low, (1, 2))) for f in fs]
    assert sorted(got) == sorted(want)
    got = [tuple(r.values()) for b in trees._sums([tree], [{2: [(2, 0.3)], 3: [(1, 0.2), (2, 0.9)]}], 0)(iter(batches)) for r in b.to_pylist()]
    want = []
    for i, rows, cuts in ((2, low, [(2, 0.3)]), (3, ~low, [(1, 0.2), (2, 0.9)])):
        for c, (f, at) in enumerate(cuts):
            for side in (0, 1):
                part = [int(v) for v in y[rows & ((x[:, f] >= at) == bool(side))]]
                high = sum(v * v // trees.SPLIT for v in part)
                want += [(0, i, c, side, j, s) for j, s in enumerate((len(part), sum(part), high, sum(v * v % trees.SPLIT for v in part))) if s]
    assert sorted(got) == sorted(want)


def test_a_tile_meets_few_leaves_and_keeps_ties():
    draw = np.random.default_rng(2)
    y = np.round(draw.random((3000, 3)) * 40) / 40  # with ties
    x = np.round(draw.random((50, 3)) * 40) / 40
    d2 = ((x[:, None] - y[None]) ** 2)
    d2 = d2[..., 0] + d2[..., 1] + d2[..., 2]
    leaves = neighbours._leaves(y, [0, 1, 2])
    assert sorted(i for i in leaves.members.ravel().tolist() if i < 3000) == list(range(3000)) and leaves.members.shape[1] <= neighbours.LEAF
    dist, place = neighbours._search(x, leaves, 3000, [0, 1, 2], 4, np.full(50, np.inf))
    want = np.lexsort((np.broadcast_to(np.arange(3000), d2.shape), d2), axis=1)[:, :4]
    assert (place == want).all() and (dist == np.take_along_axis(d2, want, 1)).all()
    bound = dist[:, 1]  # those of a bound come in, farther ones needn't
    near, at = neighbours._search(x, leaves, 3000, [0, 1, 2], 4, bound)
    assert (at[:, :2] == want[:, :2]).all()
    far = np.full((1, 3), 5.0)  # a row that is farther from all than its bound is compared with none
    empty, _ = neighbours._search(far, leaves, 3000, [0, 1, 2], 4, np.array([0.01]))
    assert np.isinf(empty).all()
    tile = neighbours._tile(4)(pa.table({"__p": pa.array(range(3000)), "__x": pa.array(list(y))}), pa.table({"__q": pa.array(range(50)), "__x": pa.array(list(x)), "__bound": pa.array([None] * 50, pa.float64())}))
    assert tile.column("__p").to_pylist() == want.ravel().tolist()
