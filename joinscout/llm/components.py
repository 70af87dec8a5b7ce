"""Connected components of a distributed edge list, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); the root is the smallest node of its component.

    Every round's edges are written to the shared folder, so lineage stays short. A node's neighbours are met by a
    minimum, which is taken before they move, and by a join that can be split.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    stars = scratch.save(stars, "edges")
    state = _state(stars)
    while state[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(large)
        scratch.drop(stars)
        stars, before, state = after, state, _state(after)
        if state == before:
            break
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
