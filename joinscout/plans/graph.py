"""The join graph: tables as nodes and weighted column pairs as edges, two small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "from_id string, to_id string, from_column string, to_column string, weight double"
KEY = ["from_id", "to_id", "from_column", "to_column"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def edges(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def upsert(graph: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both, the larger weight of one that is in both."""
    return graph.unionByName(new).groupBy(*KEY).agg(F.max("weight").alias("weight"))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """(id, label) of both, each id once: its new label if it has one."""
    both = nodes.select("id", "label", F.lit(0).alias("new")).unionByName(new.select("id", "label", F.lit(1).alias("new")))
    return both.groupBy("id").agg(F.max(F.struct("new", "label"))["label"].alias("label"))


def node(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("id") == name)


def overlaid(graph: DataFrame, made: DataFrame, method: str) -> DataFrame:
    """Edges with the way each came by: those a method has made, and those given."""
    mine = made.select(*KEY, F.lit(method).alias("method"))
    both = graph.unionByName(made).groupBy(*KEY).agg(F.max("weight").alias("weight"))
    return both.join(mine.distinct(), KEY, "left").withColumn("method", F.coalesce("method", F.lit("given")))


def undirected(graph: DataFrame) -> DataFrame:
    back = graph.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.col("to_column").alias("from_column"), F.col("from_column").alias("to_column"), "weight")
    return graph.unionByName(back)


def adjacent(graph: DataFrame, node: str) -> DataFrame:
    """(node, weight): neighbours either way, the best edge of each, heaviest first."""
    near = undirected(graph).where((F.col("from_id") == node) & (F.col("to_id") != node))
    return near.groupBy(F.col("to_id").alias("node")).agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "node")


def between(graph: DataFrame, a: str, b: str) -> DataFrame:
    """Edges from a to b, heaviest first."""
    return graph.where((F.col("from_id") == a) & (F.col("to_id") == b)).orderBy(F.desc("weight"), "from_column", "to_column")


def key_neighbours(graph: DataFrame, node: str) -> DataFrame:
    """Neighbours by edges of weight 1, as primary and foreign keys have."""
    return undirected(graph).where((F.col("from_id") == node) & (F.col("weight") == 1)).select(F.col("to_id").alias("node"), "from_column", "to_column").distinct()


def export(graph: DataFrame, part: str | None = None) -> DataFrame:
    """All edges, or those whose two ids hold `part`."""
    return graph if part is None else graph.where(F.contains("from_id", F.lit(part)) & F.contains("to_id", F.lit(part)))


def degrees(graph: DataFrame) -> DataFrame:
    return undirected(graph).groupBy(F.col("from_id").alias("node")).agg(F.count_distinct("to_id").alias("degree"))


def edge_counts(graph: DataFrame) -> DataFrame:
    return graph.groupBy("from_id").agg(F.count(F.lit(1)).alias("n"))


def filtered(graph: DataFrame, least: float = 0.0, name: str = "", top: int = 100) -> DataFrame:
    hit = graph.where(F.col("weight") >= least)
    if name:
        hit = hit.where(F.contains(F.lower("from_id"), F.lit(name.lower())) | F.contains(F.lower("to_id"), F.lit(name.lower())))
    return hit.orderBy(F.desc("weight"), *KEY).limit(top)


def reachable(graph: DataFrame, node: str, hops: int = 3) -> DataFrame:
    """(node, hops): tables within so many steps, either way, and the fewest steps to each."""
    steps = undirected(graph).select("from_id", "to_id").distinct()
    found = graph.sparkSession.createDataFrame([(node, 0)], "node string, hops int")
    edge = found
    for h in range(1, hops + 1):
        edge = edge.join(steps, edge["node"] == steps["from_id"]).select(F.col("to_id").alias("node")).distinct().withColumn("hops", F.lit(h))
        found = found.unionByName(edge)
    return found.groupBy("node").agg(F.min("hops").alias("hops")).where(F.col("node") != node)
