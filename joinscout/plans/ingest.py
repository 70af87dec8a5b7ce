"""Connections into the join graph: given ones, and those that discovery finds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery, matching
from . import graph
from .search import Lake


def relationships(lake: Lake, descriptions: dict[str, dict[str, str]] | None = None, time: str = "time") -> DataFrame:
    """Every pair of columns of two tables with role and confidence; tables that both have the time column are aligned by it."""
    descriptions = descriptions or {}
    profiles = reduce(DataFrame.unionByName, [discovery.column_profiles(df, name, descriptions.get(name)) for name, df in lake.tables.items()])
    timed = sorted(n for n, df in lake.tables.items() if time in df.columns)
    aligned = []
    for i, a in enumerate(timed):
        for b in timed[i + 1 :]:
            one = discovery.time_alignment(lake.tables[a], lake.tables[b], time, time)
            aligned.append(one.select(F.lit(a).alias("left_table"), F.lit(b).alias("right_table"), "recommended", "match_ratio", "median_delta"))
    times = reduce(DataFrame.unionByName, aligned) if aligned else None
    return discovery.infer_relationships(profiles, discovery.value_jaccard(discovery.all_values(lake.tables)), times)


def edges_of(recommended: DataFrame) -> DataFrame:
    """Recommended pairs as edges from the second table to the first, weighted by confidence."""
    return recommended.select(F.col("fk_table").alias("from_id"), F.col("pk_table").alias("to_id"), F.col("fk_column").alias("from_column"), F.col("pk_column").alias("to_column"), F.col("confidence").alias("weight"))


def discover(lake: Lake, least: float = 0.55, method: str = "hybrid") -> Lake:
    """The lake with its graph and the edges found: by names and values (hybrid), by schema and values, by min-hashes, or by several measures (composite)."""
    if method == "hybrid":
        found = edges_of(discovery.recommend(relationships(lake), least))
    else:
        values = discovery.all_values(lake.tables)
        if method == "minhash":
            pairs = discovery.minhash_edges(values, least).withColumnRenamed("jaccard", "score")
        elif method == "schema":
            pairs = discovery.schema_matches(lake.graph.sparkSession, {t: dict(df.dtypes) for t, df in lake.tables.items()}, discovery.value_jaccard(values), schema_least=least)
        elif method == "composite":
            pairs = matching.composite_matches(lake.tables, discovery.value_jaccard(values), least).where("chosen").select(*matching.KEY, "score")
        else:
            raise ValueError(f"method {method!r}")
        found = pairs.select(F.col("left_table").alias("from_id"), F.col("right_table").alias("to_id"), F.col("left_column").alias("from_column"), F.col("right_column").alias("to_column"), F.col("score").alias("weight"))
    return Lake(lake.tables, graph.upsert(lake.graph, found), lake.order)
