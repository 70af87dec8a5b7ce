"""Datasets and result files by their registry and manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import read_csv

#: Columns of a result file that has no summary.
RAW = ("data_label", "approach", "algorithm", "accuracy", "rmse", "mae", "n_features", "train_time", "total_time")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """label, path, name, target_column, dataset_type, temporal_key, temporal_tolerance (60 if none) of a registry file."""
    df = read_csv(spark, path)
    optional = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), F.lit(other)) if c in df.columns else F.lit(other).cast(kind)
    return df.select(
        F.col("base_table_label").alias("label"), F.col("base_table_path").alias("path"), F.col("base_table_name").alias("name"), "target_column",
        F.when(F.col("dataset_type").isin("regression", "multiclass"), F.col("dataset_type")).otherwise("binary").alias("dataset_type"),
        optional("temporal_key", "string", None).alias("temporal_key"), optional("temporal_tolerance", "long", 60).alias("temporal_tolerance"),
    )


def union_results(summaries: list[DataFrame], raws: list[DataFrame] = (), allowed: list[str] | None = None) -> DataFrame:
    """One table of result summaries, of the manifest's scenarios if they are given; raw files stand in for scenarios without a summary.

    Of a raw file the first row by total_time of each approach and algorithm counts. Columns that a file lacks are null.
    """
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)
    for raw in raws:
        some = raw.select(*[c for c in RAW if c in raw.columns]).withColumnRenamed("data_label", "scenario")
        rest = [c for c in some.columns if c not in ("scenario", "approach", "algorithm", "total_time")]
        least = some.groupBy("scenario", "approach", "algorithm").agg(F.min(F.struct("total_time", *rest)).alias("e"))
        first = least.select("scenario", "approach", "algorithm", "e.*")
        out = out.unionByName(first.join(out.select("scenario").distinct(), "scenario", "left_anti"), allowMissingColumns=True)
    return out.where(F.col("scenario").isin(*allowed)) if allowed else out
