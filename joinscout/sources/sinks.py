"""Where results go."""

from __future__ import annotations

import json
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import keep_last


def augmented_name(label: str, path: str) -> str:
    """A file name that a label and a join path always have."""
    return f"{label}_{sha1(path.encode()).hexdigest()[:12]}"


def write_augmented(df: DataFrame, folder: str, label: str, path: str, kind: str = "parquet") -> str:
    place = f"{folder.rstrip('/')}/{augmented_name(label, path)}.{kind}"
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(place) if kind == "csv" else writer.format(kind).save(place)
    return place


def write_results(spark: SparkSession, rows: list[dict], folder: str, label: str) -> dict[str, str]:
    """Raw results, their summary, and a row a feature importance."""
    raw = spark.createDataFrame([{**r, "features": r.get("features", []), "importance": r.get("importance", {})} for r in rows], "approach string, algorithm string, score double, n_features long, total_time double, features array<string>, importance map<string, double>")
    out = {}
    for name, df in {
        "raw": raw,
        "summary": raw.drop("features", "importance"),
        "features": raw.selectExpr("approach", "algorithm", "explode(importance) as (feature, importance)"),
    }.items():
        out[name] = f"{folder.rstrip('/')}/{label}_{name}.parquet"
        df.write.mode("overwrite").parquet(out[name])
    return out


def append_upsert(spark: SparkSession, path: str, rows: DataFrame, key: str = "run_id", order: str = "time") -> DataFrame:
    """Add rows to a table of runs; a run that is there already is replaced. Versions lie beside each other and the newest whose write has ended is read.

    For one writer at a time: of two that begin at the same version the later one's rows are kept.
    """
    import time

    versions = f"{path.rstrip('/')}/v="
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ended = lambda p: files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    old = max((s.getPath().getName() for s in files.listStatus(there) if ended(s.getPath())), default=None) if files.exists(there) else None
    merged = keep_last(spark.read.parquet(f"{path.rstrip('/')}/{old}"), rows, key, order) if old else rows
    place = f"{versions}{time.time_ns():020d}"
    merged.write.parquet(place)
    return spark.read.parquet(place)


def write_json(spark: SparkSession, data: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(data, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_windows(windows: DataFrame, folder: str, label: str) -> str:
    """Windows and predictions with their arrays, as Parquet."""
    place = f"{folder.rstrip('/')}/{label}_windows.parquet"
    windows.write.mode("overwrite").parquet(place)
    return place


def write_forecasts(forecasts: DataFrame, folder: str, label: str, by: list[str]) -> str:
    """Forecasts in long form, a row a series, window and method: by, start, y, method and prediction, in a folder a method."""
    methods = [c for c in forecasts.columns if c == "prediction" or c.startswith("naive_")]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("prediction")) for m in methods])).alias("c")
    place = f"{folder.rstrip('/')}/{label}_forecasts.parquet"
    forecasts.select(*by, "start", "y", cells).select(*by, "start", "y", "c.*").write.mode("overwrite").partitionBy("method").parquet(place)
    return place
