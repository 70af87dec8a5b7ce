"""Structured Streaming forms of the batch operators: sessions by gap, tumbling windows, stream-static augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap, as gap_segments has them in batch."""
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed(stream: DataFrame, time: str, by: list[str], value: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = stream.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return rows.select(*by, F.col("window.start").alias("start"), "n", "mean")


def deduplicated(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def augmented(stream: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A stream with the columns of a static lake table that has one row a key."""
    return stream.join(table, keys, "left")
