"""Which columns, relationships and datasets go on: filters by name and small rules on the driver."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of columns that stand for the target, of text columns of time, and of columns that name a row's origin.
TARGET_PROXIES = r"(lat\d+|min|mean)"
TIME_TEXT = ("dt", "datetime")
IDENTITY = ("sample_key", "user_id", "sample_id", "target_y", "target_z", "antenna_id")


def bare(name: str) -> str:
    """A column's name without its table."""
    return re.split(r"[./]|__", name)[-1]


def time_column(columns: list[str], key: str | None) -> str | None:
    """The column of that name, else the first prefixed one that ends with it."""
    if not key:
        return None
    return key if key in columns else next((c for c in columns if c != bare(c) and bare(c) == key), None)


def drop_join_keys(df: DataFrame, keys: list[str], time: str | None = None) -> DataFrame:
    """Without the keys of its joins, but with the time column."""
    kept = time_column(df.columns, time)
    return df.drop(*[k for k in keys if k != kept])


def strip_target_proxies(df: DataFrame, target: str | None = None) -> DataFrame:
    """Without columns that measure the same as a latency target."""
    return df.drop(*[c for c in df.columns if c != target and re.fullmatch(TARGET_PROXIES, c)])


def strip_time_text(df: DataFrame) -> DataFrame:
    """Without times that are written out."""
    return df.drop(*[f.name for f in df.schema if f.name in TIME_TEXT and isinstance(f.dataType, T.StringType)])


def above(df: DataFrame, column: str = "lat99", least: float = 1000) -> DataFrame:
    """Rows whose value is above `least`; null isn't."""
    return df.where(F.col(column) > least)


def drop_identity(df: DataFrame, target: str) -> DataFrame:
    """Without columns that name a row's origin, but with the target."""
    return df.drop(*[c for c in IDENTITY if c != target])


def touching(relationships: DataFrame, base: str) -> DataFrame:
    """Relationships of which one side is the base table."""
    return relationships.where((F.col("left_table") == base) | (F.col("right_table") == base))


def datasets(registry: DataFrame, labels: list[str] | None = None, problem: str | None = None) -> DataFrame:
    """Datasets of some labels and of a kind of problem: regression, or classification for every other type."""
    out = registry.where(F.col("label").isin(*labels)) if labels else registry
    regression = F.coalesce(F.col("dataset_type") == "regression", F.lit(False))
    return out if problem is None else out.where(regression if problem == "regression" else ~regression)


def shown_path(path: str, root: str) -> str:
    """A path below the root without it; of others the last part only."""
    p, r = PurePosixPath(path), PurePosixPath(root)
    return str(p.relative_to(r)) if p.is_relative_to(r) else p.name
