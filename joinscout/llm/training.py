"""Labelled rows, all or bounded samples, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def labelled_rows(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of every id outside the held-out fold.

    Ids with contradicting labels, null ids and labels other than 0 and 1 are left out; repeated rows count once.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id"))
    return rows.agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").select("id", F.col("label").cast("int").alias("label"))


def labelled_sample(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """At most per_class of the labelled rows of each class, by smallest hash of the id; and each class's count."""
    rows = labelled_rows(labels, label, id_col)
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), counts
