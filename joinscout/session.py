"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(app: str = "joinscout", master: str | None = None, **conf: str) -> SparkSession:
    """UTC timestamps and adaptive execution; other settings come from the cluster or `conf`."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new place under the folder that driver and executors share (spark.checkpoint.dir); on a local master without one a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="joinscout-")
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/joinscout/{name}-{uuid.uuid4().hex[:12]}"
