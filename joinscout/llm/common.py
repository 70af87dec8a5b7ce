"""Shared folder, scratch tables and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_numbers = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where it is unset (a local session, as in tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc.getCheckpointDir():
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="joinscout-")
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written under the shared folder, which cut lineage and survive lost executors."""

    #: Those made so far, for callers that know when a result is written and its tables can go.
    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        Scratch.made.append(self)
        self.path = f"{shared_dir(spark).rstrip('/')}/joinscout/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}-{next(_numbers)}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write df once and read it back."""
        path = self.folder(name)
        df.write.option("compression", compression).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def sweep(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps, which it does when the driver collects garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame | None = None) -> None:
        """Delete one table of this scratch, or all of them."""
        path = self.path if df is None else df.scratch_path
        try:
            jvm = self.spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session may be gone at exit; the folder is scratch
            if df is not None:
                raise


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, each: int) -> int:
    """Partitions of about `each` bytes of df's files, but as many as the session's shuffles have at least. Asks no executor."""
    fewest = shuffle_partitions(df.sparkSession)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return fewest if size >= 1 << 60 else max(fewest, -(-size // each))  # the optimizer's word for unknown is the largest number


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character as it is; null counts as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(c, F.lit("")), upper, upper.lower())


def held_out(doc_id: Column) -> Column:
    """Fold 0 of 5 by crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def schema_of(df: DataFrame, *names: str, **more: T.DataType) -> T.StructType:
    return T.StructType([df.schema[n] for n in names] + [T.StructField(k, v) for k, v in more.items()])
