"""Joins of path prefixes, each made once: a trie of steps whose nodes are tables in the work folder, named by what they hold.

A path is its base and steps, so paths that begin alike share the tables of what they share. Search, replay, materialisation, ablations and sweeps that are given
the same trie join a prefix once between them. With a folder of its own a trie goes on where an earlier one ended; a table counts only once
its write has ended.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha1

from pyspark.sql import DataFrame

from ..operators.joins import match_ratio
from ..session import work_dir
from .paths import Step, parse


class Prefixes:
    """`start` makes the base, `join` one step (None if it can't be joined). `made` counts the tables written."""

    def __init__(self, start: Callable[[], DataFrame], join: Callable[[DataFrame, Step], DataFrame | None], name: str, folder: str | None = None):
        """name: what else the tables depend on, such as settings of the joins; it goes into their names."""
        self.start, self.join, self.name, self.folder, self.made = start, join, name, folder, 0
        self.tables: dict[str, DataFrame | None] = {}
        self.known: dict[tuple, object] = {}

    def place(self, path: str) -> str:
        return f"{self.folder}/{sha1(f'{self.name}//{path}'.encode()).hexdigest()[:20]}"

    def _kept(self, path: str, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        self.folder = self.folder or work_dir(spark, "prefixes")
        place = self.place(path)
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            df.write.mode("overwrite").parquet(place)
            self.made += 1
        return spark.read.schema(df.schema).parquet(place)

    def frame(self, path: str) -> DataFrame | None:
        """The joined table of a path; None if its last step can't be joined."""
        if path not in self.tables:
            base, steps = parse(path)
            if not steps:
                self.tables[path] = self._kept(path, self.start())
            else:
                before = self.frame("--".join([base, *map(str, steps[:-1])]))
                joined = None if before is None else self.join(before, steps[-1])
                self.tables[path] = None if joined is None else self._kept(path, joined)
        return self.tables[path]

    def matched(self, path: str, key: str) -> float:
        """The part of rows that found a partner in the last step."""
        return self.once(("matched", path), lambda: match_ratio(self.frame(path), key).first().ratio)

    def once(self, key: tuple, make: Callable[[], object]) -> object:
        """What was computed for a key, or is now."""
        if key not in self.known:
            self.known[key] = make()
        return self.known[key]
