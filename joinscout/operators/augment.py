"""Augmentation of training rows and windows, and how alike two samples are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(seed: int, *parts: Column) -> Column:
    """A uniform number in (0, 1): 48 bits of an MD5 of its parts alone, so repeated tasks (and other engines) give the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _normal(seed: int, *parts: Column) -> Column:
    return F.sqrt(-2 * F.log(unit(seed, *parts))) * F.cos(2 * 3.141592653589793 * unit(seed + 1, *parts))


def poisson_steps(ratio: float) -> list[float]:
    """The distribution function of a Poisson number at 0, 1, 2, ..., until it is 1 to the last bit of a 48-bit number."""
    term, below, out = math.exp(-ratio), 0.0, []
    while True:
        below += term
        out.append(below)
        term *= ratio / len(out)
        if len(out) > ratio and term < 2.0**-56:
            return out


#: A Poisson number of a mean above this is the sum of several, as the steps of one would start below the smallest double.
PART = 16.0


def _times(seed: int, key: Column, ratio: float) -> Column:
    """How often a row is drawn when n * ratio draws with replacement fall on n rows: a Poisson number, from uniform ones."""
    parts = max(1, math.ceil(ratio / PART))
    steps = F.array(*[F.lit(x) for x in poisson_steps(ratio / parts)])
    out = F.lit(0)
    for p in range(parts):
        u = unit(seed, key) if p == 0 else unit(seed, key, F.lit(f"part{p}"))
        out = out + _reached(steps, u)
    return out


def _reached(steps: Column, u: Column) -> Column:
    return F.size(F.filter(steps, lambda x: x <= u))


def augment_rows(df: DataFrame, columns: list[str], key: str, kind: str, ratio: float = 0.5, strength: float = 0.05, seed: int = 42) -> DataFrame:
    """Training rows and synthetic ones after them (`is_synthetic`), drawn with replacement, `ratio` times the rows in the mean.

    jitter adds noise of `strength` times a column's spread, scaling multiplies by about 1, time_mask blanks a run of neighbouring columns
    and magnitude_mask single cells (to null); other columns, the target too, are copied. none adds nothing.
    """
    if kind == "none":
        return df.withColumn("is_synthetic", F.lit(False))
    k = F.concat_ws("#", F.col(key).cast("string"), F.col("__copy").cast("string"))
    drawn = df.withColumn("__n", _times(seed, F.col(key), ratio)).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    if kind == "jitter":
        spread = df.agg(*[F.coalesce(F.stddev(c), F.lit(0.0)).alias(f"s_{i}") for i, c in enumerate(columns)])
        drawn = drawn.crossJoin(F.broadcast(spread))  # one row
        new = {c: F.col(c) + _normal(seed + 2 + 7 * i, k) * strength * F.col(f"s_{i}") for i, c in enumerate(columns)}
    elif kind == "scaling":
        new = {c: F.col(c) * (1 + strength * _normal(seed + 2 + 7 * i, k)) for i, c in enumerate(columns)}
    elif kind == "time_mask":
        width = max(1, int(len(columns) * strength))
        first = F.floor(unit(seed + 3, k) * (len(columns) - width + 1))
        new = {c: F.when((F.lit(i) < first) | (F.lit(i) >= first + width), F.col(c)) for i, c in enumerate(columns)}
    elif kind == "magnitude_mask":
        new = {c: F.when(unit(seed + 4 + i, k) >= strength, F.col(c)) for i, c in enumerate(columns)}
    else:
        raise ValueError(f"kind {kind!r}")
    made = drawn.withColumns(new).select(*df.columns, F.lit(True).alias("is_synthetic"))
    return df.withColumn("is_synthetic", F.lit(False)).unionByName(made)


def augment_windows(df: DataFrame, window: str, key: str, kind: str, strength: float = 0.05, seed: int = 42) -> DataFrame:
    """The same on arrays, one for each: scaling by one factor a window, time_mask over a run of its time axis; what is masked is null."""
    k, w = F.col(key), F.col(window)
    n = F.size(w)
    if kind == "jitter":
        mean = F.aggregate(w, F.lit(0.0), lambda s, x: s + x) / n
        spread = F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + (x - mean) ** 2) / n)
        new = F.transform(w, lambda x, i: x + _normal(seed, k, i) * strength * spread)
    elif kind == "scaling":
        new = F.transform(w, lambda x: x * (1 + strength * _normal(seed, k)))
    elif kind == "time_mask":
        width = F.greatest(F.lit(1), F.floor(n * strength))
        first = F.floor(unit(seed, k) * (n - width + 1))
        new = F.transform(w, lambda x, i: F.when((i < first) | (i >= first + width), x))
    elif kind == "magnitude_mask":
        new = F.transform(w, lambda x, i: F.when(unit(seed, k, i) >= strength, x))
    else:
        raise ValueError(f"kind {kind!r}")
    return df.withColumn(window, new)


#: Slabs of a column's values, cut at approximate quantiles.
SLABS = 256


def distribution_distance(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(column, ks, wasserstein) of each column's two empirical distributions.

    A column's distinct values are cut into slabs of about equal numbers. Sums run within a slab and are carried from slab to slab by one row each, so a column of many
    values isn't put in order in one task.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    rows = a.select(F.explode(cells).alias("c"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.explode(cells).alias("c"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = rows.select("c.column", "c.x", "a", "b").where("x is not null").groupBy("column", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cuts = counts.groupBy("column").agg(F.percentile_approx("x", [i / SLABS for i in range(1, SLABS)], 2000).alias("q"))  # a row a column
    placed = counts.join(F.broadcast(cuts), "column").withColumn("slab", F.size(F.filter("q", lambda c: c <= F.col("x")))).drop("q")
    over = Window.partitionBy("column").orderBy("slab")  # a row a slab
    before = lambda c: F.coalesce(F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("column")
    sums = placed.groupBy("column", "slab").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("x").alias("lo"))
    sums = sums.select("column", "slab", before("sa").alias("ba"), before("sb").alias("bb"), F.sum("sa").over(whole).alias("ta"), F.sum("sb").over(whole).alias("tb"), F.lead("lo").over(over).alias("next"))
    inside = Window.partitionBy("column", "slab").orderBy("x")
    rows = placed.withColumns({"ia": F.sum("a").over(inside), "ib": F.sum("b").over(inside), "up": F.lead("x").over(inside)}).join(sums, ["column", "slab"])
    gap = F.abs(F.try_divide(F.col("ba") + F.col("ia"), F.col("ta")) - F.try_divide(F.col("bb") + F.col("ib"), F.col("tb")))
    gaps = rows.select("column", gap.alias("gap"), (F.coalesce("up", "next") - F.col("x")).alias("width"))
    return gaps.groupBy("column").agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * F.col("width")), F.lit(0.0)).alias("wasserstein"))


def correlation_delta(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, delta): how far each pair's correlation differs."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]

    def of(df: DataFrame, name: str) -> DataFrame:
        flat = df.agg(*[F.corr(x, y).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
        rows = F.array(*[F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), F.col(f"c{i}").alias(name)) for i, (x, y) in enumerate(pairs)])
        return flat.select(F.explode(rows).alias("r")).select("r.*")

    return of(a, "p").join(of(b, "q"), ["left", "right"]).select("left", "right", F.abs(F.col("p") - F.col("q")).alias("delta"))
