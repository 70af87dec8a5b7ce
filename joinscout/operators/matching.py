"""Matching of columns by several measures at once, and candidates by the embedding of their names.

Columns are rows here: a table's columns are measured in one pass over it, and everything after that grows with columns and with pairs that have
something in common, not with all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import name_column

KEY = ["left_table", "left_column", "right_table", "right_column"]

# ---- the cube of similarities ----

#: Weights of the measures; a pair's score is their mean over those that can tell.
WEIGHTS = {"name": 0.35, "words": 0.15, "type": 0.1, "statistics": 0.15, "values": 0.25}
# Families of types.
FAMILIES = {"byte": "number", "short": "number", "integer": "number", "long": "number", "float": "number", "double": "number", "decimal": "number", "boolean": "truth", "string": "text", "date": "time", "timestamp": "time", "timestamp_ntz": "time"}


def column_traits(df: DataFrame, table: str, approximate: bool = True) -> DataFrame:
    """table, column, name (normalised), dtype, family, and of the column's values: filled, distinct (their part, by an approximate count unless said), and for numbers mean and
    spread, for text length, digits and letters (parts of all characters); null where they don't apply. One pass over the table."""
    n = F.count(F.lit(1))
    measures: list[Column] = []
    for i, c in enumerate(df.columns):
        family = FAMILIES.get(df.schema[c].dataType.typeName(), "other")
        x, t = F.col(c), F.col(c).cast("string") if family in ("text", "truth") else F.lit(None).cast("string")
        number = x.cast("double") if family == "number" else F.unix_micros(x.cast("timestamp")) / 1e6 if family == "time" else F.lit(None).cast("double")
        number = F.nullif(number, F.lit(float("nan")))
        length = F.sum(F.length(t))
        part = lambda pattern: F.try_divide(F.sum(F.length(F.regexp_replace(t, pattern, ""))), length)  # noqa: B023, E731
        measures += [
            F.try_divide(F.count(x), n).alias(f"filled{i}"), F.least(F.lit(1.0), F.try_divide(F.approx_count_distinct(x, 0.01) if approximate else F.count_distinct(x), F.count(x))).alias(f"distinct{i}"), F.avg(number).alias(f"mean{i}"), F.stddev_pop(number).alias(f"spread{i}"),
            F.avg(F.length(t)).alias(f"length{i}"), part("[^0-9]").alias(f"digits{i}"), part(r"[^\p{L}]").alias(f"letters{i}"),
        ]
    flat = df.agg(*measures)
    rows = [
        F.struct(
            F.lit(table).alias("table"), F.lit(c).alias("column"), name_column(F.lit(c)).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.lit(FAMILIES.get(df.schema[c].dataType.typeName(), "other")).alias("family"), *[F.col(f"{m}{i}").alias(m) for m in ("filled", "distinct", "mean", "spread", "length", "digits", "letters")],
        )
        for i, c in enumerate(df.columns)
    ]
    return flat.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def grams(name: Column) -> Column:
    """Distinct runs of three characters of a name between blanks."""
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def _alike(a: Column, b: Column) -> Column:
    """1 for equal numbers, towards 0 the more they differ for their size; null if one is."""
    size = F.abs(a) + F.abs(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - F.abs(a - b) / size)


def _mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of those that aren't null; null if all are."""
    total = reduce(lambda x, y: x + y, [F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in parts])
    return F.try_divide(reduce(lambda x, y: x + y, [F.coalesce(p * w, F.lit(0.0)) for p, w in parts]), total)


def least_name(threshold: float, weights: dict[str, float]) -> float:
    """The name similarity that a pair without a common value needs for `threshold`, if all else is perfect."""
    rest = weights["words"] + weights["type"]
    without = sum(weights.values()) - weights["statistics"]  # pairs of which no statistics tell have the smaller total
    needs = [(threshold * total - got) / weights["name"] for total, got in ((without + weights["statistics"], rest + weights["statistics"]), (without, rest))]
    return min(needs) - 1e-5  # scores are rounded


def name_candidates(traits: DataFrame, least: float) -> DataFrame:
    """Pairs of columns of two tables whose names may be alike by `least` or more, none lost: they share one of the rarest runs of characters of both.

    A run is the rarer the fewer columns have it. Sets of a and b runs with a Dice of s share s / (2 - s) * a at least, so one of the
    first a - that + 1 runs of either set in the order of rarity is among them; only these are joined.
    """
    runs = traits.select("table", "column", F.explode(grams(F.col("name"))).alias("run"))
    often = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    ranked = runs.join(often, "run")
    w = Window.partitionBy("table", "column")  # runs of one name
    ranked = ranked.withColumns({"place": F.row_number().over(w.orderBy("n", "run")), "size": F.count(F.lit(1)).over(w)})
    kept = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * (least / (2 - least)) - 1e-9) + 1)
    a = kept.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), "run")
    b = kept.select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), "run")
    return a.join(b, "run").where("left_table < right_table").select(*KEY).distinct()


def similarity_cube(traits: DataFrame, overlap: DataFrame, threshold: float, weights: dict[str, float] | None = None) -> DataFrame:
    """KEY, a column a measure, and score: pairs of columns of two tables that reach `threshold`, all of them.

    overlap: value_jaccard of the tables. name is the Dice of runs of three characters, words the Jaccard of the names' words, type 1 for
    the same type, 0.7 within a family and else 0, statistics the mean likeness of what column_traits measures (null between families), values the
    larger part of one column's distinct values that the other has (0 without a common value).
    """
    weights = weights or WEIGHTS
    least = least_name(threshold, weights)
    if not 0 < least:
        raise ValueError(f"threshold {threshold} can be reached without anything in common; take a larger one")
    sides = {s: traits.select(*[F.col(c).alias(f"{s}_{c}") for c in traits.columns]) for s in ("left", "right")}
    pairs = overlap.select(*KEY).unionByName(name_candidates(traits, min(least, 1.0))).distinct()
    wide = pairs.join(overlap.select(*KEY, F.greatest(F.col("common") / F.col("left_n"), F.col("common") / F.col("right_n")).alias("values")), KEY, "left")
    wide = wide.join(sides["left"], ["left_table", "left_column"]).join(sides["right"], ["right_table", "right_column"])
    a, b = grams(F.col("left_name")), grams(F.col("right_name"))
    p, q = F.split("left_name", "_"), F.split("right_name", "_")
    same = F.col("left_family") == F.col("right_family")
    traits_of = ("filled", "distinct", "mean", "spread", "length", "digits", "letters")
    likeness = F.when(same, _mean([(_alike(F.col(f"left_{m}"), F.col(f"right_{m}")), 1.0) for m in traits_of]))
    cube = wide.select(
        *KEY,
        (2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).alias("name"),
        (F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))).alias("words"),
        F.when(F.col("left_dtype") == F.col("right_dtype"), 1.0).when(same, 0.7).otherwise(0.0).alias("type"),
        likeness.alias("statistics"),
        F.coalesce("values", F.lit(0.0)).alias("values"),
    )
    return cube.withColumn("score", F.round(_mean([(F.col(m), w) for m, w in weights.items()]), 6)).where(F.col("score") >= threshold)


def select_matches(cube: DataFrame, margin: float = 0.05) -> DataFrame:
    """The cube with `within`, whether a pair is within `margin` of the best of both its columns, seen from the left and from the right, and `chosen`:
    it is the best of both (ties by name), so a column has at most one chosen partner in each other table."""
    left = Window.partitionBy("left_table", "left_column", "right_table")
    right = Window.partitionBy("right_table", "right_column", "left_table")
    near = (F.col("score") >= F.max("score").over(left) - margin) & (F.col("score") >= F.max("score").over(right) - margin)
    first = (F.row_number().over(left.orderBy(F.desc("score"), "right_column")) == 1) & (F.row_number().over(right.orderBy(F.desc("score"), "left_column")) == 1)
    return cube.withColumns({"within": near, "chosen": first})


def composite_matches(tables: dict[str, DataFrame], overlap: DataFrame, threshold: float = 0.55, margin: float = 0.05, weights: dict[str, float] | None = None, approximate: bool = True) -> DataFrame:
    """Matches of the columns of all tables: select_matches of their cube, those within the margin."""
    traits = reduce(DataFrame.unionByName, [column_traits(df, name, approximate) for name, df in tables.items()])
    return select_matches(similarity_cube(traits, overlap, threshold, weights), margin).where("within")


# ---- candidates by embedding ----

#: Columns of a tile's side, and of the sample that cells' centres come from.
TILE, CENTRES_FROM = 2048, 10_000


def embedded(columns: DataFrame, encoder: Callable[[str], list[float]]) -> DataFrame:
    """columns(table, column, text, ...) with `vector`, made in the tasks."""

    @F.pandas_udf("array<double>")
    def encode(text):
        return text.map(encoder)

    return columns.withColumn("vector", encode("text"))


def centres(vectors, cells: int, rounds: int = 8):
    """Unit centres of groups of unit vectors, from evenly spaced ones on."""
    import numpy as np

    out = vectors[np.linspace(0, len(vectors) - 1, min(cells, len(vectors))).astype(int)]
    for _ in range(rounds):
        own = (vectors @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), out)
    return out


def _cells_of(centre, probes: int, names: list[str]):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = np.argsort(-(v @ centre.T), axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(n).take(row) for n in names], pa.array(near.ravel().astype(np.int32))], names=[*names, "cell"])

    return run


def _tile(least: float):
    def run(a, b):
        import numpy as np
        import pyarrow as pa

        x, y = (t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, 1)) for t in (a, b))
        if not len(a) or not len(b):
            i = j = np.zeros(0, np.int64)
            cosine = np.zeros(0)
        else:
            sims = x @ y.T
            i, j = np.nonzero(sims >= least)
            cosine = sims[i, j]
        i, j = pa.array(i), pa.array(j)
        return pa.table({"t": a.column("table").take(i), "c": a.column("column").take(i), "u": b.column("table").take(j), "d": b.column("column").take(j), "cosine": pa.array(cosine)})

    return run


def embedding_pairs(columns: DataFrame, least: float, cells: int | None = None, probes: int = 4) -> DataFrame:
    """KEY and cosine of columns(table, column, vector: unit) of two tables whose cosine is `least` or more.

    cells: vectors are listed under their `probes` nearest of so many centres (taken from a bounded sample), and only columns that share a list are compared; a
    pair whose lists have nothing in common is lost, so measure it with `recall`. Without cells all are compared, exactly. Either way the cosine is that of
    the vectors themselves, and a list is cut into tiles, so a long one is many tasks, which return what reaches `least` and no more.
    """
    import numpy as np

    rows = columns.select("table", "column", "vector")
    if cells:
        some = rows.orderBy(F.xxhash64("table", "column"), "table", "column").limit(CENTRES_FROM).collect()
        if not some:
            return rows.sparkSession.createDataFrame([], ", ".join(f"{k} string" for k in KEY) + ", cosine double")
        centre = centres(np.array([r.vector for r in some], float), cells)
        listed = rows.mapInArrow(_cells_of(centre, probes, rows.columns), "table string, column string, vector array<double>, cell int")
    else:
        listed = rows.withColumn("cell", F.lit(0))
    sizes = listed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    listed = listed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("table", "column"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = listed.withColumn("other", F.explode(F.filter(others, lambda j: j >= F.col("block")))).select("cell", F.col("block").alias("i"), F.col("other").alias("j"), "table", "column", "vector")
    b = listed.withColumn("other", F.explode(F.filter(others, lambda i: i <= F.col("block")))).select("cell", F.col("other").alias("i"), F.col("block").alias("j"), "table", "column", "vector")
    tile = ["cell", "i", "j"]
    b = b.toDF(*b.columns)  # columns of its own
    met = a.groupBy(*tile).cogroup(b.groupBy(*tile)).applyInArrow(_tile(least), "t string, c string, u string, d string, cosine double").where("t <> u")
    swap = F.col("t") > F.col("u")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    out = met.select(pick("t", "u").alias("left_table"), pick("c", "d").alias("left_column"), pick("u", "t").alias("right_table"), pick("d", "c").alias("right_column"), "cosine")
    return out.groupBy(*KEY).agg(F.max("cosine").alias("cosine"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, n_found, recall: the part of the exact pairs that are among those found."""
    hit = exact.select(*KEY).join(found.select(*KEY, F.lit(1).alias("hit")), KEY, "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_found"), F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("recall"))


