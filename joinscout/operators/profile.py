"""Column summaries, quality checks and guesses about a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import numeric_clean

# Parts of a column name that hint at time.
TIME_HINTS = ("time", "timestamp", "ts", "datetime", "date", "epoch", "captured_at", "event_time", "created_at")


def _stacked(df: DataFrame, one: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate of all columns' measures, then a row a column."""
    names = list(next(iter(one.values())))
    flat = df.agg(*[m.alias(f"{k}_{i}") for i, ms in enumerate(one.values()) for k, m in ms.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in names]) for i, c in enumerate(one)])
    return flat.select(F.explode(rows).alias("r")).select("r.*")


def sampled(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows by `order`, for a look at a table before the whole of it is profiled; the limit is the feature. Each task keeps n rows."""
    return df.orderBy(*order).limit(n)


def describe(df: DataFrame, columns: list[str] | None = None, approximate: bool = True) -> DataFrame:
    """column, n_rows, n_unique, n_null, is_constant, cardinality_ratio; one pass over the table.

    Exact counts of distinct values send every row once a column through a shuffle; approximate ones (the default) are off by about 5 % and tell a constant exactly.
    """
    n = F.count(F.lit(1))

    def count(x: Column) -> Column:
        if not approximate:
            return F.count_distinct(x)
        # as many as values at most; one is told by the ends
        near = F.least(F.approx_count_distinct(x), F.count(x))
        return F.when(F.min(x).eqNullSafe(F.max(x)), F.least(F.count(x), F.lit(1).cast("long"))).otherwise(F.greatest(near, F.lit(2).cast("long")))

    rows = _stacked(df, {c: {"n_rows": n, "n_unique": count(F.col(c)), "n_null": F.count(F.when(F.col(c).isNull(), 1))} for c in columns or df.columns})
    return rows.withColumns({"is_constant": F.col("n_unique") <= 1, "cardinality_ratio": F.coalesce(F.try_divide(F.col("n_unique"), F.col("n_rows")), F.lit(0.0))})


def candidate_join_keys(df: DataFrame, top_k: int = 5, approximate: bool = True) -> DataFrame:
    """The non-constant columns of lowest cardinality ratio, ties by name."""
    return describe(df, approximate=approximate).where("not is_constant").select("column", "cardinality_ratio").orderBy("cardinality_ratio", "column").limit(top_k)


#: Slabs of a column's values, cut at approximate quantiles.
SLABS = 256


def exact_percentiles(df: DataFrame, columns: list[str], parts: list[int]) -> DataFrame:
    """column and p<part> of each part of 100, interpolated between neighbours as by `percentile`.

    Values are counted and cut into slabs of about as many distinct ones; a slab's count tells whether a wanted rank is in it, and only such slabs are put in
    order, so no task holds a whole column.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    counts = df.select(F.explode(cells).alias("c")).select("c.*").where("x is not null").groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.groupBy("column").agg(F.percentile_approx("x", [i / SLABS for i in range(1, SLABS)], 2000).alias("q"))
    placed = counts.join(F.broadcast(cuts), "column").withColumn("slab", F.size(F.filter("q", lambda c: c <= F.col("x")))).drop("q")  # a row a column
    whole = Window.partitionBy("column")  # a row a slab
    sums = placed.groupBy("column", "slab").agg(F.sum("n").alias("sn"))
    sums = sums.withColumns({"before": F.sum("sn").over(whole.orderBy("slab")) - F.col("sn"), "total": F.sum("sn").over(whole)})
    at = {p: (F.col("total") - 1) * (p / 100) for p in parts}
    ranks = {p: (F.floor(x), F.ceil(x)) for p, x in at.items()}
    hit = reduce(lambda a, b: a | b, [(r >= F.col("before")) & (r < F.col("before") + F.col("sn")) for both in ranks.values() for r in both])
    rows = placed.join(F.broadcast(sums.where(hit)), ["column", "slab"])  # at most two slabs a part
    rows = rows.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("column", "slab").orderBy("x")))
    of = lambda r: F.max(F.when((r < F.col("upto")) & (r >= F.col("upto") - F.col("n")), F.col("x")))
    found = rows.groupBy("column", "total").agg(*[of(r).alias(f"{e}{p}") for p, both in ranks.items() for e, r in zip("lh", both, strict=True)])
    between = {p: (ranks[p][1] - at[p]) * F.col(f"l{p}") + (at[p] - ranks[p][0]) * F.col(f"h{p}") for p in parts}
    return found.select("column", *[F.when(ranks[p][0] == ranks[p][1], F.col(f"l{p}")).otherwise(between[p]).alias(f"p{p}") for p in parts])


def numeric_profile(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """column, mean, std, min, p50, p95, p99, max, missing_ratio; percentiles are approximate (a ten-thousandth of the ranks) unless `exact`, which counts all values."""
    n = F.count(F.lit(1))
    parts = [50, 95, 99]

    def of(c: str) -> dict[str, Column]:
        x = F.col(c).cast("double")
        q = {} if exact else {f"p{p}": F.percentile_approx(x, p / 100, 10_000) for p in parts}
        return {"mean": F.avg(x), "std": F.stddev(x), "min": F.min(x), **q, "max": F.max(x), "missing_ratio": 1 - F.try_divide(F.count(x), n)}

    out = _stacked(df, {c: of(c) for c in columns})
    if exact:
        out = out.join(exact_percentiles(df, columns, parts), "column", "left")
    return out.select("column", "mean", "std", "min", *[f"p{p}" for p in parts], "max", "missing_ratio")


def parse_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, parsed: the part of all rows whose value reads as a number."""
    return _stacked(df, {c: {"parsed": F.avg(numeric_clean(F.col(c)).isNotNull().cast("double"))} for c in columns})


def feature_columns(df: DataFrame, time: str | None, target: str | None, least: float = 0.2) -> list[str]:
    """Columns besides time and target of which at least a fifth reads as numbers."""
    names = [c for c in df.columns if c not in (time, target)]
    good = {r.column for r in parse_ratios(df, names).where(F.col("parsed") >= least).collect()} if names else set()
    return [c for c in names if c in good]


def quality_summary(df: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """By group: rows, first and last time, unparsed times, whether times are unique and go up in the given order."""
    key = F.unix_micros(F.col(time).cast("timestamp")) if df.schema[time].dataType.typeName().startswith(("timestamp", "date")) else F.col(time).try_cast("double")
    rows = df.withColumn("__k", key)
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(
        n.alias("n_rows"), F.min("__k").alias("first"), F.max("__k").alias("last"), (n - F.count("__k")).alias("n_unparsed"), (F.count_distinct("__k") == F.count("__k")).alias("is_unique")
    )


def is_monotonic(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """By group: whether values never fall in the given order."""
    falls = F.col(value) < F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__f", F.coalesce(falls.cast("int"), F.lit(0))).groupBy(*by).agg((F.max("__f") == 0).alias("is_monotonic"))


def expectations(df: DataFrame, required: list[str], not_null: list[str], unique: list[str], least_rows: int = 1) -> DataFrame:
    """check, column, passed: row count, columns that exist, are never null, are unique, and none that is all null."""
    n = F.count(F.lit(1))
    checks: list[tuple[str, str, Column]] = [("row_count", "", n >= least_rows)]
    checks += [("exists", c, F.max(F.lit(c in df.columns))) for c in required]
    checks += [("not_null", c, F.count(F.col(c)) == n) for c in not_null if c in df.columns]
    checks += [("unique", c, F.count_distinct(F.col(c)) == F.count(F.col(c))) for c in unique if c in df.columns]
    checks += [("no_all_null", "", reduce(lambda a, b: a & b, [(F.count(F.col(c)) > 0) for c in df.columns]))]
    flat = df.agg(*[F.coalesce(x, F.lit(False)).alias(f"c{i}") for i, (_, _, x) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), F.col(f"c{i}").alias("passed")) for i, (k, c, _) in enumerate(checks)])
    return flat.select(F.explode(rows).alias("r")).select("r.*")


def problem_type(df: DataFrame, target: str) -> str:
    """binary up to two levels, multiclass up to 20 of whole numbers, text or booleans, else regression."""
    levels = df.agg(F.count_distinct(F.col(target))).first()[0]
    kind = df.schema[target].dataType
    if levels == 0:
        return "regression"
    if levels <= 2:
        return "binary"
    if levels <= 20 and isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType)):
        return "multiclass"
    return "regression"


def temporal_key(df: DataFrame) -> str | None:
    """The first time column, else the first numeric one whose name hints at time."""
    for f in df.schema:
        if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
            return f.name
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType) and any(h in f.name.lower() for h in TIME_HINTS):
            return f.name
    return None


def diagnose(df: DataFrame, target: str) -> dict:
    """Problem type, time key, join keys, and what stands in the way of a run."""
    errors, warnings = [], []
    if target not in df.columns:
        return {"errors": [f"no column {target}"], "warnings": [], "problem_type": None, "temporal_key": temporal_key(df), "join_keys": []}
    stats = {r.column: r for r in describe(df).collect()}
    if stats[target].n_rows == 0:
        errors.append("no rows")
    elif stats[target].n_unique <= 1:
        errors.append(f"{target} is constant")
    if stats[target].n_null:
        warnings.append(f"{target} has {stats[target].n_null} nulls")
    if len(df.columns) > 200:
        warnings.append(f"{len(df.columns)} columns")
    keys = [r.column for r in candidate_join_keys(df).collect()]
    return {"errors": errors, "warnings": warnings, "problem_type": problem_type(df, target), "temporal_key": temporal_key(df), "join_keys": keys}
