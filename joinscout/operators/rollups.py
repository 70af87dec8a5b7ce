"""Roll-ups of result tables: means, pivots, lift, best rows, comparisons and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import source_table


def mean_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}")).orderBy(*keys)


def pivot_scores(df: DataFrame, row: str, column: str, names: list[str], value: str) -> DataFrame:
    """One column for each named value; the mean where there are several rows."""
    return df.groupBy(row).pivot(column, names).agg(F.avg(value))


def lift(df: DataFrame, keys: list[str], column: str, base: str, value: str) -> DataFrame:
    """Each row's difference to the base row of its keys; null without one."""
    bases = df.where(F.col(column) == base).groupBy(*keys).agg(F.max(value).alias("base_value"))
    return df.join(bases, keys, "left").withColumn("lift", F.col(value) - F.col("base_value"))


def best_per_group(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The row of the largest value of each group, ties to the smaller `tie`; the group is reduced where it lies."""
    rest = [c for c in df.columns if c not in (*keys, value, tie)]
    entry = F.struct((-F.col(value)).alias("__v"), F.col(tie), F.col(value), *rest)
    best = df.groupBy(*keys).agg(F.min(entry).alias("__e"))
    return best.select(*keys, *[F.col(f"__e.{c}").alias(c) for c in df.columns if c not in keys])


def compare(df: DataFrame, keys: list[str], name: str, base: str, full: str) -> DataFrame:
    """Differences and reductions against the base and the full approach of the same keys; a divisor of 0 gives null."""
    w = Window.partitionBy(*keys)
    of = lambda who, c: F.max(F.when(F.col(name) == who, F.col(c))).over(w)
    out = df.withColumns({f"base_{c}": of(base, c) for c in ("r2", "rmse")} | {f"full_{c}": of(full, c) for c in ("r2", "rmse", "n_features", "total_time")})
    less = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.nullif(F.col(a), F.lit(0)))
    error = lambda a: F.try_divide((1 - F.col(a)) - (1 - F.col("r2")), F.nullif(1 - F.col(a), F.lit(0.0)))
    return out.withColumns(
        {
            "delta_base": F.col("r2") - F.col("base_r2"),
            "delta_full": F.col("r2") - F.col("full_r2"),
            "error_reduction_base": error("base_r2"),
            "error_reduction_full": error("full_r2"),
            "rmse_reduction_base": less("base_rmse", "rmse"),
            "rmse_reduction_full": less("full_rmse", "rmse"),
            "feature_reduction_full": 1 - F.try_divide(F.col("n_features"), F.nullif(F.col("full_n_features"), F.lit(0))),
            "speedup_full": F.try_divide(F.col("full_total_time"), F.nullif(F.col("total_time"), F.lit(0.0))),
        }
    )


def source_tally(features: DataFrame, feature: str, importance: str, n: int) -> DataFrame:
    """How many of the n most important features come from each table."""
    top = features.orderBy(F.desc(F.abs(F.col(importance))), feature).limit(n)
    return top.groupBy(source_table(F.col(feature)).alias("source_table")).agg(F.count(F.lit(1)).alias("n"))


def feature_counts(df: DataFrame, keys: list[str], feature: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(feature).alias("n_features"))


def with_feature_counts(results: DataFrame, features: DataFrame, keys: list[str], feature: str) -> DataFrame:
    """Results with `n_features`: their own number where they have one, else how many features the other table has for their keys, else 0. Null keys meet."""
    counts = feature_counts(features, keys, feature).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("n_features").alias("__n"))
    own = F.col("n_features") if "n_features" in results.columns else F.lit(None)
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return results.join(counts, on, "left").withColumn("n_features", F.coalesce(own.cast("long"), F.col("__n"), F.lit(0))).drop("__n", *[f"__{k}" for k in keys])


def group_median(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.median(c).alias(f"median_{c}") for c in columns])


def normalised(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Min-max and mean-centred values within each group; 0 where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi, mean = F.min(value).over(w), F.max(value).over(w), F.avg(value).over(w)
    x = F.col(value)
    return df.withColumns({"min_max": F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)), "centred": F.coalesce(F.try_divide(x - mean, hi - lo), F.lit(0.0))})


def keep_last(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Union where of rows with the same key the one of the largest `order` stays, a new one before an old one."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "__new"]
    best = both.groupBy(key).agg(F.max(F.struct(order, "__new", *[c for c in columns if c not in (key, order)])).alias("__e"))
    return best.select(*[F.col(key) if c == key else F.col(f"__e.{c}").alias(c) for c in columns])


def ordered(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows in the order of named values, others last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(column)), F.lit(0).cast("long")), F.lit(len(names) + 1).cast("long"))
    return df.withColumn("place", place).orderBy("place")


def sensitivity(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias("best"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
