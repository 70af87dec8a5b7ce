"""Left joins of a base table with lake tables: exact many-to-one, as-of within a tolerance, and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A column that gives base rows their order.
ROW = "__row_id"
#: Slabs of time that an as-of join is cut into, a multiple of 16.
SLABS = 256


def first_per_key(right: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row of each key, the first by `order`; rows with a null key are left out.

    Whole rows are compared as one struct by a minimum, so a key with very many rows is reduced where they lie.
    """
    rest = [c for c in right.columns if c not in keys]
    rank = [F.col(o) if isinstance(o, str) else o for o in order]
    entry = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(rank)], *[F.col(c).alias(f"__c{i}") for i, c in enumerate(rest)])
    good = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    least = right.where(good).groupBy(*keys).agg(F.min(entry).alias("__e"))
    return least.select(*keys, *[F.col("__e")[f"__c{i}"].alias(c) for i, c in enumerate(rest)]).select(*right.columns)


def exact_left_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, order: list[str | Column] | None = None) -> DataFrame | None:
    """Left join on keys of different names, both kept; None if their types differ.

    With `order` the right side is first reduced to one row a key, so the join never multiplies base rows.
    """
    if left.schema[left_on].dataType != right.schema[right_on].dataType:
        return None
    if order is not None:
        right = first_per_key(right, [right_on], order)
    return left.join(right, left[left_on] == right[right_on], "left")


def left_join_on(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Left join on keys of the same names, kept once; optionally null keys meet null keys."""
    if not null_safe:
        return left.join(right, keys, "left")
    own = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(own[f"__{k}"]) for k in keys])
    return left.join(own, on, "left").drop(*[f"__{k}" for k in keys])


def fold_joins(base: DataFrame, tables: dict[str, DataFrame], key: str, tolerance: float | None = None, order: str | None = None) -> DataFrame:
    """Left joins with several tables in turn, their columns prefixed by table: exact (fan-out stays, nulls meet), or as-of if `order` is given."""
    out = base
    for name, table in tables.items():
        prefixed = table.withColumnsRenamed({c: f"{name}__{c}" for c in table.columns if c != key})
        if order is None:
            out = left_join_on(out, prefixed, [key], null_safe=True)
        else:
            out = asof_join(out, prefixed, key, key, tolerance=tolerance, order=f"{name}__{order}").drop(f"__right_{key}")
    return out


def direct_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, suffix: str = "_b") -> DataFrame:
    """Primary-foreign key left join; columns of the right side that exist on the left are dropped."""
    renamed = right.withColumnsRenamed({c: f"{c}{suffix}" for c in right.columns if c in left.columns})
    key = f"{right_on}{suffix}" if right_on in left.columns else right_on
    out = left.join(renamed, left[left_on] == renamed[key], "left")
    return out.drop(*[f"{c}{suffix}" for c in right.columns if c in left.columns])


def match_ratio(joined: DataFrame, right_key: str) -> DataFrame:
    """rows, matched rows and their ratio (0 for an empty table)."""
    n, m = F.count(F.lit(1)), F.count(F.col(right_key))
    return joined.agg(n.alias("n_rows"), m.alias("n_matched"), F.coalesce(F.try_divide(m, n), F.lit(0.0)).alias("ratio"))


def passes_quality(joined: DataFrame, right_key: str, value_ratio: float = 0.65) -> bool:
    """False if too few base rows found a partner."""
    return match_ratio(joined, right_key).first().ratio >= value_ratio


def join_diagnostics(base: DataFrame, joined: DataFrame, target: str | None = None) -> DataFrame:
    """Columns that the join added, those of them all null, and their mean missing ratio."""
    added = [c for c in joined.columns if c not in base.columns and c != target]
    if not added:
        return joined.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_added"), F.lit(0).cast("long").alias("n_all_null"), F.lit(0.0).alias("mean_missing"))
    n = F.count(F.lit(1))
    missing = [F.coalesce(1 - F.try_divide(F.count(F.col(c)), n), F.lit(0.0)) for c in added]
    ratios = joined.agg(*[m.alias(f"m{i}") for i, m in enumerate(missing)])
    parts = [F.col(f"m{i}") for i in range(len(added))]
    total = reduce(lambda a, b: a + b, parts)
    null = reduce(lambda a, b: a + b, [(p == 1.0).cast("long") for p in parts])
    return ratios.select(F.lit(len(added)).cast("long").alias("n_added"), null.alias("n_all_null"), (total / len(added)).alias("mean_missing"))


def semi_ratio(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """The part of left rows whose key is among the right keys."""
    keys = right.select(F.col(right_on).alias("__k")).where("__k is not null").distinct()
    hit = left.join(keys, left[left_on] == keys["__k"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_rows"), F.count("__k").alias("n_found"), F.try_divide(F.count("__k"), F.count(F.lit(1))).alias("ratio"))


def with_slab(df: DataFrame, key: Column, name: str = "__slab") -> DataFrame:
    """`name`: one of SLABS slabs of about equal numbers of rows by `key` (0 for a null key), cut at approximate quantiles inside the plan."""
    keyed = df.withColumn("__cutkey", key)
    cuts = keyed.agg(F.percentile_approx("__cutkey", [i / SLABS for i in range(1, SLABS)], 2000).alias("__q"))
    coarse = F.filter(F.transform(F.sequence(F.lit(16), F.lit(SLABS - 16), F.lit(16)), lambda i: F.get("__q", i - 1)), lambda c: c <= F.col("__cutkey"))
    steps = 16 * F.size(coarse)
    slab = F.coalesce(steps + F.size(F.filter(F.slice("__q", steps + 1, F.lit(15)), lambda c: c <= F.col("__cutkey"))), F.lit(0))
    return keyed.crossJoin(F.broadcast(cuts)).withColumn(name, F.when(F.col("__q").isNull(), 0).otherwise(slab)).drop("__q", "__cutkey")  # one row


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: list[str] | None = None,
    tolerance: float | None = None,
    direction: str = "nearest",
    order: str | None = None,
) -> DataFrame:
    """Every left row with the right row that is nearest in time, at or before it, or at or after it.

    Keys are numbers or timestamps (tolerance in key units, for timestamps in seconds); None is no limit and 0 is exact. Whole
    numbers are compared as such, so nanoseconds keep their last digits. Left rows with a null key stay, unmatched; right rows with one are left
    out. Of right rows with the same key the last by `order` counts backwards and the first forwards (without `order` by a hash of their other columns,
    which is the same on every run); nearest takes the backward one of two that are equally far. The right key comes as `__right_<name>`.
    A left column `__row_id` puts the result in its order.

    Time is cut into slabs of about equal numbers of rows, so no task holds a whole entity or the whole table and outliers don't matter: each slab is also
    given the last right row before it and the first one after it, from one summary row a slab. Within a slab two running windows find
    both neighbours. Nothing runs before the result is asked for.
    """
    by = by or []
    times, whole = ("timestamp", "timestamp_ntz", "date"), ("byte", "short", "integer", "long")
    kinds = [left.schema[left_on].dataType.typeName(), right.schema[right_on].dataType.typeName()]
    is_time, kind = kinds[0] in times, "long" if all(k in whole for k in kinds) else "double"

    def key(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp")) if is_time else F.col(c).cast(kind)

    limit = None if tolerance is None or tolerance < 0 else float(tolerance) * (1e6 if is_time else 1.0)
    payload = [c for c in right.columns if c not in by and c != right_on]
    kept = [F.col(right_on).alias(f"__right_{right_on}"), *[F.col(c) for c in payload]]
    seq = F.col(order) if order else F.xxhash64(*payload) if payload else F.lit(0)
    keys = [F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]
    names = [f"__by{i}" for i in range(len(by))]
    own = F.struct(*[F.col(c) for c in left.columns])
    ls = left.select(*keys, key(left_on).alias("__t"), F.lit(1).alias("__side"), own.alias("__left"))
    rs = right.select(*keys, key(right_on).alias("__t"), F.lit(0).alias("__side"), seq.alias("__seq"), F.struct(*kept).alias("__right")).where("__t is not null")
    # SLABS - 1 cuts in one row; the slab is the number of cuts up to a time, counted by steps of 16 and then one by one
    cuts = rs.select("__t").unionByName(ls.select("__t")).agg(F.percentile_approx("__t", [i / SLABS for i in range(1, SLABS)], 2000).alias("__q"))
    coarse = F.filter(F.transform(F.sequence(F.lit(16), F.lit(SLABS - 16), F.lit(16)), lambda i: F.get("__q", i - 1)), lambda c: c <= F.col("__t"))
    steps = 16 * F.size(coarse)
    slab = F.coalesce(steps + F.size(F.filter(F.slice("__q", steps + 1, F.lit(15)), lambda c: c <= F.col("__t"))), F.lit(0))
    ls, rs = (x.crossJoin(F.broadcast(cuts)).withColumn("__slab", F.when(F.col("__q").isNull(), 0).otherwise(slab)).drop("__q") for x in (ls, rs))  # one row
    known = ls.where("__t is not null")
    entry = F.struct("__t", "__seq", "__right")
    ends = rs.groupBy(*names, "__slab").agg(F.max(entry).alias("last"), F.min(entry).alias("first"))
    ends = known.select(*names, "__slab").distinct().join(ends, [*names, "__slab"], "full")
    w = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))  # one row a slab
    before = F.last("last", True).over(w.orderBy("__slab").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", True).over(w.orderBy(F.desc("__slab")).rowsBetween(Window.unboundedPreceding, -1))
    around = ends.withColumns({"__before": before, "__after": after})
    carried = around.select(*names, "__slab", F.explode(F.array("__before", "__after")).alias("e")).where("e is not null")
    carried = carried.select(*names, F.col("e.__t").alias("__t"), F.lit(0).alias("__side"), F.col("e.__seq").alias("__seq"), F.col("e.__right").alias("__right"), "__slab")
    rows = known.unionByName(rs, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    part = Window.partitionBy(*names, "__slab")
    hit = F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("t"), F.col("__right").alias("r")))
    back = part.orderBy("__t", "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = part.orderBy(F.desc("__t"), "__side", F.desc("__seq")).rowsBetween(Window.unboundedPreceding, 0)
    if direction in ("backward", "nearest"):
        rows = rows.withColumn("__b", F.last(hit, True).over(back))
    if direction in ("forward", "nearest"):
        rows = rows.withColumn("__f", F.last(hit, True).over(ahead))
    rows = rows.where("__side = 1")
    if direction == "nearest":
        db, df = F.try_subtract("__t", "__b.t"), F.try_subtract("__f.t", "__t")  # null if too far apart for a number
        best = F.when(F.col("__b").isNull(), F.col("__f")).when(F.col("__f").isNull() | df.isNull() | (db <= df), F.col("__b")).otherwise(F.col("__f"))
    elif direction in ("backward", "forward"):
        best = F.col("__b" if direction == "backward" else "__f")
    else:
        raise ValueError(f"direction {direction!r}")
    rows = rows.withColumn("__m", best)
    if limit is not None:
        rows = rows.withColumn("__m", F.when(F.abs(F.try_subtract("__m.t", "__t")) <= limit, F.col("__m")))
    found = [F.col("__m.r")[f"__right_{right_on}"].alias(f"__right_{right_on}"), *[F.col("__m.r")[c].alias(c) for c in payload]]
    out = rows.select("__left.*", *found)
    lost = left.where(F.col(left_on).isNull())
    out = out.unionByName(lost, allowMissingColumns=True)
    return out.orderBy(ROW) if ROW in left.columns else out
