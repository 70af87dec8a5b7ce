"""Gaps, grids, imputation, windows, forecasts and splits of time series, each series (`by`) by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .augment import unit
from .joins import with_slab
from .lowrank import centroid_impute
from .neighbours import neighbour_impute

#: Of approximate percentiles: the error in rank is at most one of so many.
ACCURACY = 10_000


def _median(c: Column, exact: bool) -> Column:
    return F.median(c) if exact else F.percentile_approx(c, 0.5, ACCURACY)


def _seconds(df: DataFrame, time: str) -> Column:
    if df.schema[time].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    return F.col(time).cast("double")


def _keyed(df: DataFrame, by: list[str]) -> tuple[list[Column], list[str]]:
    """Series columns under names of their own, to join summaries back by."""
    names = [f"__k{i}" for i in range(len(by))]
    return [F.col(b).alias(k) for b, k in zip(by, names, strict=True)], names


def _same(by: list[str], names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, names, strict=True)], F.col("__slab") == F.col("__s"))


def _slabs(df: DataFrame, time: str) -> DataFrame:
    """`__t`, seconds, and `__slab`: slabs of about equal numbers of rows, -1 for rows without a time, which come first."""
    rows = with_slab(df.withColumn("__t", _seconds(df, time)), _seconds(df, time))
    return rows.withColumn("__slab", F.when(F.col("__t").isNotNull(), F.col("__slab")).otherwise(-1))


def with_delta(df: DataFrame, time: str, by: list[str], tie: str | None = None) -> DataFrame:
    """`delta`: seconds since the row before in its series. A slab's first row gets the last time before the slab, so a long series isn't sorted in one task."""
    rows = _slabs(df, time)
    keys, names = _keyed(df, by)
    over = Window.partitionBy(*names or [F.lit(0)]).orderBy("__s")  # a row a slab
    sums = rows.groupBy(*keys, F.col("__slab").alias("__s")).agg(F.max("__t").alias("__hi"))
    sums = sums.withColumn("__before", F.lag("__hi").over(over)).drop("__hi")
    inside = Window.partitionBy(*by, "__slab").orderBy("__t", *([tie] if tie else []))
    rows = rows.withColumn("__lag", F.lag("__t").over(inside)).join(sums, _same(by, names))
    return rows.withColumn("delta", F.col("__t") - F.coalesce("__lag", "__before")).select(*df.columns, "delta")


def gap_segments(df: DataFrame, time: str, by: list[str], gap: float, tie: str | None = None, slab: float = 86_400) -> DataFrame:
    """`segment`, from 1: a new one after every gap of more than `gap` seconds; rows without a time are in the first.

    A series is numbered slab by slab of time, from one summary row a slab, so a long one isn't sorted in one task.
    """
    keys = [*by, "__slab"]
    rows = df.withColumns({"__t": _seconds(df, time), "__slab": F.floor(_seconds(df, time) / slab)})
    w = Window.partitionBy(*keys).orderBy(time, *([tie] if tie else []))
    rows = rows.withColumn("__new", (F.coalesce(F.col("__t") - F.lag("__t").over(w), F.lit(0.0)) > gap).cast("long"))
    sums = rows.groupBy(*keys).agg(F.min("__t").alias("lo"), F.max("__t").alias("hi"), F.sum("__new").alias("n"))
    over = Window.partitionBy(*by or [F.lit(0)]).orderBy("__slab")  # one row a slab
    sums = sums.withColumn("first", (F.coalesce(F.col("lo") - F.lag("hi").over(over), F.lit(0.0)) > gap).cast("long"))
    before = F.coalesce(F.sum(F.col("n") + F.col("first")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("first")
    starts = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], before.alias("__before"))
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(starts[f"__k{i}"]) for i, k in enumerate(keys)])
    inside = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__in", inside).join(starts, on).withColumn("segment", 1 + F.col("__before") + F.col("__in")).select(*df.columns, "segment")


def write_segments(segmented: DataFrame, path: str, by: list[str]) -> None:
    """One folder a segment."""
    segmented.write.mode("overwrite").partitionBy(*by, "segment").parquet(path)


def frequency(df: DataFrame, time: str, by: list[str], exact: bool = False) -> DataFrame:
    """by, step: the median positive delta, approximate unless `exact`, which gathers a series' distinct deltas."""
    return with_delta(df, time, by).where("delta > 0").groupBy(*by).agg(_median(F.col("delta"), exact).alias("step"))


def gap_report(df: DataFrame, time: str, by: list[str], factor: float = 1.5, exact: bool = False) -> DataFrame:
    """Gaps above factor times the usual step, with the slots missing in them (none of 0)."""
    rows = with_delta(df, time, by).join(frequency(df, time, by, exact), by).where(F.col("delta") > F.col("step") * factor)
    return rows.select(*by, time, "delta", "step", (F.floor(F.col("delta") / F.col("step")) - 1).cast("long").alias("missing")).where("missing > 0")


def regular_grid(df: DataFrame, time: str, by: list[str], step: int, values: list[str]) -> DataFrame:
    """Means of rows with the same time, on a grid of `step` (key units) from the first to the last time and on the original times."""
    at = df.groupBy(*by, time).agg(*[F.avg(v).alias(v) for v in values])
    ends = at.groupBy(*by).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    grid = ends.select(*by, F.explode(F.sequence(F.col("lo"), F.col("hi"), F.lit(step).cast(at.schema[time].dataType))).alias(time))
    return grid.unionByName(at.select(*by, time)).distinct().join(at, [*by, time], "left")


def _around(df: DataFrame, columns: list[str], by: list[str], time: str) -> DataFrame:
    """`__b<i>` and `__a<i>`: (t, v) of the last value of a column at or before a row and the first at or after it, in its series.

    Time is cut into slabs; a slab gets the last value before it and the first after it from one summary row a slab and series, so a long series isn't
    sorted in one task. Of equal times the larger value counts backwards and the smaller one forwards. Rows without a time get what is first.
    """
    rows = _slabs(df, time)
    rows = rows.withColumns({f"__p{i}": F.when(F.col(c).isNotNull() & F.col("__t").isNotNull(), F.struct(F.col("__t").alias("t"), F.col(c).alias("v"))) for i, c in enumerate(columns)})
    keys, names = _keyed(df, by)
    n = range(len(columns))
    sums = rows.groupBy(*keys, F.col("__slab").alias("__s")).agg(*[f(f"__p{i}").alias(f"{k}{i}") for i in n for k, f in (("__hi", F.max), ("__lo", F.min))])
    over = Window.partitionBy(*names or [F.lit(0)])  # a row a slab
    back = {f"__before{i}": F.last(f"__hi{i}", True).over(over.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)) for i in n}
    ahead = {f"__after{i}": F.last(f"__lo{i}", True).over(over.orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, -1)) for i in n}
    sums = sums.withColumns(back | ahead).drop(*[f"{k}{i}" for i in n for k in ("__hi", "__lo")])
    on = _same(by, names)
    inside = Window.partitionBy(*by, "__slab")
    own = {f"__b{i}": F.max(f"__p{i}").over(inside.orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)) for i in n}
    own |= {f"__a{i}": F.min(f"__p{i}").over(inside.orderBy("__t").rangeBetween(0, Window.unboundedFollowing)) for i in n}
    out = rows.withColumns(own).join(sums, on)
    return out.withColumns({f"__b{i}": F.coalesce(f"__b{i}", f"__before{i}") for i in n} | {f"__a{i}": F.coalesce(f"__a{i}", f"__after{i}") for i in n})


def impute(df: DataFrame, columns: list[str], time: str, by: list[str], method: str) -> DataFrame:
    """Fill nulls: `fill` by the last value and then the next, `linear` on the line between them in time, `mean` by the series' mean.

    `centroid` completes correlated columns together and `neighbours` takes the mean of the five nearest rows that have the column; these two
    don't look at `by`, and the first of them starts from `linear`.
    """
    if method == "centroid":
        return centroid_impute(df, columns, time)
    if method == "neighbours":
        return neighbour_impute(df, columns)
    if method == "mean":
        means = df.groupBy(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)]).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)])
        on = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)], F.lit(True))
        wide = df.join(means, on, "left") if by else df.crossJoin(F.broadcast(means))  # one row
        return wide.withColumns({c: F.coalesce(c, f"__m{i}") for i, c in enumerate(columns)}).select(*df.columns)
    if method not in ("fill", "linear"):
        raise ValueError(f"method {method!r}")
    out = _around(df, columns, by, time)
    t, new = F.col("__t"), {}
    for i, c in enumerate(columns):
        b, a = F.col(f"__b{i}"), F.col(f"__a{i}")
        line = b["v"] + (a["v"] - b["v"]) * F.try_divide(t - b["t"], a["t"] - b["t"])
        new[c] = F.coalesce(F.col(c), b["v"], a["v"]) if method == "fill" else F.coalesce(F.col(c), line, b["v"], a["v"])
    return out.withColumns(new).select(*df.columns)


def mask_cells(df: DataFrame, column: str, key: str, part: float, seed: int = 7) -> DataFrame:
    """Hide a seeded part of the observed cells; the truth goes to `truth`."""
    hide = F.col(column).isNotNull() & (unit(seed, F.col(key)) < part)
    return df.withColumn("truth", F.when(hide, F.col(column))).withColumn(column, F.when(~hide, F.col(column)))


def imputation_error(imputed: DataFrame, column: str) -> DataFrame:
    """n, mae, rmse and mape over the hidden cells."""
    e = F.col(column) - F.col("truth")
    hidden = imputed.where(F.col("truth").isNotNull() & F.col(column).isNotNull())
    return hidden.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(F.try_divide(e, F.col("truth")))).alias("mape"))


def time_profile(df: DataFrame, time: str, by: list[str], exact: bool = False) -> DataFrame:
    """by, time_start, time_end (seconds), delta_median, delta_p95 and large_gaps (deltas above the 95th percentile)."""
    rows = with_delta(df.where(F.col(time).isNotNull()), time, by).withColumn("__t", _seconds(df, time))
    p95 = F.percentile("delta", 0.95) if exact else F.percentile_approx("delta", 0.95, ACCURACY)
    ends = rows.groupBy(*by).agg(F.min("__t").alias("time_start"), F.max("__t").alias("time_end"), _median(F.col("delta"), exact).alias("delta_median"), p95.alias("delta_p95"))
    far = rows.join(ends.select(*by, "delta_p95"), by).where("delta > delta_p95").groupBy(*by).agg(F.count(F.lit(1)).alias("large_gaps"))
    return ends.join(far, by, "left").na.fill(0, ["large_gaps"])


#: Rows of a block of a series, of which windows are made.
BLOCK = 8192


def sliding_windows(df: DataFrame, value: str, time: str, by: list[str], size: int = 32, stride: int = 8, horizon: int = 1, tie: str | None = None) -> DataFrame:
    """by, start (from 0), window (array), y (the value `horizon` rows after the window's end); complete ones only.

    A series is numbered slab by slab and cut into blocks of rows, each with the first size + horizon - 1 rows of the next one, so a long series is many tasks.
    """
    order = [F.asc_nulls_first(time), *([F.asc_nulls_first(tie)] if tie else [])]
    rows = _slabs(df, time)
    keys, names = _keyed(df, by)
    over = Window.partitionBy(*names or [F.lit(0)]).orderBy("__s")  # a row a slab
    sums = rows.groupBy(*keys, F.col("__slab").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__slab").orderBy(*order)) - 1).join(sums, _same(by, names))
    rows = rows.select(*by, F.col(value).alias("__v"), (F.col("__before") + F.col("__r")).alias("start"))
    block, reach = max(BLOCK, size + horizon), size + horizon - 1
    own = F.floor(F.col("start") / block)
    near = F.when((F.col("start") % block < reach) & (own > 0), own - 1)
    rows = rows.withColumn("__block", F.explode(F.filter(F.array(own, near), lambda x: x.isNotNull()))).withColumn("__own", own == F.col("__block"))
    at = Window.partitionBy(*by, "__block").orderBy("start")
    out = rows.select(*by, "start", "__own", F.collect_list("__v").over(at.rowsBetween(0, size - 1)).alias("window"), F.lead("__v", reach).over(at).alias("y"), F.lead(F.lit(1), reach).over(at).alias("__whole"))
    out = out.where(F.col("__own") & F.col("__whole").isNotNull() & (F.col("start") % stride == 0))
    return out.select(*by, F.col("start").cast("int").alias("start"), "window", "y")


def naive_forecasts(windows: DataFrame, horizon: int = 1, moving: int = 8, season: int = 1) -> DataFrame:
    """Forecasts from the window alone: mean, drift, last season and moving average."""
    w = F.col("window")
    n = F.size(w)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    first, last = F.get(w, F.lit(0)), F.get(w, n - 1)
    tail = F.slice(w, F.greatest(n - moving + 1, F.lit(1)), moving)
    return windows.withColumns(
        {
            "naive_mean": total(w) / n,
            "naive_drift": last + horizon * F.try_divide(last - first, n - 1),
            "naive_seasonal": F.get(w, n - season + F.lit((horizon - 1) % season)),
            "naive_moving_average": total(tail) / F.size(tail),
        }
    )


def chronological_split(df: DataFrame, time: str, tie: str, part: float = 0.8) -> DataFrame:
    """`is_train`: the first int(n * part) rows by time and tie; rows without a time don't count in n and are false.

    The boundary is found from counts by second-wide slices of time, so only the slice it falls in is put in order.
    """
    t = F.floor(_seconds(df, time)).alias("__s")
    rows = df.withColumn("__s", t)
    counts = rows.where("__s is not null").groupBy("__s").count()
    total = counts.agg(F.floor(F.sum("count") * F.lit(part)).alias("n")).first().n or 0
    # one number a coarse slice reaches the window; slices are joined back by value
    upto = counts.withColumn("__c", F.floor(F.col("__s") / 86_400))
    days = upto.groupBy("__c").agg(F.sum("count").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("__b", before).drop("m")
    inside = F.coalesce(F.sum("count").over(Window.partitionBy("__c").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = upto.withColumn("__i", inside).join(days, "__c").select("__s", (F.col("__b") + F.col("__i")).alias("__before"), F.col("count").alias("__m"))
    near = rows.join(starts, "__s", "left")
    edge = near.where((F.col("__before") < total) & (F.col("__before") + F.col("__m") > total))
    cut = edge.withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy(time, tie)) + F.col("__before")).where(F.col("__r") == total).select(F.struct(time, tie).alias("__cut")).limit(1)
    out = near.join(F.broadcast(cut), how="left")
    train = F.when(F.col("__s").isNull(), False).when(F.col("__before") + F.col("__m") <= total, True).when(F.col("__before") >= total, False).otherwise(F.struct(time, tie) <= F.col("__cut"))
    return out.withColumn("is_train", F.coalesce(train, F.lit(False))).drop("__s", "__before", "__m", "__cut")


def group_holdout(df: DataFrame, group: str, held: object = None) -> DataFrame:
    """`is_train`: false for the held group, the largest if none is named."""
    value = F.lit(held) if held is not None else F.lit(df.agg(F.max(group)).first()[0])
    return df.withColumn("is_train", ~F.col(group).eqNullSafe(value))


def seeded_split(df: DataFrame, key: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """`part`: train, validation, test or the like, by a hash of the key; sizes hold in the mean."""
    place = unit(seed, F.col(key))
    out, upto = F, 0.0
    for name, size in parts.items():
        upto += size
        out = out.when(place < upto, F.lit(name))
    return df.withColumn("part", out.otherwise(F.lit(list(parts)[-1])))


#: Bits of a split's hash, and those that one pass over the rows tells apart.
HASH_BITS, RADIX_BITS = 48, 12


def exact_split(df: DataFrame, key: str, parts: dict[str, float], seed: int = 42) -> DataFrame:
    """`part`, of exact sizes: round(n * size) rows, one at least, of each part but the first, which has the rest; at random by a hash of the key.

    The places at which the order of hashes is cut are found by radix passes: each counts rows by the next bits of the hash, as many numbers as these bits have
    values, and goes on in the one where the cut falls. Nothing is sorted. Keys are unique; rows of one key are in one part, so copies
    move a size by their number.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = df.select(number.alias("h"))
    n = df.count()
    names = list(parts)
    sizes = [max(1, round(n * parts[p])) for p in names[1:]]
    cuts, upto = [], 0
    for size in sizes:
        upto = min(n, upto + size)
        cuts.append(_order_statistic(rows, upto))
    place = F.lit(names[0])
    for name, cut in reversed(list(zip(names[1:], cuts, strict=True))):
        if cut is not None:
            place = F.when(number <= cut, F.lit(name)).otherwise(place)
    return df.withColumn("part", place)


def _order_statistic(rows: DataFrame, place: int) -> int | None:
    """The place-th smallest h (from 1) of rows(h), by counts of RADIX_BITS bits at a time."""
    if place <= 0:
        return None
    prefix = 0
    for shift in range(HASH_BITS - RADIX_BITS, -1, -RADIX_BITS):
        inside = rows.where(F.shiftright("h", shift + RADIX_BITS) == prefix)
        counts = {r.b: r["count"] for r in inside.groupBy(F.shiftright("h", shift).alias("b")).count().collect()}  # at most 2^RADIX_BITS rows
        for b in sorted(counts):
            if place <= counts[b]:
                prefix = b
                break
            place -= counts[b]
    return prefix


def scale_by_train(df: DataFrame, columns: list[str], is_train: str = "is_train", exact: bool = False) -> DataFrame:
    """(x - median) / std with the training rows' statistics; a std of 0 counts as 1. The median is approximate unless `exact`, which gathers all distinct values."""
    stats = df.where(F.col(is_train)).agg(*[f.alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", _median(F.col(c), exact)), ("s", F.stddev(c)))])
    wide = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: (F.col(c) - F.col(f"m_{i}")) / F.coalesce(F.nullif(F.col(f"s_{i}"), F.lit(0.0)), F.lit(1.0)) for i, c in enumerate(columns)}
    return wide.withColumns(scaled).select(*df.columns)


def fill_train_median(df: DataFrame, columns: list[str], is_train: str = "is_train", exact: bool = False) -> DataFrame:
    """Nulls and NaN become the training rows' median, approximate unless `exact`."""
    stats = df.where(F.col(is_train)).agg(*[_median(F.nanvl(F.col(c).cast("double"), F.lit(None)), exact).alias(f"m_{i}") for i, c in enumerate(columns)])
    wide = df.crossJoin(F.broadcast(stats))  # one row
    return wide.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col(f"m_{i}")) for i, c in enumerate(columns)}).select(*df.columns)
