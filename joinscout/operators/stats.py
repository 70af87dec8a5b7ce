"""Correlation, entropy and redundancy of many columns at once, over one long table of (feature, x, y) counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges that a feature's distinct values are ranked in, so that no task ranks a whole column.
RANGES = 1024
#: Columns that go into one unpivoting pass.
WIDE = 200
#: Counts of bins that a value of the target keeps at once, and cells of a block of binned columns; both at most, about.
COUNTERS, CELLS = 20, 8192


def long_pairs(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, x, y) of every row and feature, as doubles; rows where either is null or not a number are left out."""
    parts = []
    for at in range(0, len(features), WIDE):
        some = features[at : at + WIDE]
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in some])
        parts.append(df.select(F.col(target).cast("double").alias("y"), F.explode(pairs).alias("p")).select("p.feature", "p.x", "y"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def pair_counts(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, x, y, n): equal pairs are counted where they lie."""
    return long_pairs(df, features, target).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, correlation, n) over the rows that have both; 0 where the denominator isn't above 0. One aggregate, no row is multiplied."""
    number = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))

    def measure(f: str) -> tuple[Column, Column]:
        both = number(f).isNotNull() & number(target).isNotNull()
        x, y = F.when(both, number(f)), F.when(both, number(target))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.count(x)

    measures = [measure(f) for f in features]
    flat = df.agg(*[m.alias(f"{k}{i}") for i, ms in enumerate(measures) for k, m in zip("cn", ms, strict=True)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.nanvl(F.col(f"c{i}"), F.lit(0.0)), F.lit(0.0)).alias("correlation"), F.col(f"n{i}").alias("n")) for i, f in enumerate(features)])
    return flat.select(F.explode(rows).alias("r")).select("r.*").where("n > 0")


def _target_ranks(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(y, r0, r1, ...): each value's average rank among the rows that have the i-th feature, less half their number; null where none has.

    Values are counted where they lie and ranked in RANGES ranges for all features at once, so a row a value is sorted, not one a value and feature.
    """
    counts = df.groupBy("y").agg(*[F.count(f"x{i}").alias(f"n{i}") for i in range(len(features))])
    span = counts.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), *[F.sum(f"n{i}").alias(f"s{i}") for i in range(len(features))])
    step = F.coalesce(F.try_divide(F.col("y") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * (RANGES - 1)
    placed = counts.crossJoin(F.broadcast(span)).withColumn("range", F.floor(step).cast("int"))  # one row
    sums = placed.groupBy("range").agg(*[F.sum(f"n{i}").alias(f"m{i}") for i in range(len(features))])
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    sums = sums.select("range", *[F.coalesce(F.sum(f"m{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in range(len(features))])
    inside = Window.partitionBy("range").orderBy("y")
    upto = placed.select("*", *[F.sum(f"n{i}").over(inside).alias(f"u{i}") for i in range(len(features))]).join(F.broadcast(sums), "range")
    rank = lambda i: F.col(f"b{i}") + F.col(f"u{i}") - (F.col(f"n{i}") - 1) / 2 - F.col(f"s{i}") / 2
    return upto.select("y", *[F.when(F.col(f"n{i}") > 0, rank(i)).alias(f"r{i}") for i in range(len(features))])


def spearman(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, correlation, n): Pearson of average ranks over the rows that have both.

    Ranks of the target come to the rows by one join for all features. A feature's values need their rows' number and sums of those ranks only, which are added
    up where they lie, so no row is joined with its feature's ranks.
    """
    parts = [_spearman(df, features[at : at + WIDE], target) for at in range(0, len(features), WIDE)]
    return reduce(DataFrame.unionByName, parts)


def _spearman(df: DataFrame, features: list[str], target: str) -> DataFrame:
    number = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    rows = df.select(number(target).alias("y"), *[number(f).alias(f"x{i}") for i, f in enumerate(features)]).where("y is not null")
    ranked = rows.join(_target_ranks(rows, features, target).withColumnRenamed("y", "__y"), F.col("y") == F.col("__y"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x"), F.col(f"r{i}").alias("ry")) for i in range(len(features))])
    long = ranked.select(F.explode(cells).alias("p")).select("p.*").where("x is not null")
    each = long.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("ry").alias("sy"), F.sum(F.col("ry") * F.col("ry")).alias("syy"))
    span = rows.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(len(features)) for k, f in (("lo", F.min), ("hi", F.max), ("c", F.count))])
    span = span.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"{k}{i}").alias(k) for k in ("lo", "hi", "c")]) for i in range(len(features))])).alias("p")).select("p.*")
    step = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * (RANGES - 1)
    placed = each.join(F.broadcast(span), "i").withColumn("range", F.floor(step).cast("int"))  # one row a feature
    inside = Window.partitionBy("i", "range").orderBy("x")
    local = placed.withColumn("rank", F.sum("n").over(inside) - (F.col("n") - 1) / 2)
    # a range's sums of the ranks inside it; what stands before it is added to them afterwards
    sums = local.groupBy("i", "range").agg(
        F.first("c").alias("c"), F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), F.sum(F.col("rank") * F.col("n")).alias("sx"), F.sum(F.col("rank") * F.col("rank") * F.col("n")).alias("sxx"), F.sum(F.col("rank") * F.col("sy")).alias("sxy")
    )
    earlier = Window.partitionBy("i").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("off", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("c") / 2)  # at most RANGES rows a feature; ranks about their middle, for exactness
    off, s = F.col("off"), F.sum("n")
    sx, sxx, sxy = F.sum(F.col("sx") + off * F.col("n")), F.sum(F.col("sxx") + 2 * off * F.col("sx") + off * off * F.col("n")), F.sum(F.col("sxy") + off * F.col("sy"))
    mx, my = sx / s, F.sum("sy") / s
    cov, vx, vy = sxy / s - mx * my, sxx / s - mx * mx, F.sum("syy") / s - my * my
    found = sums.groupBy("i").agg(F.when((F.sum("d") > 1) & (vx > 1e-12) & (vy > 1e-12), F.try_divide(cov, F.sqrt(vx * vy))).otherwise(F.lit(0.0)).alias("correlation"), s.alias("n"))
    return found.select(F.get(F.array(*map(F.lit, features)), F.col("i")).alias("feature"), "correlation", "n")


def relevance(df: DataFrame, features: list[str], target: str, method: str = "spearman") -> DataFrame:
    """(feature, score): absolute correlation strictly between 0 and 1, best first, ties by name."""
    found = (spearman if method == "spearman" else pearson)(df, features, target)
    score = F.round(F.abs("correlation"), 9)
    return found.select("feature", score.alias("score")).where("score > 0 and score < 1").orderBy(F.desc("score"), "feature")


def bin_uniform(df: DataFrame, columns: list[str], bins: int = 5) -> DataFrame:
    """Columns as the number of their equal-width bin, the top edge in the last; a constant column is bin 0, null stays."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))])
    wide = df.crossJoin(F.broadcast(ends))  # one row
    out = {}
    for i, c in enumerate(columns):
        x, lo, hi = F.col(c).cast("double"), F.col(f"lo_{i}"), F.col(f"hi_{i}")
        place = F.floor(F.try_divide((x - lo) * bins, hi - lo))
        out[c] = F.when(x.isNotNull(), F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0))).cast("int")
    return wide.withColumns(out).select(*df.columns)


def entropy_of(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(feature, name): entropy in nats of the keys' joint distribution, from rows with a count n."""
    cells = counts.groupBy("feature", *keys).agg(F.sum("n").alias("n"))
    # H = ln N - sum(n ln n) / N
    return cells.groupBy("feature").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(name))


def mutual_information(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, h_target, h_conditional, mi): H(Y), H(Y|X) and H(Y) - H(Y|X); the features as they are."""
    counts = pair_counts(df, features, target)
    joint = entropy_of(counts, ["x", "y"], "hxy").join(entropy_of(counts, ["x"], "hx"), "feature").join(entropy_of(counts, ["y"], "hy"), "feature")
    return joint.select("feature", F.col("hy").alias("h_target"), (F.col("hxy") - F.col("hx")).alias("h_conditional"), (F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"))


def _stacked(df: DataFrame, groups: list[tuple[str, ...]], names: str) -> DataFrame:
    """(feature, names..., n): counts of the columns of each group, which is (feature, column, ...), in one pass; rows where one is null are left out."""
    parts = []
    for at in range(0, len(groups), WIDE):
        cells = F.array(*[F.struct(F.lit(g[0]).alias("feature"), *[F.col(c).cast("double").alias(k) for k, c in zip(names, g[1:], strict=True)]) for g in groups[at : at + WIDE]])
        parts.append(df.select(F.explode(cells).alias("p")).select("p.*"))
    rows = reduce(DataFrame.unionByName, parts)
    good = " and ".join(f"{k} is not null and not isnan({k})" for k in names)
    return rows.where(good).groupBy("feature", *names).agg(F.count(F.lit(1)).alias("n"))


def _information(counts: DataFrame) -> DataFrame:
    """(feature, value): I(x; y) of rows with x and y, or I(x; y | z) of rows with z too."""
    if "z" not in counts.columns:
        joint = entropy_of(counts, ["x", "y"], "a").join(entropy_of(counts, ["x"], "b"), "feature").join(entropy_of(counts, ["y"], "c"), "feature")
        return joint.select("feature", (F.col("b") + F.col("c") - F.col("a")).alias("value"))
    out = entropy_of(counts, ["x", "z"], "a").join(entropy_of(counts, ["y", "z"], "b"), "feature").join(entropy_of(counts, ["x", "y", "z"], "c"), "feature").join(entropy_of(counts, ["z"], "d"), "feature")
    return out.select("feature", (F.col("a") + F.col("b") - F.col("c") - F.col("d")).alias("value"))


def conditional_mutual_information(df: DataFrame, features: list[str], other: str, given: str) -> DataFrame:
    """(feature, cmi): I(feature; other | given) = H(x,z) + H(y,z) - H(x,y,z) - H(z)."""
    return _information(_stacked(df, [(f, f, other, given) for f in features], "xyz")).withColumnRenamed("value", "cmi")


def _numbered(parts: list[DataFrame]) -> DataFrame:
    """(i, j, value) of rows whose feature is written i|j."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.split_part("feature", F.lit("|"), F.lit(1)).cast("int").alias("i"), F.split_part("feature", F.lit("|"), F.lit(2)).alias("j"), "value")


def _named(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.withColumn("feature", F.get(F.array(*map(F.lit, names)), F.col("i"))).drop("i")


def between_bounds(score: DataFrame, column: str = "raw") -> DataFrame:
    """`score`: the column put between 0 and 1, of those above 0; none if all are 0."""
    ends = score.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.max(F.abs(F.col(column))).alias("top"))
    scaled = score.crossJoin(F.broadcast(ends)).where("top > 0")  # one row
    scaled = scaled.withColumn("score", F.coalesce(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)))
    return scaled.where("score > 0").drop("lo", "hi", "top").orderBy(F.desc("score"), "feature")


def _target_information(binned: DataFrame, new: list[str], target: str, bins: int) -> DataFrame:
    """(feature, value): I(bin; target) of each new column as i|t. A row a value of the target has the numbers of its rows in each bin of some columns."""
    parts, some = [], max(1, COUNTERS // bins)
    zero, nlogn = F.lit(0.0), lambda n: F.coalesce(n * F.log(n), F.lit(0.0))  # the logarithm of 0 is null
    for at in range(0, len(new), some):
        ids = range(at, min(at + some, len(new)))
        y = F.nullif(F.col(target).cast("double"), F.lit(float("nan")))
        rows = binned.select(y.alias("y"), *[F.col(new[i]).alias(f"b{i}") for i in ids]).where("y is not null")
        counts = rows.groupBy("y").agg(*[F.count_if(F.col(f"b{i}") == b).alias(f"n{i}_{b}") for i in ids for b in range(bins)])
        cells = {i: [F.col(f"n{i}_{b}") for b in range(bins)] for i in ids}
        sums = counts.agg(
            *[F.sum(c).alias(f"s{i}_{b}") for i in ids for b, c in enumerate(cells[i])],
            *[F.sum(reduce(Column.__add__, map(nlogn, cells[i]), zero)).alias(f"xy{i}") for i in ids],
            *[F.sum(nlogn(reduce(Column.__add__, cells[i]))).alias(f"y{i}") for i in ids],
        )
        entries = []
        for i in ids:
            each = [F.col(f"s{i}_{b}") for b in range(bins)]
            n = reduce(Column.__add__, each)
            # H(x) + H(y) - H(x, y), each ln n - sum(m ln m) / n
            entries.append(F.struct(F.lit(f"{i}|t").alias("feature"), F.when(n > 0, F.log(n) + F.try_divide(F.col(f"xy{i}") - F.col(f"y{i}") - reduce(Column.__add__, map(nlogn, each), zero), n)).alias("value")))
        parts.append(sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("value is not null"))
    return reduce(DataFrame.unionByName, parts)


def _bin_information(binned: DataFrame, new: list[str], selected: list[str], bins: int) -> DataFrame:
    """(feature, value): I(bin; bin) of each new and each selected column as i|sj.

    Columns go in blocks of some new and some selected ones, whose bins make one number of at most CELLS values; rows are counted by it once a block, and the
    counts of a block's pairs come from these few cells.
    """
    base, width = bins + 1, 2
    while base ** (width + 1) <= CELLS:
        width += 1
    across = min(len(selected), width - min(len(new), width // 2))
    down = min(len(new), width - across)
    columns = -(-len(selected) // across)
    code = lambda c: F.coalesce(F.col(c).cast("long") + 1, F.lit(0))
    cells = []
    for u in range(-(-len(new) // down)):
        for v in range(columns):
            block = [(p, new[u * down + p]) for p in range(down) if u * down + p < len(new)] + [(down + q, selected[v * across + q]) for q in range(across) if v * across + q < len(selected)]
            cells.append(reduce(Column.__add__, [code(c) * base**at for at, c in block], F.lit((u * columns + v) * base**width).cast("long")))
    parts = [binned.select(F.explode(F.array(*cells[at : at + WIDE])).alias("code")) for at in range(0, len(cells), WIDE)] if len(cells) > 1 else [binned.select(cells[0].alias("code"))]
    counts = reduce(DataFrame.unionByName, parts).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    digit = lambda at: F.pmod(F.floor(F.col("code") / base**at), F.lit(base))
    block = F.floor(F.col("code") / base**width)
    i, j = lambda p: F.floor(block / columns) * down + p, lambda q: F.pmod(block, F.lit(columns)) * across + q
    pairs = F.array(*[F.struct(F.concat_ws("|s", i(p).cast("string"), j(q).cast("string")).alias("feature"), digit(p).alias("x"), digit(down + q).alias("y")) for p in range(down) for q in range(across)])
    return _information(counts.select("n", F.explode(pairs).alias("p")).select("p.*", "n").where("x > 0 and y > 0"))


def redundancy(df: DataFrame, selected: list[str], new: list[str], target: str, bins: int = 5, joint: bool = False, parity: bool = True) -> DataFrame:
    """(feature, raw, score): MI(f; target) less the mean MI with the selected features, plus the mean conditional MI if `joint`.

    Features are binned, the target isn't. With `parity` scores are put between 0 and 1 and only those above 0 stay, so the
    lowest (and a single candidate) is refused; without it raw scores are returned. Rows are counted where they lie, not written out once a pair of columns;
    all triples go through one pass.
    """
    columns = list(dict.fromkeys([*selected, *new]))
    binned = bin_uniform(df.select(*columns, target), columns, bins)
    found = [_target_information(binned, new, target, bins)]
    if selected:
        found.append(_bin_information(binned, new, selected, bins).withColumn("value", -F.col("value") / len(selected)))
    if joint and selected:
        triples = [(f"{i}|c{j}", f, s, target) for i, f in enumerate(new) for j, s in enumerate(selected)]
        found.append(_information(_stacked(df, triples, "xyz")).withColumn("value", F.col("value") / len(selected)))
    score = _numbered(found).groupBy("i").agg(F.round(F.sum("value"), 9).alias("raw"), F.count(F.lit(1)).alias("m"))
    score = _named(score.where(F.col("m") == 1 + len(selected) * (2 if joint else 1)).drop("m"), new).select("feature", "raw")
    if not parity:
        return score.withColumn("score", F.col("raw")).orderBy(F.desc("score"), "feature")
    return between_bounds(score).select("feature", "raw", "score")


def conditional_redundancy(df: DataFrame, selected: list[str], new: list[str], target: str, parity: bool = True) -> DataFrame:
    """(feature, raw, score) by conditional mutual information maximisation: I(f; target) less the largest I(f; s) - I(f; s | target), on values as they are."""
    pairs = [(f"{i}|t", f, target) for i, f in enumerate(new)] + [(f"{i}|{j}", f, s) for i, f in enumerate(new) for j, s in enumerate(selected)]
    own = _numbered([_information(_stacked(df, pairs, "xy"))])
    score = own.where("j = 't'").select("i", F.col("value").alias("mi"))
    if selected:
        given = _numbered([_information(_stacked(df, [(f"{i}|{j}", f, s, target) for i, f in enumerate(new) for j, s in enumerate(selected)], "xyz"))]).withColumnRenamed("value", "given")
        less = own.join(given, ["i", "j"]).groupBy("i").agg(F.max(F.col("value") - F.col("given")).alias("less"))
        score = score.join(less, "i").select("i", (F.col("mi") - F.col("less")).alias("mi"))
    score = _named(score.select("i", F.round("mi", 9).alias("raw")), new).select("feature", "raw")
    return between_bounds(score).select("feature", "raw", "score") if parity else score.withColumn("score", F.col("raw"))


def group_redundancy(df: DataFrame, group: list[str], target: str) -> DataFrame:
    """(feature, score): the mean of I(feature; target | other) over the others of its group, of those above 0; a group of one has none."""
    triples = [(f"{i}|{j}", f, target, o) for i, f in enumerate(group) for j, o in enumerate(group) if i != j]
    if not triples:
        return df.sparkSession.createDataFrame([], "feature string, score double")
    score = _numbered([_information(_stacked(df, triples, "xyz"))]).groupBy("i").agg(F.round(F.avg("value"), 9).alias("score"))
    return _named(score.where("score > 0"), group).select("feature", "score")


def path_score(relevant: list[float], redundant: list[float] | None) -> float | None:
    """Mean relevance plus mean redundancy; None (refused) if either is empty."""
    if not relevant or redundant is not None and not redundant:
        return None
    return sum(relevant) / len(relevant) + (sum(redundant) / len(redundant) if redundant else 0.0)


def top_half(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The better half of the features by absolute Spearman, ties by name."""
    ranked = spearman(df, features, target).select("feature", F.round(F.abs("correlation"), 9).alias("score"))
    return ranked.orderBy(F.desc("score"), "feature").limit(len(features) // 2)
