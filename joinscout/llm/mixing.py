"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Weights go down a tree of levels (domain, language, source). A node's supply is its tokens times `max_epochs`.
Each parent's budget is shared among its children by weight; a child that can't fill its share gives the rest to
its siblings, and only what all siblings together lack goes to the parent's siblings, because a parent
is never given more than its own supply. A leaf with budget b and t tokens is taken floor(b / t) times whole, and once more as
a prefix of an order seeded by epoch, as far as its tokens fit into the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A leaf's seeded order has 2**48 places in 2**12 buckets; only the bucket where its prefix ends is looked at row by row.
PLACE_BITS, BUCKET_BITS = 48, 12


def share(nodes: DataFrame, parents: list[str], budget: str = "budget") -> DataFrame:
    """Fill `take` of siblings: min(supply, level * weight), with the level at which the parent's budget is used up.

    Siblings go by supply over weight; if the first i are full, the level is what remains over the weights that
    remain, and the largest of these candidates is the level. Weights must be above 0.
    """
    by = Window.partitionBy(*parents)
    order = by.orderBy(F.col("supply") / F.col("weight"), "node")
    before, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    candidate = (F.col(budget) - F.coalesce(F.sum("supply").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    level = nodes.withColumn("candidate", candidate)
    return level.withColumn("take", F.greatest(F.lit(0.0), F.least(F.col("supply"), F.max("candidate").over(by) * F.col("weight"))))


def leaf_budgets(leaves: DataFrame, levels: list[str], weight: dict[str, Column], total: Column, max_epochs: int) -> DataFrame:
    """leaves(levels, tokens, total) with their budget in whole tokens.

    weight[level] is an expression over that level's column; it isn't null and above 0. The tree is as large as the number of
    distinct leaves; each step sees the children of one parent together.
    """
    supply = leaves.withColumn("supply", F.col("tokens").cast("double") * max_epochs)
    above = leaves.agg(total.cast("double").alias("budget"))
    for depth, level in enumerate(levels):
        path, parent = levels[: depth + 1], levels[:depth]
        nodes = supply.groupBy(*path).agg(F.sum("supply").alias("supply")).withColumns({"weight": weight[level].cast("double"), "node": F.col(level)})
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # one row above the first level
        above = share(nodes, parent or [F.lit(0)]).select(*path, F.round("take", 6).alias("budget"))
    return leaves.join(above, levels).withColumn("budget", F.floor(F.col("budget") + 1e-3).cast("long"))


def _place(seed: int, epoch: Column, row_id: Column) -> Column:
    """A row's place in the order of an epoch: the first 48 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(row_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long")


def _units(docs: DataFrame, levels: dict[str, Column], tokens: Column, id_col: str) -> dict[str, Column]:
    """The working columns of a row."""
    own = {f"__{n}": F.coalesce(c.cast("string"), F.lit("")) for n, c in levels.items()}
    return own | {"__id": F.col(id_col), "__tokens": F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))}


def plan_mixture(
    spark: SparkSession, docs: DataFrame, levels: dict[str, Column], weight: dict[str, Column], tokens: Column, fraction: float, max_epochs: int, seed: int, id_col: str = "doc_id"
) -> DataFrame:
    """One row a leaf: its levels, tokens, docs, budget, whole epochs, and the key where its last epoch's prefix ends.

    levels: an expression for each level of the tree, outermost first (null is a node of its own, named "").
    weight: for each level an expression over that level's name. tokens: a row's length; null counts as 0.
    fraction: the total budget as a part of all tokens. max_epochs: how often a row may be taken at most.
    """
    scratch = Scratch(spark, "mixing")
    names = list(levels)
    own = _units(docs, levels, tokens, id_col)
    units = scratch.save(docs.select(*[own[f"__{n}"].alias(n) for n in names], own["__id"].alias("id"), own["__tokens"].alias("n")), "units")
    leaves = units.groupBy(*names).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    budgets = leaf_budgets(leaves, names, weight, F.floor(F.sum("tokens") * fraction), max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div greatest(tokens, 1)")).otherwise(F.lit(1))
    rest = F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0))
    plan = scratch.save(budgets.withColumn("whole", whole.cast("long")).withColumn("rest", rest.cast("long")), "plan")
    # the epoch that is taken in part
    partly = plan.where("rest > 0").select(*names, "whole", "rest")
    placed = units.join(partly, names).withColumn("place", _place(seed, F.col("whole"), F.col("id")))
    placed = placed.withColumn("bucket", F.shiftright("place", PLACE_BITS - BUCKET_BITS).cast("int")).select(*names, "id", "n", "rest", "place", "bucket")
    placed = scratch.save(placed, "placed")
    sums = placed.groupBy(*names, "bucket").agg(F.sum("n").alias("n"), F.max("rest").alias("rest")).withColumn("group", F.shiftright("bucket", BUCKET_BITS // 2))
    upto = Window.partitionBy(*names)

    def first_beyond(rows: DataFrame, place: str) -> DataFrame:
        """Of each leaf the first place after which the sum is above the rest, and the sum before it."""
        return rows.where("after > rest").groupBy(*names).agg(F.min(place).alias(place), F.min(F.col("after") - F.col("n")).alias("base"))

    # a bucket wholly within the rest is taken whole; the first that isn't is where the prefix ends. A leaf's sums are gone through by groups of
    # buckets and then within one group, so no task gets all buckets of a leaf
    groups = sums.groupBy(*names, "group").agg(F.sum("n").alias("n"), F.max("rest").alias("rest")).withColumn("after", F.sum("n").over(upto.orderBy("group")))
    inside = sums.join(first_beyond(groups, "group"), [*names, "group"]).withColumn("after", F.col("base") + F.sum("n").over(upto.orderBy("bucket"))).drop("base")
    edge = first_beyond(inside, "bucket").withColumnRenamed("bucket", "edge")
    split = placed.join(edge.withColumnRenamed("edge", "bucket"), [*names, "bucket"])
    run = F.sum("n").over(Window.partitionBy(*names).orderBy("place", "id", "n").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = split.withColumn("after", run + F.col("base")).where("after <= rest").groupBy(*names).agg(F.max(F.struct("place", "id", "n")).alias("cut"))
    return scratch.save(plan.join(edge.drop("base"), names, "left").join(cut, names, "left"), "ends")


def mix(
    spark: SparkSession, docs: DataFrame, levels: dict[str, Column], weight: dict[str, Column], tokens: Column, fraction: float, max_epochs: int, seed: int, id_col: str = "doc_id"
) -> DataFrame:
    """docs as the mixture has them: every row once for each epoch in which it is taken, with a last column `epoch`.

    See plan_mixture for the arguments. Rows with the same id and length are taken or left together, as the order can't tell them apart.
    Rows of no tokens go with the epochs whose prefix reaches them; a leaf that has no others is taken once.
    An empty table gives an empty result; other columns go through as they are, but for `epoch`, which is replaced.
    """
    names = list(levels)
    plan = plan_mixture(spark, docs, levels, weight, tokens, fraction, max_epochs, seed, id_col)
    ends = plan.select(*[F.col(n).alias(f"__{n}") for n in names], F.col("whole").alias("__whole"), F.col("rest").alias("__rest"), F.col("edge").alias("__edge"), F.col("cut").alias("__cut"))
    kept = [c for c in docs.columns if c != "epoch"]
    rows = docs.withColumns(_units(docs, levels, tokens, id_col)).join(ends, [f"__{n}" for n in names])
    place = _place(seed, F.col("__whole"), F.col("__id"))
    rows = rows.withColumn("__place", F.when(F.col("__rest") > 0, place))
    bucket = F.shiftright("__place", PLACE_BITS - BUCKET_BITS)
    key = F.struct(F.col("__place").alias("place"), F.col("__id").alias("id"), F.col("__tokens").alias("n"))
    partly = (F.col("__rest") > 0) & (F.col("__edge").isNull() | (bucket < F.col("__edge")) | ((bucket == F.col("__edge")) & (key <= F.col("__cut"))))
    copies = F.col("__whole") + F.coalesce(partly, F.lit(False)).cast("long")
    rows = rows.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return rows.select(*kept, "epoch")
