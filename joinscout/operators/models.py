"""Learners of pyspark.ml behind one interface, their metrics and feature importance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir
from .neighbours import KNeighbors
from .trees import ExtraTrees

#: Levels of a text column that have a code of their own, the most frequent ones; the others share so many codes by hash. Both are broadcast or computed in place.
LEVELS, SHARED = 10_000, 64


def text_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each text column as a number: its place among the LEVELS most frequent values (ties by value), then SHARED codes by hash, then one for null."""
    out = df
    for c in columns:
        most = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).count().orderBy(F.desc("count"), "__v").limit(LEVELS)
        ranked = most.select("__v", (F.row_number().over(Window.orderBy(F.desc("count"), "__v")) - 1).cast("double").alias("__code"))  # at most LEVELS rows
        rest = F.when(F.col(c).isNull(), F.lit(float(LEVELS + SHARED))).otherwise(LEVELS + F.pmod(F.xxhash64(c), F.lit(SHARED)))
        out = out.join(F.broadcast(ranked), F.col(c) == F.col("__v"), "left").withColumn(c, F.coalesce("__code", rest.cast("double"))).drop("__v", "__code")
    return out


def prepare(df: DataFrame, target: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Numeric features: times as seconds, booleans as 0 and 1, text as codes; constant columns go, and text that is another on more than nine rows
    in ten (by an approximate count), which names rows. However many levels a text has, it stays. `keep` goes through as it is."""
    names = [c for c in df.columns if c != target and c not in keep]
    flat = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.col(c)).alias(f"u{i}") for i, c in enumerate(names)], *[F.min(c).eqNullSafe(F.max(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    out, features, text = df, [], []
    for i, c in enumerate(names):
        kind, unique = df.schema[c].dataType, flat[f"u{i}"]
        if flat[f"c{i}"] or isinstance(kind, T.StringType) and unique > 0.9 * flat.n:
            continue
        if isinstance(kind, T.StringType):
            text.append(c)
        elif kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
            out = out.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")) / 1e6)
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            out = out.withColumn(c, F.col(c).cast("double"))
        else:
            continue
        features.append(c)
    return text_codes(out, text).select(*features, target, *keep), features


LEARNERS = ("RandomForest", "ExtraTrees", "BoostedTrees", "LinearModel", "Ridge", "KNeighbors")
# Names of boosting libraries that boosted trees stand in for.
BOOSTED = ("LightGBM", "XGBoost")
#: Columns of the pipeline; features and targets may have any other name.
VECTOR, SCALED, TARGET = "__vector", "__scaled", "__target"


def learner_name(name: str) -> str:
    """The learner that is fitted under a name."""
    return "BoostedTrees" if name in BOOSTED else name


def learner(name: str, regression: bool, seed: int = 42):
    """A learner of LEARNERS; boosted trees also under the names of both boosting libraries."""
    at = {"featuresCol": SCALED, "labelCol": TARGET}
    name = learner_name(name)
    if name == "RandomForest":
        return (R.RandomForestRegressor if regression else C.RandomForestClassifier)(**at, seed=seed, numTrees=20)
    if name == "ExtraTrees":
        return ExtraTrees(SCALED, TARGET, regression, seed)
    if name == "KNeighbors":
        return KNeighbors(SCALED, TARGET, 5, regression)
    if name == "BoostedTrees":
        return (R.GBTRegressor if regression else C.GBTClassifier)(**at, seed=seed, maxIter=20)
    if name == "LinearModel":
        return R.LinearRegression(**at, elasticNetParam=1.0, regParam=0.01) if regression else C.LogisticRegression(**at, elasticNetParam=1.0, regParam=0.01)
    if name == "Ridge":
        return R.LinearRegression(**at, elasticNetParam=0.0, regParam=10.0)
    raise ValueError(f"learner {name!r}")


def _numbered(df: DataFrame, features: list[str], target: str, *more: Column) -> DataFrame:
    """Features under reserved names, so a feature or target may be called like any column of the pipeline."""
    return df.select(*[F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias(TARGET), *more)


#: Learners that keep all rows of a partition as one piece, and the values that such a piece has at most, about.
SPREADS, PIECE = ("RandomForest", "BoostedTrees"), 4_000_000


def spread(rows: DataFrame) -> DataFrame:
    """rows as they lie, or if a partition has more than PIECE values dealt to so many that none has, so what a task holds doesn't grow with the rows."""
    most = max(1, PIECE // len(rows.columns))
    found = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    return rows if (found.most or 0) <= most else rows.repartition(-(-found.n // most))


def fit(train: DataFrame, features: list[str], target: str, name: str = "RandomForest", regression: bool = True, seed: int = 42) -> PipelineModel:
    """Median imputation, scaling and the learner."""
    raw, filled = [f"__f{i}" for i in range(len(features))], [f"__g{i}" for i in range(len(features))]
    steps = [Imputer(strategy="median", inputCols=raw, outputCols=filled), VectorAssembler(inputCols=filled, outputCol=VECTOR, handleInvalid="keep"), StandardScaler(inputCol=VECTOR, outputCol=SCALED), learner(name, regression, seed)]
    rows = _numbered(train, features, target).where(F.col(TARGET).isNotNull())
    if learner_name(name) not in SPREADS:
        return Pipeline(stages=steps).fit(rows)
    rows = spread(rows).persist()  # read by each step and by the learner several times
    try:
        return Pipeline(stages=steps).fit(rows)
    finally:
        rows.unpersist()


def predict(model: PipelineModel, df: DataFrame, features: list[str], target: str) -> DataFrame:
    """y and prediction."""
    return model.transform(_numbered(df, features, target)).select(F.col(TARGET).alias("y"), "prediction")


def regression_metrics(df: DataFrame, y: str = "y", prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mae, rmse, mape and r2 over the rows where both are finite, for each of `by`."""
    a, p = F.col(y), F.col(prediction)
    both = a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p) & (F.abs(a) < float("inf")) & (F.abs(p) < float("inf"))
    # a condition inside the aggregate: as a filter it would be put below the prediction and make it anew for each of its comparisons
    a, p = F.when(both, a), F.when(both, p)
    e = p - a
    out = df.groupBy(*by).agg(
        F.count(a).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(F.try_divide(e, F.nullif(a, F.lit(0.0))))).alias("mape"),
        (1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(a) * F.count(a), F.lit(0.0)))).alias("r2"),
    )
    return out.where("n > 0") if by else out


def classification_metrics(df: DataFrame, y: str = "y", prediction: str = "prediction") -> DataFrame:
    """accuracy and macro-F1 over the classes that occur."""
    cells = df.where(F.col(y).isNotNull() & F.col(prediction).isNotNull()).groupBy(F.col(y).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    seen = cells.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("given"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("given"), F.lit(0).cast("long").alias("hit")))).alias("r"))
    per = seen.groupBy("r.c").agg(F.sum("r.actual").alias("actual"), F.sum("r.given").alias("given"), F.sum("r.hit").alias("hit"))
    return per.agg(F.try_divide(F.sum("hit"), F.sum("actual")).alias("accuracy"), F.avg(F.try_divide(2 * F.col("hit"), F.col("actual") + F.col("given"))).alias("macro_f1"))


def forest_importances(df: DataFrame, features: list[str], target: str, regression: bool = True, seed: int = 42) -> dict[str, float]:
    model = fit(df, features, target, "RandomForest", regression, seed).stages[-1]
    return dict(zip(features, model.featureImportances.toArray().tolist(), strict=True))


#: Rows of a bucket within which a feature is permuted, about.
PERMUTED = 50_000


def permuted(df: DataFrame, features: list[str], target: str, seed: int = 42) -> DataFrame:
    """`feature` and the rows once for each feature, with that one taken from another row; and once as they are, of null `feature`.

    Rows are dealt to buckets and there put in an order for each feature, and one more, by hashes of the row's own number and a seed, never of a value. A
    feature's value goes to the row that has its place in the last order, so it is a permutation of the bucket. One shuffle by bucket serves all features.
    """
    path = work_dir(df.sparkSession, "permuted")
    df.select(*features, target).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    buckets = max(1, rows.count() // PERMUTED)
    n = len(features)
    dealt = _numbered(rows, features, target, F.col("__id"), F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(buckets)).alias("__bucket")).repartition("__bucket")
    dealt = dealt.withColumns({f"__h{i}": F.xxhash64("__id", F.lit(seed + 1 + i)) for i in range(n + 1)})
    names = [*[f"__f{i}" for i in range(n)], TARGET]

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(batches)
        order = lambda i: np.lexsort((bucket["__id"].to_numpy(), bucket[f"__h{i}"].to_numpy()))
        last = order(n)
        yield from _named(bucket.select(names), None)
        taken = bucket.select(names).take(pa.array(last)).combine_chunks()
        for i in range(n):
            yield from _named(taken.set_column(i, f"__f{i}", bucket[f"__f{i}"].take(pa.array(order(i)))), features[i])

    kinds = ", ".join(f"{c} double" for c in names)
    return dealt.groupBy("__bucket").applyInArrow(mix, f"feature string, {kinds}")


def _named(rows: pa.Table, feature: str | None) -> list[pa.RecordBatch]:
    """rows with the feature's name before them."""
    return rows.add_column(0, "feature", pa.array([feature], pa.string()).take(pa.array(np.zeros(len(rows), np.int64)))).to_batches(10_000)


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], target: str, regression: bool = True, seed: int = 42) -> dict[str, float]:
    """How much the score (r2 or accuracy) falls when a feature is taken from another row. All features are scored in one job."""
    out = model.transform(permuted(df, features, target, seed)).select("feature", F.col(TARGET).alias("y"), "prediction")
    if regression:
        scores = regression_metrics(out, by=("feature",)).select("feature", F.coalesce("r2", F.lit(0.0)).alias("score"))
    else:
        scores = out.where("y is not null and prediction is not null").groupBy("feature").agg(F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("score"))
    by = {r.feature: r.score for r in scores.collect()}
    return {f: by.get(None, 0.0) - by.get(f, 0.0) for f in features}


def discriminative_accuracy(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> float:
    """How well a logistic regression tells two samples apart; 0.5 if not at all."""
    rows = real.select(*columns, F.lit(0.0).alias("y")).unionByName(synthetic.select(*columns, F.lit(1.0).alias("y")))
    model = fit(rows, columns, "y", "LinearModel", regression=False)
    return classification_metrics(predict(model, rows, columns, "y")).first().accuracy


def lag_forecast(windows: DataFrame, size: int, name: str = "LinearModel", seed: int = 42) -> PipelineModel:
    """A learner on the window's values."""
    lags = [f"lag{i}" for i in range(size)]
    return fit(windows.select(*[F.get("window", F.lit(i)).alias(c) for i, c in enumerate(lags)], "y"), lags, "y", name, True, seed)


def probabilities(model: PipelineModel, df: DataFrame, features: list[str], target: str) -> DataFrame:
    return model.transform(_numbered(df, features, target)).select(F.col(TARGET).alias("y"), vector_to_array("probability").alias("probability"))


def tensor(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, tensor: each group's values as one array in the given order; a group is as long as one sample of a measurement."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v")))), lambda x: x["v"]).alias("tensor"))
