"""Scoring columns by use and privacy risk, and choosing among them."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policy import SENSITIVE, is_sensitive
from ..functions.scalars import numeric_clean
from . import stats

PENALTIES = {"privacy": 0.25, "missing": 0.10, "cost": 0.001}


def score_features(df: DataFrame, target: str, patterns: Iterable[str] = SENSITIVE, proxy: float = 0.999, approximate: bool = True) -> DataFrame:
    """feature, utility (absolute Spearman of the rows that have both), the three risks and their sum, missing_ratio, score_plus.

    Utility is 0 below three values or for a constant. Nothing but one row a feature leaves the cluster's aggregates. A text column of which more than nine values in ten are distinct
    names rows (identifier_risk); distinct values are counted approximately, to a hundredth, unless `approximate` is false, which multiplies rows by text columns.
    """
    patterns = list(patterns)
    names = [c for c in df.columns if c != target]
    numeric = {c: isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in names}
    as_numbers = df.select(*[F.col(c).cast("double").alias(c) if numeric[c] else numeric_clean(F.col(c)).alias(c) for c in names if numeric[c] or isinstance(df.schema[c].dataType, T.StringType)], F.col(target).cast("double").alias(target))
    usable = [c for c in as_numbers.columns if c != target]
    n = F.count(F.lit(1))
    flat = df.agg(*[x.alias(f"{k}_{i}") for i, c in enumerate(names) for k, x in (("u", F.lit(0.0) if numeric[c] else F.coalesce(F.try_divide(F.approx_count_distinct(c, 0.01) if approximate else F.count_distinct(c), n), F.lit(0.0))), ("m", F.coalesce(1 - F.try_divide(F.count(F.col(c)), n), F.lit(0.0))))])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(int(is_sensitive(c, patterns))).alias("pattern_risk"), ((F.col(f"u_{i}") > 0.9) & F.lit(not numeric[c])).cast("int").alias("identifier_risk"), F.col(f"m_{i}").alias("missing_ratio"))
            for i, c in enumerate(names)
        ]
    )
    out = flat.select(F.explode(rows).alias("r")).select("r.*")
    use = stats.spearman(as_numbers, usable, target).select("feature", F.when(F.col("n") >= 3, F.round(F.abs("correlation"), 9)).otherwise(F.lit(0.0)).alias("utility"))
    out = out.join(use, "feature", "left").withColumn("utility", F.coalesce("utility", F.lit(0.0)))
    out = out.withColumn("proxy_risk", (F.col("utility") >= proxy).cast("int"))
    out = out.withColumn("privacy_risk", F.col("pattern_risk") + F.col("proxy_risk") + F.col("identifier_risk"))
    plus = F.col("utility") - PENALTIES["privacy"] * F.col("privacy_risk") - PENALTIES["missing"] * F.col("missing_ratio") - PENALTIES["cost"]
    return out.withColumn("score_plus", F.round(plus, 9)).select("feature", "utility", "pattern_risk", "proxy_risk", "identifier_risk", "privacy_risk", "missing_ratio", "score_plus")


@dataclass
class Selection:
    features: list[str]
    blocked: list[str]
    sensitive: list[str]
    scores: DataFrame
    privacy_risk: float


def chosen(scores: DataFrame, k: int = 50, block: bool = True, most_missing: float = 0.95) -> DataFrame:
    """The k best by score_plus, utility and name that are neither blocked by pattern nor mostly missing; if none is left, the least risky ones."""
    open_ = scores.where(F.col("missing_ratio") <= most_missing).withColumn("free", F.lit(not block) | (F.col("pattern_risk") == 0))
    some = F.max("free").over(Window.partitionBy(F.lit(0)))  # one row a feature
    ranked = open_.withColumn("some", some).where("free or not some")
    fallback = ~F.col("some")
    return ranked.orderBy(
        F.when(fallback, F.col("privacy_risk")).otherwise(F.lit(0)), F.when(fallback, F.col("missing_ratio")).otherwise(F.lit(0.0)), F.when(fallback, F.lit(0.0)).otherwise(-F.col("score_plus")), F.desc("utility"), "feature"
    ).drop("free", "some").limit(k)


def select_features(df: DataFrame, target: str, k: int = 50, patterns: Iterable[str] = SENSITIVE, block: bool = True) -> Selection:
    """Scores and the choice; a row a feature reaches the driver."""
    scores = score_features(df, target, patterns).cache()
    rows, best = scores.collect(), chosen(scores, k, block).collect()
    return Selection([r.feature for r in best], sorted(r.feature for r in rows if block and r.pattern_risk), sorted(r.feature for r in rows if r.privacy_risk), scores, float(sum(r.privacy_risk for r in best)))


def rerank(rank: float, risk: float, n_features: int, path_length: int, penalty: float = 0.25) -> float:
    """A path's rank less its risk a feature and its length."""
    return rank - penalty * (risk / max(n_features, 1)) - 0.01 * path_length


def inject_noise(df: DataFrame, features: list[str], part: float = 0.2, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """Random columns, ceil(part * features), normal with the rows' means and the rows' covariance over the features.

    Such a column is the row's mean plus the sum of its features' differences to it, each times one normal number for all rows, over
    the root of features - 1; so no matrix of rows by rows is needed, and a column is a sum of the features with fixed weights. Null counts as 0.
    """
    count = max(0, -int(-part * len(features) // 1))
    names = [f"__noise_{i}" for i in range(count)]
    out, draw = df, random.Random(seed).gauss
    for n in names:
        z = [draw(0, 1) / max(len(features) - 1, 1) ** 0.5 for _ in features]
        of_mean = (1.0 - sum(z)) / len(features)
        out = out.withColumn(n, sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * (w + of_mean) for c, w in zip(features, z, strict=True)), F.lit(0.0)))
    return out, names


def before_noise(importances: list[float], is_noise: list[bool], size: int) -> list[int]:
    """For each of the first `size` features 1 if it ranks before every random one, else 0."""
    order = sorted(range(len(importances)), key=lambda i: -importances[i])
    out = [0] * size
    for i in order:
        if is_noise[i]:
            break
        if i < size:
            out[i] = 1
    return out


def stable_features(rounds: list[list[int]], threshold: float) -> list[int]:
    """Features that came before the noise in more than `threshold` of the rounds."""
    if not rounds:
        return []
    return [i for i in range(len(rounds[0])) if sum(r[i] for r in rounds) / len(rounds) > threshold]


def by_threshold(rounds: list[list[int]], features: list[str], thresholds: Iterable[float], score: Callable[[list[str]], float]) -> list[str]:
    """The features of the last threshold, going up, before the score falls; none if the first has none."""
    best, chosen = None, []
    for t in sorted(thresholds):
        some = [features[i] for i in stable_features(rounds, t)]
        if not some:
            break
        now = score(some)
        if best is not None and now < best:
            break
        best, chosen = now, some
    return chosen


def random_injection(df: DataFrame, features: list[str], target: str, regression: bool = True, rounds: int = 10, part: float = 0.2, threshold: float = 0.1, seed: int = 7) -> list[str]:
    """Features that forests put before random columns in more than a part of the rounds; the forests of all rounds grow together."""
    from . import forests

    if not features or not rounds:
        return []
    noises = max(0, -int(-part * len(features) // 1))
    noisy, few = forests.condensed(df, features, target, len(features) + rounds * noises)
    sets = []
    for r in range(rounds):
        noisy, noise = inject_noise(noisy, features, part, seed + 100 * r)
        noisy = noisy.withColumnsRenamed({n: f"{n}_{r}" for n in noise})
        sets.append([*features, *[f"{n}_{r}" for n in noise]])
    scores = forests.importances(noisy, few, target, sets, [seed + r for r in range(rounds)], regression)
    votes = [before_noise([s[c] for c in names], [i >= len(features) for i in range(len(names))], len(features)) for s, names in zip(scores, sets, strict=True)]
    return [features[i] for i in stable_features(votes, threshold)]
