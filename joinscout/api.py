"""The programmatic surface: augment a base table from a lake, and compare with simpler ways."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.columns import time_column
from .functions.policy import SENSITIVE, policy_patterns
from .operators import models, profile, selection, stats
from .operators.timeseries import chronological_split, seeded_split
from .plans import paths
from .plans.ingest import discover
from .plans.search import SEP, Lake, Settings, budget_join, join_all, join_some, materialise, numeric, plus_ranking, prefixes, search


@dataclass
class AugmentationConfig:
    target: str
    approaches: tuple[str, ...] = ("BASE", "Join_All", "Filter", "Plus", "Search")  # and "ARDA"
    algorithm: str = "RandomForest"
    value_ratio: float = 0.65
    top_k: int = 15
    temporal_key: str | None = None
    tolerance: float | None = 60
    direction: str = "nearest"
    policies: tuple[str, ...] = ("none",)
    split_key: str | None = None
    seed: int = 42
    #: Base rows that the search ranks on; all, if None.
    sample: int | None = None


@dataclass
class AugmentationResult:
    """The augmented table, the approaches' scores, and the path it came by."""

    table: DataFrame
    path: str
    features: list[str]
    results: list[dict] = field(default_factory=list)

    def lift(self) -> float | None:
        """Score of the search less that of the base table alone."""
        by = {r["approach"]: r["score"] for r in self.results}
        return by["Search"] - by["BASE"] if "Search" in by and "BASE" in by else None

    def to_dict(self) -> dict:
        return {"path": self.path, "features": self.features, "results": self.results, "lift": self.lift()}


def split(df: DataFrame, c: AugmentationConfig) -> DataFrame:
    """`is_train`: by time where there is a temporal key (its name bare or prefixed), else seeded."""
    key = time_column(df.columns, c.temporal_key)
    if key:
        return chronological_split(df, key, df.columns[0])
    return seeded_split(df, c.split_key or df.columns[0], {"train": 0.8, "test": 0.2}, c.seed).withColumn("is_train", F.col("part") == "train").drop("part")


def evaluate_split(rows: DataFrame, c: AugmentationConfig, approach: str, regression: bool) -> dict:
    """Fit on the rows of `is_train` and score on the others; text and times become numbers. Without features the score is 0."""
    began = time.time()
    ready, names = models.prepare(rows, c.target, ("is_train",))
    if not regression:
        from pyspark.ml.feature import StringIndexer

        ready = StringIndexer(inputCol=c.target, outputCol="__y", handleInvalid="skip", stringOrderType="alphabetAsc").fit(ready).transform(ready).drop(c.target).withColumnRenamed("__y", c.target)
    if not names:
        return {"approach": approach, "algorithm": models.learner_name(c.algorithm), "score": 0.0, "n_features": 0, "total_time": 0.0, "features": []}
    model = models.fit(ready.where("is_train"), names, c.target, c.algorithm, regression, c.seed)
    out = models.predict(model, ready.where("not is_train"), names, c.target)
    row = (models.regression_metrics(out).first().r2 if regression else models.classification_metrics(out).first().accuracy) or 0.0
    return {"approach": approach, "algorithm": models.learner_name(c.algorithm), "score": float(row), "n_features": len(names), "total_time": time.time() - began, "features": names}


def evaluate(df: DataFrame, features: list[str], c: AugmentationConfig, approach: str, base: str, regression: bool) -> dict:
    """evaluate_split of the features, on the split of the whole frame."""
    rows = split(df, c)
    return evaluate_split(rows.select(*[f for f in features if f in df.columns], c.target, "is_train"), c, approach, regression)


def _settings(c: AugmentationConfig, regression: bool, **change) -> Settings:
    return Settings(**({"target": c.target, "value_ratio": c.value_ratio, "classification": not regression, "top_k": c.top_k, "temporal_key": c.temporal_key, "tolerance": c.tolerance, "direction": c.direction, "sample": c.sample} | change))


def ablation(base: str, lake: Lake, config: AugmentationConfig, variants: dict[str, dict] | None = None) -> list[dict]:
    """Results of the search with some of its settings changed: other correlation, joint information, no relevance, no redundancy, match ratios.

    All variants share their joins, as long as they don't change what a join is.
    """
    variants = variants or {"pearson": {"relevance": "pearson"}, "joint": {"joint": True}, "no_relevance": {"use_relevance": False}, "no_redundancy": {"use_redundancy": False}}
    c, out, done = config, [], {}
    regression = profile.problem_type(lake.tables[base], c.target) == "regression"
    shared: dict[str, tuple] = {}
    for name, change in variants.items():
        k = change.get("top_k", c.top_k)
        s = _settings(c, regression, **change)
        made = prefixes(lake, base, s)
        ranked, whole = shared.setdefault(made.name, (made, prefixes(lake, base, s, whole=True) if s.sample else made))
        found = search(lake, base, s, ranked)
        path = (paths.best_paths(found.ranking, k) or [base])[0]
        features = found.features.get(path, [])[:k] if "top_k" in change else found.features.get(path, [])
        key = (path, tuple(features))
        if key not in done:  # the same features of the same path score the same
            done[key] = evaluate(materialise(lake, path, features, s, whole), features, c, name, base, regression)
        out.append(done[key] | {"approach": name, "path": path, "joins_made": ranked.made})
    return out


def sweep(base: str, lake: Lake, config: AugmentationConfig, ks: tuple[int, ...] = tuple(range(1, 21)), value_ratios: tuple[float, ...] = ()) -> list[dict]:
    """Results for each number of features of the best path, the first k in the order they were selected, and for each match ratio. Each prefix is joined once for all of them."""
    variants = {f"k={k}": {"top_k": k} for k in ks} | {f"value_ratio={r:g}": {"value_ratio": r} for r in value_ratios}
    return ablation(base, lake, config, variants)


def augment_features(base: str, lake: Lake, config: AugmentationConfig) -> AugmentationResult:
    """Search the lake from the base table and materialise the best path on all rows; other approaches are scored beside it."""
    c = config
    if lake.graph.isEmpty():
        lake = discover(lake)
    kind = profile.problem_type(lake.tables[base], c.target)
    regression = kind == "regression"
    s = _settings(c, regression)
    trie = prefixes(lake, base, s)
    results = []
    start = lake.prefixed(base, c.target)
    own = [f for f in start.columns if f != c.target]
    if "BASE" in c.approaches:
        results.append(evaluate(start, own, c, "BASE", base, regression))
    if {"Join_All", "Filter", "Plus"} & set(c.approaches):
        exact = Settings(target=c.target)  # joins on time are exact here
        whole, _ = join_all(lake, base, exact)
        names = numeric(whole, [f for f in whole.columns if f != c.target])
        if "Join_All" in c.approaches:
            results.append(evaluate(whole, names, c, "Join_All", base, regression))
        if "Filter" in c.approaches:
            half = [r.feature for r in stats.top_half(whole, names, c.target).collect()]
            results.append(evaluate(whole, half, c, "Filter", base, regression))
        if "Plus" in c.approaches:
            chosen = selection.select_features(whole.select(*names, c.target), c.target, c.top_k, [*SENSITIVE, *policy_patterns(c.policies)])
            results.append(evaluate(whole, chosen.features, c, "Plus", base, regression))
    if "ARDA" in c.approaches:
        names = budget_join(lake, base, s, regression)
        owners = sorted({n.split(SEP, 1)[0] for n in names} - {base})
        results.append(evaluate(join_some(lake, base, owners, s), names, c, "ARDA", base, regression))
    found = search(lake, base, s, trie)
    ranking = found.ranking if set(c.policies) == {"none"} else plus_ranking(found, [*SENSITIVE, *policy_patterns(c.policies)])
    best = paths.best_paths(ranking, c.top_k)
    path = best[0] if best else base
    features = found.features.get(path, own)
    table = materialise(lake, path, features, s, None if s.sample else trie)
    if "Search" in c.approaches:
        results.append(evaluate(table, features, c, "Search", base, regression))
    return AugmentationResult(table, path, features, results)
