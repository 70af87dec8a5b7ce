"""Search for columns that help: a breadth-first walk over the join graph from a base table.

The walk is planned on the driver over the small graph; each step is a join that is written once (see prefixes), one aggregate for its match ratio, and the
statistics of the new columns.
"""

from __future__ import annotations

import itertools
from collections import Counter, deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policy import SENSITIVE, is_sensitive
from ..operators import selection, stats
from ..operators.augment import unit
from ..operators.joins import asof_join, first_per_key
from ..session import work_dir
from .graph import undirected
from .paths import Step, best_paths, extend, length, needed, parse
from .prefixes import Prefixes

SEP = "__"


@dataclass
class Lake:
    """Tables by name, the edges between them, and for each table the columns that make its rows' order."""

    tables: dict[str, DataFrame]
    graph: DataFrame
    order: dict[str, list[str]] = field(default_factory=dict)

    def prefixed(self, name: str, target: str | None = None) -> DataFrame:
        df = self.tables[name]
        front = [target] if target in df.columns else []
        return df.select(*front, *[F.col(c).alias(f"{name}{SEP}{c}") for c in df.columns if c != target])

    def edges(self) -> list[tuple]:
        rows = undirected(self.graph).distinct().collect()  # pairs of columns of the lake's schema
        return sorted((r.from_id, r.to_id, -r.weight, r.from_column, r.to_column) for r in rows)


@dataclass
class Settings:
    target: str
    value_ratio: float = 0.65
    #: Base rows that the search ranks on; all, if None.
    sample: int | None = None
    classification: bool = False
    relevance: str = "spearman"
    joint: bool = False
    use_relevance: bool = True
    use_redundancy: bool = True
    parity: bool = True
    top_k: int = 15
    temporal_key: str | None = None
    tolerance: float | None = 60
    direction: str = "nearest"


@dataclass
class Found:
    ranking: dict[str, float]
    features: dict[str, list[str]]
    refused: list[str]


def base_sample(df: DataFrame, n: int, key: list[str], target: str | None = None) -> DataFrame:
    """At most n rows by hash of their key; with a target each of its levels in proportion. The sampling is the feature: the search ranks on it, results are made on all rows."""
    place = unit(0, *[F.col(c) for c in key])
    if target is None:
        return df.orderBy(place, *key).limit(n)
    total = df.count()
    counts = df.groupBy(target).count().withColumnRenamed("count", "__n")
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("__n") / max(total, 1)))
    near = df.join(counts, target).where(place <= F.least(F.lit(1.0), 4 * F.lit(n) / max(total, 1) + 50 / F.col("__n")))
    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy(target).orderBy(place, *key)))
    return ranked.where(F.col("__r") <= quota).drop("__n", "__r")


def step_join(lake: Lake, left: DataFrame, step: Step, s: Settings) -> DataFrame | None:
    """One left join of the walk: as-of on the temporal key, else exact with the right side reduced to one row a key."""
    lc, rc = f"{step.source}{SEP}{step.source_column}", f"{step.target}{SEP}{step.target_column}"
    right = lake.prefixed(step.target)
    if lc not in left.columns or rc not in right.columns or any(c in left.columns for c in right.columns):
        return None
    order = [f"{step.target}{SEP}{c}" for c in lake.order.get(step.target, [])] or [c for c in right.columns if c != rc]
    if s.temporal_key and step.source_column == step.target_column == s.temporal_key:
        out = asof_join(left, right, lc, rc, tolerance=s.tolerance, direction=s.direction, order=order[0])
        return out.withColumnRenamed(f"__right_{rc}", rc)
    if left.schema[lc].dataType != right.schema[rc].dataType:
        return None
    return left.join(first_per_key(right, [rc], order), F.col(lc) == F.col(rc), "left")


def numeric(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]


def score_step(df: DataFrame, new: list[str], selected: list[str], s: Settings) -> tuple[float, list[str]] | None:
    """Mean relevance and redundancy of the new columns, and those kept; None if none is."""
    rel = {r.feature: r.score for r in stats.relevance(df, new, s.target, s.relevance).collect()} if new else {}
    if s.use_relevance and not rel:
        return None
    names = sorted(rel) if s.use_relevance else new
    if not s.use_redundancy or not selected:
        value = stats.path_score(list(rel.values()), None)
        return None if value is None else (value, names)
    red = {r.feature: r.score for r in stats.redundancy(df, selected, names, s.target, joint=s.joint, parity=s.parity).collect()}
    if not red:
        return None
    value = stats.path_score([rel[f] for f in red if f in rel] if s.use_relevance else [0.0], list(red.values()))
    return None if value is None else (value, sorted(red))


def prefixes(lake: Lake, base: str, s: Settings, folder: str | None = None, whole: bool = False, ends: set[str] | None = None) -> Prefixes:
    """The trie of joins from a base table under these settings, on the search's sample of it or on all rows.

    With `ends`, the columns at the edges' ends, its tables hold these, the target and numbers only, which is all that a search reads.
    """
    sampled = None if whole else s.sample
    named = Counter(f"{t}{SEP}{c}" for t, df in lake.tables.items() for c in df.columns)

    def kept(df: DataFrame | None) -> DataFrame | None:
        if ends is None or df is None:
            return df
        return df.select(*[f.name for f in df.schema if f.name == s.target or f.name in ends or isinstance(f.dataType, T.NumericType) or named[f.name] > 1])  # a name of two tables stops a join

    def start() -> DataFrame:
        df = lake.prefixed(base, s.target)
        return kept(base_sample(df, sampled, [c for c in df.columns if c != s.target], s.target if s.classification else None) if sampled else df)

    name = repr((base, s.target, sampled, sampled and s.classification, s.temporal_key, s.tolerance, s.direction, *([] if ends is None else [sorted(ends)])))
    return Prefixes(start, lambda df, step: kept(step_join(lake, df, step, s)), name, folder)


def search(lake: Lake, base: str, s: Settings, trie: Prefixes | None = None) -> Found:
    """Walk the graph from the base table. Every accepted join makes the path longer; a refused one leaves it as it was.

    Of the edges to a neighbour those of the largest weight are tried. Paths are known by their steps, not by parts of names, and none is lost. Every
    join is written once to the work folder and read from there; with a trie that other searches have used, their joins and statistics serve again. A trie of
    the search's own holds no text but keys.
    """
    edges = lake.edges()
    trie = trie or prefixes(lake, base, s, ends={f"{e[0]}{SEP}{e[3]}" for e in edges})
    start = trie.frame(base)
    keys = [c for c in start.columns if c != s.target]
    own = numeric(start, keys)
    ranking, features, refused = {base: 0.0}, {base: own}, []
    live: list[tuple[str, list[str]]] = [(base, own)]
    seen, queue = {base}, deque([base])
    while queue:
        node = queue.popleft()
        around = sorted({e[1] for e in edges if e[0] == node} - seen)
        for neighbour in around:
            seen.add(neighbour)
            queue.append(neighbour)
            hits = [e for e in edges if e[0] == node and e[1] == neighbour and e[3] != s.target]
            best = [e for e in hits if e[2] == min(h[2] for h in hits)]
            after = []
            for path, selected in live:
                grown, before = False, trie.frame(path).columns
                for e in best:
                    step = Step(node, e[3], e[4], neighbour)
                    name, key = extend(path, step), f"{neighbour}{SEP}{e[4]}"
                    joined = trie.frame(name)
                    if joined is None:
                        continue
                    if trie.matched(name, key) < s.value_ratio:
                        refused.append(name)
                        continue
                    grown = True
                    new = numeric(joined, [c for c in joined.columns if c not in before and c != key])
                    how = (s.relevance, s.joint, s.use_relevance, s.use_redundancy, s.parity)
                    scored = trie.once(("score", name, tuple(selected), how), lambda: score_step(joined, new, selected, s))  # noqa: B023
                    if scored is None:
                        refused.append(name)
                        after.append((name, selected))
                        continue
                    ranking[name], kept = scored[0], [*selected, *[f for f in scored[1] if f not in selected]]
                    features[name] = kept
                    after.append((name, kept))
                if not grown:
                    after.append((path, selected))
            live = after
    return Found(ranking, features, refused)


def materialise(lake: Lake, path: str, features: list[str], s: Settings, trie: Prefixes | None = None) -> DataFrame:
    """The whole base table with the features: only tables that own one, and those on the way, are joined. A trie of whole rows serves its prefixes."""
    base, steps = parse(path)
    steps = needed(steps, {f.split(SEP, 1)[0] for f in features} - {base})
    out = _joined(lake, base, steps, s, trie)
    return out.select(*[f for f in features if f in out.columns], s.target)


def replay(lake: Lake, path: str, s: Settings, trie: Prefixes | None = None) -> DataFrame:
    """Every join of a path on the whole tables."""
    return _joined(lake, *parse(path), s, trie)


def _joined(lake: Lake, base: str, steps: list[Step], s: Settings, trie: Prefixes | None) -> DataFrame:
    path, out = base, trie.frame(base) if trie else lake.prefixed(base, s.target)
    for step in steps:
        path = extend(path, step)
        out = trie.frame(path) if trie else step_join(lake, out, step, s)
        if out is None:
            raise ValueError(f"step {step} can't be joined")
    return out


def join_all(lake: Lake, base: str, s: Settings, depth_first: bool = False) -> tuple[DataFrame, list[Step]]:
    """Join every table that can be reached, breadth or depth first, by the first key that works; exact even on time unless a temporal key is set."""
    out, steps, seen, todo = lake.prefixed(base, s.target), [], {base}, deque([base])
    edges = lake.edges()
    while todo:
        node = todo.pop() if depth_first else todo.popleft()
        for neighbour in sorted({e[1] for e in edges if e[0] == node} - seen):
            for e in sorted((e for e in edges if e[0] == node and e[1] == neighbour), key=lambda e: e[2:]):
                step = Step(node, e[3], e[4], neighbour)
                joined = step_join(lake, out, step, s)
                if joined is not None:
                    out, _ = joined, steps.append(step)
                    seen.add(neighbour)
                    todo.append(neighbour)
                    break
    return out, steps


def first_step(lake: Lake, edges: list[tuple], base: str, name: str, target: str) -> list[Step]:
    """Steps from the base to a table next to it, the heaviest edge first; never by the target."""
    return [Step(base, e[3], e[4], name) for e in sorted((e for e in edges if e[0] == base and e[1] == name and e[3] != target), key=lambda e: e[2:])]


def join_some(lake: Lake, base: str, names: list[str], s: Settings) -> DataFrame:
    """The base table with the tables next to it that are named, each by the first key that works."""
    out, edges = lake.prefixed(base, s.target), lake.edges()
    for name in names:
        for step in first_step(lake, edges, base, name, s.target):
            joined = step_join(lake, out, step, s)
            if joined is not None:
                out = joined
                break
    return out


def join_sets(lake: Lake, base: str, s: Settings) -> dict[tuple[str, ...], DataFrame]:
    """The base joined with every set of tables next to it, lazily. Left joins in any order give the same columns, so a set stands for all its orders."""
    near = sorted({e[1] for e in lake.edges() if e[0] == base})
    return {c: join_some(lake, base, list(c), s) for n in range(1, len(near) + 1) for c in itertools.combinations(near, n)}


def budget_batches(lake: Lake, base: str, rows: int | None = None) -> list[list[str]]:
    """Tables next to the base in order of name, in batches: a batch is full when its new columns outnumber the base's rows."""
    rows = lake.tables[base].count() if rows is None else rows
    batches, width = [[]], 0
    for name in sorted({e[1] for e in lake.edges() if e[0] == base}):
        if width > rows:
            batches.append([])
            width = 0
        batches[-1].append(name)
        width += len(lake.tables[name].columns)
    return [b for b in batches if b]


def budget_join(lake: Lake, base: str, s: Settings, regression: bool = True, rounds: int = 2, threshold: float = 0.1, seed: int = 7) -> list[str]:
    """Features that stand before random columns, batch by batch of the tables next to the base; those of earlier batches go on with the next.

    Selection sees all base rows, or a sample of `Settings.sample`; what it chooses is materialised on all.
    """
    start = lake.prefixed(base, s.target)
    keys = [c for c in start.columns if c != s.target]
    if s.sample:
        start = base_sample(start, s.sample, keys, s.target if s.classification else None)
    small = Lake(lake.tables | {base: start.withColumnsRenamed({c: c.removeprefix(f"{base}{SEP}") for c in keys})}, lake.graph, lake.order)
    chosen, rows = numeric(start, keys), start.count()
    for batch in budget_batches(lake, base, rows):
        before = sorted({c.split(SEP, 1)[0] for c in chosen} - {base})
        joined = join_some(small, base, [*before, *batch], s)
        new = numeric(joined, [c for c in joined.columns if c.split(SEP, 1)[0] in batch])
        # written once, so its shuffles aren't made again; no column that isn't a feature is joined or kept
        spark, path = joined.sparkSession, work_dir(joined.sparkSession, "budget")
        joined.select(*dict.fromkeys([*chosen, *new]), s.target).write.option("compression", "zstd").parquet(path)
        chosen = selection.random_injection(spark.read.parquet(path), [*chosen, *new], s.target, regression, rounds, threshold=threshold, seed=seed)
    return chosen


def plus_ranking(found: Found, patterns: list[str] | None = None, penalty: float = 0.25) -> dict[str, float]:
    """Ranks of paths less their share of sensitive features and their length."""
    patterns = list(SENSITIVE) if patterns is None else patterns
    risk = {p: sum(is_sensitive(f, patterns) for f in fs) for p, fs in found.features.items()}
    return {p: selection.rerank(r, risk.get(p, 0), len(found.features.get(p, [])), length(p), penalty) for p, r in found.ranking.items()}


def top(found: Found, k: int = 15) -> list[str]:
    return best_paths(found.ranking, k)
