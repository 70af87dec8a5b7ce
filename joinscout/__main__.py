"""Command line: diagnose a table, list, infer or match connections, augment a base table, sweep settings, segment, fill and split tables."""

from __future__ import annotations

import argparse
import json

from . import session
from .api import AugmentationConfig, ablation, augment_features
from .api import sweep as sweep_settings
from .functions import columns
from .operators import discovery, matching, profile, timeseries
from .plans import ingest
from .sources import lake as lakes
from .sources import sinks
from .sources.registry import read_registry


def _lake(spark, args):
    return lakes.open_lake(spark, args.folder, args.ending, args.connections)


def diagnose(spark, args):
    print(json.dumps(profile.diagnose(lakes.read_table(spark, args.table), args.target), indent=1, default=str))


def infer(spark, args):
    found = ingest.relationships(_lake(spark, args))
    best = discovery.recommend(found, args.confidence)
    print(discovery.report(found, best))
    if args.out:
        discovery.connections(best).coalesce(1).write.mode("overwrite").option("header", True).csv(args.out)


def plan(spark, args):
    best = discovery.recommend(ingest.relationships(_lake(spark, args)), args.confidence)
    print(json.dumps(discovery.join_plan(best, args.base), indent=1))


def ablate(spark, args):
    print(json.dumps(ablation(args.base, _lake(spark, args), AugmentationConfig(args.target, temporal_key=args.temporal_key)), indent=1))


def registry(spark, args):
    columns.datasets(read_registry(spark, args.file), args.label, args.problem).show(100, truncate=False)


def augment(spark, args):
    result = augment_features(args.base, _lake(spark, args), AugmentationConfig(args.target, temporal_key=args.temporal_key, value_ratio=args.value_ratio, policies=tuple(args.policy)))
    print(json.dumps(result.to_dict(), indent=1))
    if args.out:
        print(sinks.write_augmented(result.table, args.out, args.base, result.path))


def segment(spark, args):
    timeseries.write_segments(timeseries.gap_segments(lakes.read_timed(spark, args.table, args.time), args.time, [], args.gap), args.out, [])


def sweep(spark, args):
    ratios = tuple(float(r) for r in args.value_ratios)
    print(json.dumps(sweep_settings(args.base, _lake(spark, args), AugmentationConfig(args.target, algorithm=args.algorithm), tuple(range(1, args.most + 1)), ratios), indent=1))


def match(spark, args):
    tables = _lake(spark, args).tables
    found = matching.composite_matches(tables, discovery.value_jaccard(discovery.all_values(tables)), args.threshold, args.margin)
    for r in found.orderBy(*matching.KEY).collect():  # pairs of columns
        print(f"{r.left_table}.{r.left_column} = {r.right_table}.{r.right_column} ({r.score:.2f}{', chosen' if r.chosen else ''})")


def impute(spark, args):
    table = lakes.read_table(spark, args.table)
    names = args.column or [c for c, t in table.dtypes if t in ("double", "float", "int", "bigint") and c != args.time]
    timeseries.impute(table, names, args.time, args.by, args.method).write.mode("overwrite").parquet(args.out)


def split(spark, args):
    parts = {name: float(size) for name, size in (p.split("=", 1) for p in args.part)} or {"train": 0.8, "test": 0.2}
    timeseries.exact_split(lakes.read_table(spark, args.table), args.key, parts, args.seed).write.mode("overwrite").partitionBy("part").parquet(args.out)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("joinscout")
    sub = p.add_subparsers(required=True)

    def command(f, *names, **more):
        c = sub.add_parser(f.__name__)
        for n in names:
            c.add_argument(n)
        for k, v in more.items():
            c.add_argument(f"--{k.replace('_', '-')}", **(v if isinstance(v, dict) else {"default": v, "type": type(v) if v is not None else str}))
        c.set_defaults(run=f)

    command(diagnose, "table", "target")
    command(infer, "folder", ending=".csv", connections=None, confidence=0.7, out=None)
    command(plan, "folder", "base", ending=".csv", connections=None, confidence=0.7)
    command(ablate, "folder", "base", "target", ending=".csv", connections=None, temporal_key=None)
    command(registry, "file", label={"action": "append", "default": []}, problem=None)
    command(augment, "folder", "base", "target", ending=".csv", connections=None, temporal_key=None, value_ratio=0.65, policy={"action": "append", "default": []}, out=None)
    listed = {"action": "append", "default": []}
    command(sweep, "folder", "base", "target", ending=".csv", connections=None, algorithm="RandomForest", most=20, value_ratios=listed)
    command(match, "folder", ending=".csv", connections=None, threshold=0.55, margin=0.05)
    command(impute, "table", "out", time="time", by=listed, column=listed, method="linear")
    command(split, "table", "key", "out", part=listed, seed=42)
    command(segment, "table", "out", time="time", gap=60.0)
    args = p.parse_args(argv)
    args.run(session.build(), args)


if __name__ == "__main__":
    main()
