"""Redundancy counts rows where they lie, against the plain form; a search's own tables hold no text."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from joinscout.operators import stats
from joinscout.plans import graph, search


def information(pairs):
    pairs = [p for p in pairs if None not in p]
    if not pairs:
        return None
    h = lambda c: math.log(len(pairs)) - sum(n * math.log(n) for n in c.values()) / len(pairs)
    return h(Counter(p[0] for p in pairs)) + h(Counter(p[1] for p in pairs)) - h(Counter(pairs))


@pytest.mark.parametrize("bins", [5, 30])
def test_redundancy_is_that_of_plain_counts(spark, bins):
    draw = random.Random(6)
    some = lambda v: None if draw.random() < 0.15 else v
    names = [f"c{i}" for i in range(12)]
    data = []
    for _ in range(400):
        a, b = draw.gauss(0, 1), draw.random()
        data.append((*[some(round(a * i + b * (11 - i), 3)) for i in range(10)], 4.0, None, some(float("nan") if draw.random() < 0.1 else float(int(3 * a)))))
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in [*names, "t"])).repartition(3)
    new, selected = [*names[:5], names[10], names[11]], names[5:10]
    binned = [tuple(r) for r in stats.bin_uniform(df, names, bins).select(*names, F.nullif("t", F.lit(float("nan")))).collect()]
    column = dict(zip([*names, "t"], zip(*binned, strict=True), strict=True))
    got = {r.feature: r.raw for r in stats.redundancy(df, selected, new, "t", bins, parity=False).collect()}
    assert set(got) == {*names[:5], names[10]}  # a column without values has no score
    for f in got:
        mine = [information(list(zip(column[f], column[c], strict=True))) for c in ("t", *selected)]
        assert got[f] == pytest.approx(mine[0] - sum(mine[1:]) / len(selected), abs=2e-9)
    alone = {r.feature: r.raw for r in stats.redundancy(df, [], new, "t", bins, parity=False).collect()}
    assert set(alone) == set(got) and all(alone[f] == pytest.approx(information(list(zip(column[f], column["t"], strict=True))), abs=2e-9) for f in got)


def test_pairs_of_a_block_take_one_cell_a_row(spark):
    names = ["a", "b", "c", "d", "e"]
    df = spark.range(50).select(*[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(names)], F.col("id").cast("double").alias("t"))
    out = stats.redundancy(df, names[:3], names[3:], "t", parity=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    below = [next(k for line in lines[at + 1 :] for k in ("Aggregate", "Join") if k in line) for at, line in enumerate(lines) if "Generate" in line]
    assert below and set(below) == {"Aggregate"}  # rows are counted before anything is multiplied
    assert out.count() == 2


def test_a_search_of_its_own_writes_no_text_but_keys(spark, tmp_path):
    base = spark.range(200).select(F.concat(F.lit("k"), F.col("id") % 20).alias("key"), F.lit("long text").alias("note"), (F.col("id") * 7 % 50).alias("n"), (F.col("id") % 20 * 3).cast("double").alias("t"))
    other = spark.range(20).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit("more text").alias("words"), (F.col("id") * 7 % 20).alias("v"))
    lake = search.Lake({"base": base, "other": other}, graph.edges(spark, [("base", "other", "key", "key", 1.0)]))
    s = search.Settings("t", parity=False)
    seen = []
    make = search.prefixes
    search.prefixes = lambda *a, **k: seen.append(make(*a, **k)) or seen[-1]
    try:
        own = search.search(lake, "base", s)
    finally:
        search.prefixes = make
    whole = make(lake, "base", s, str(tmp_path / "whole"))
    assert search.search(lake, "base", s, whole) == own and len(own.ranking) == 2
    assert all("base__note" in df.columns for df in whole.tables.values())
    assert {c for df in seen[0].tables.values() for c in df.columns} == {"t", "base__key", "base__n", "other__key", "other__v"}
