"""Composite matching, candidates by embedding, min-hash edges and exact splits, against plain versions."""

import itertools
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinscout.operators import discovery, matching, timeseries
from joinscout.plans import graph, ingest, search


def plain_scores(tables, traits):
    """All pairs of all columns."""
    values = {(t, c): {str(r[0]) for r in df.select(F.round(F.col(c).cast("double"), 6) if df.schema[c].dataType.typeName() in ("long", "double") else c).collect() if r[0] is not None} for t, df in tables.items() for c in df.columns}
    rows = {(r["table"], r["column"]): r for r in traits.collect()}
    out = {}
    for a, b in itertools.product(sorted(rows), sorted(rows)):
        if a[0] >= b[0]:
            continue
        x, y = rows[a], rows[b]
        grams = [{f"  {r.name} "[i : i + 3] for i in range(len(r.name) + 1)} for r in (x, y)]
        words = [set(r.name.split("_")) for r in (x, y)]
        like = []
        for m in ("filled", "distinct", "mean", "spread", "length", "digits", "letters"):
            if x[m] is not None and y[m] is not None:
                size = abs(x[m]) + abs(y[m])
                like.append(1 - abs(x[m] - y[m]) / size if size else 1.0)
        common = len(values[a] & values[b])
        cells = {
            "name": 2 * len(grams[0] & grams[1]) / (len(grams[0]) + len(grams[1])),
            "words": len(words[0] & words[1]) / len(words[0] | words[1]),
            "type": 1.0 if x.dtype == y.dtype else 0.7 if x.family == y.family else 0.0,
            "statistics": sum(like) / len(like) if x.family == y.family else None,
            "values": max(common / len(values[a]), common / len(values[b])) if common else 0.0,
        }
        told = [(v, matching.WEIGHTS[m]) for m, v in cells.items() if v is not None]
        out[(*a, *b)] = round(sum(v * w for v, w in told) / sum(w for _, w in told), 6)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    people = spark.createDataFrame([(i, f"n{i}@x.org", f"Name {i}", rng.random(), None) for i in range(60)], "customer_id long, email string, full_name string, score double, note string")
    orders = spark.createDataFrame([(i, i % 40, f"n{i % 50}@x.org", float(i)) for i in range(90)], "order_id long, cust_id long, e_mail string, order_total double")
    other = spark.createDataFrame([(i, 1000 + i, f"Name {i}", True) for i in range(30)], "customerid long, order_no long, fullname string, active boolean")
    return {"people": people, "orders": orders, "other": other}


@pytest.mark.parametrize("threshold", [0.45, 0.55, 0.8])
def test_cube_loses_no_pair(tables, threshold):
    traits = None
    for name, df in tables.items():
        one = matching.column_traits(df, name, approximate=False)
        traits = one if traits is None else traits.unionByName(one)
    overlap = discovery.value_jaccard(discovery.all_values(tables))
    got = {tuple(r[k] for k in matching.KEY): r.score for r in matching.similarity_cube(traits, overlap, threshold).collect()}
    want = {k: s for k, s in plain_scores(tables, traits).items() if s >= threshold}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    assert threshold > 0.5 or want


def test_matches_are_one_to_one(tables):
    overlap = discovery.value_jaccard(discovery.all_values(tables))
    chosen = matching.composite_matches(tables, overlap, 0.5, approximate=False).where("chosen").collect()
    pairs = {(r.left_table, r.left_column, r.right_table, r.right_column) for r in chosen}
    assert ("orders", "e_mail", "people", "email") in pairs and ("other", "customerid", "people", "customer_id") in pairs and ("other", "fullname", "people", "full_name") in pairs
    for left, right in ((0, 2), (2, 0)):
        own = [(r[left], r[left + 1], r[right]) for r in pairs]
        assert len(own) == len(set(own))
    with pytest.raises(ValueError, match="threshold"):
        matching.composite_matches(tables, overlap, 0.2)


def test_margin(spark):
    cube = spark.createDataFrame([("a", "x", "b", "p", 0.8), ("a", "x", "b", "q", 0.78), ("a", "y", "b", "p", 0.6), ("a", "y", "b", "q", 0.5)], "left_table string, left_column string, right_table string, right_column string, score double")
    got = {(r.left_column, r.right_column): (r.within, r.chosen) for r in matching.select_matches(cube, 0.05).collect()}
    assert got == {("x", "p"): (True, True), ("x", "q"): (True, False), ("y", "p"): (False, False), ("y", "q"): (False, False)}


def test_composite_discovery(spark, tables):
    edges = ingest.discover(search.Lake(tables, graph.empty(spark), {}), 0.5, "composite").graph.collect()
    assert any({e.from_id, e.to_id} == {"orders", "people"} and {e.from_column, e.to_column} == {"email", "e_mail"} for e in edges)


def names(n, seed):
    rng = random.Random(seed)
    stems = ["customer", "order", "product", "invoice", "price", "latency", "memory", "limit", "region", "nation", "supplier", "quantity", "discount", "status", "created", "updated", "address", "phone", "account", "balance"]
    ends = ["id", "key", "name", "date", "total", "code", "type", "no", "count", "flag"]
    out = []
    for i in range(n):
        words = rng.sample(stems, rng.randint(1, 2)) + rng.sample(ends, 1)
        out.append((f"t{i % 30}", "_".join(words) + rng.choice(["", "", "_2", "s", rng.choice(string.ascii_lowercase)])))
    return list(dict.fromkeys(out))


def test_embedding_recall(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 100)
    columns = matching.embedded(spark.createDataFrame([(t, c, c) for t, c in names(500, 1)], "table string, column string, text string"), discovery.hashed_ngrams).cache()
    exact = matching.embedding_pairs(columns, 0.6)
    vectors = {(t, c): np.array(discovery.hashed_ngrams(c)) for t, c in names(500, 1)}
    want = {(*a, *b) for a, b in itertools.combinations(sorted(vectors), 2) if a[0] != b[0] and vectors[a] @ vectors[b] >= 0.6}
    assert {tuple(r[k] for k in matching.KEY) for r in exact.collect()} == want and len(want) > 1000
    near = matching.embedding_pairs(columns, 0.6, cells=16)
    r = matching.recall(near, exact).first()
    assert r.n == len(want) and r.recall >= 0.95
    assert near.join(exact, matching.KEY, "anti").count() == 0  # nothing that isn't there


def test_schema_matches_both_ways(spark):
    schemas = {"a": {"user_id": "bigint", "city": "string"}, "b": {"user_id": "bigint", "town": "string"}}
    overlap = spark.createDataFrame([("a", "user_id", "b", "user_id", 0.5)], "left_table string, left_column string, right_table string, right_column string, jaccard double")
    one = discovery.schema_matches(spark, schemas, overlap).collect()
    assert [(r.left_table, r.left_column, r.right_table, r.right_column, r.score) for r in one] == [("a", "user_id", "b", "user_id", 0.75)]
    assert {(r.left_table, r.score) for r in discovery.schema_matches(spark, schemas, overlap, cells=2, both=True).collect()} == {("a", 0.75), ("b", 0.75)}


def test_minhash_recall_at_the_threshold(spark):
    """Sixty pairs of columns with a Jaccard of just 0.5, and as many just below."""
    rows = []
    for p in range(60):
        for i in range(300):
            rows.append((f"l{p:02}", "c", f"{p}:{i}"))
            rows.append((f"r{p:02}", "c", f"{p}:{i + 100}"))  # 200 of 400
            rows.append((f"s{p:02}", "c", f"{p}:{i + 102}"))
    values = spark.createDataFrame(rows, "table string, column string, value string")
    got = {(r.left_table, r.right_table): r.jaccard for r in discovery.minhash_edges(values, 0.5).where("left_table like 'l%'").collect()}
    want = {(f"l{p:02}", f"r{p:02}"): 0.5 for p in range(60)}
    assert set(got) <= set(want) and len(got) >= 59 and set(got.values()) == {0.5}
    assert [discovery.bands_for(t, 128) for t in (0.2, 0.5, 0.8)] == [128, 64, 25]


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_exact_split(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k").repartition(3)
    parts = {"train": 0.65, "validation": 0.15, "test": 0.2}
    rows = timeseries.exact_split(df, "k", parts).collect()
    sizes = {p: sum(r.part == p for r in rows) for p in parts}
    validation = min(n, max(1, round(n * 0.15)))
    assert sizes == {"train": n - validation - min(n - validation, max(1, round(n * 0.2))), "validation": validation, "test": min(n - validation, max(1, round(n * 0.2)))}
    again = {r.k: r.part for r in timeseries.exact_split(df.repartition(5), "k", parts).collect()}
    assert {r.k: r.part for r in rows} == again
    if n == 1000:
        other = {r.k: r.part for r in timeseries.exact_split(df, "k", parts, seed=1).collect()}
        assert sum(other[k] != again[k] for k in again) > 200
