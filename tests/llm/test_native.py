import hashlib
import random

import pytest
from pyspark.sql import functions as F

from joinscout.llm import exact_dedup, line_dedup, mixing


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_directory_splits_until_it_fits():
    rows = exact_dedup.split_directory({0: 5, 1: 1, 2: 1, 3: 1}, 4, bits=2)
    assert sorted(rows) == [(0, 0, 2), (1, 1, 2), (2, 2, 1), (3, 2, 1)]
    assert {b for _, b, _ in exact_dedup.split_directory({}, 4, bits=3)} == {0}


def test_owners_have_ranges_of_keys():
    rng = random.Random(3)
    load = {s: rng.randint(1, 50) for s in range(64)}
    rows = exact_dedup.with_owners(exact_dedup.split_directory(dict.fromkeys(range(64), 1), 1, bits=6), load, 5)
    owners = [o for *_, o in sorted(rows)]
    assert owners == sorted(owners) and set(owners) == set(range(5))
    each = [sum(load[s] for s, _, _, o in rows if o == k) for k in range(5)]
    assert max(each) - min(each) <= 2 * max(load.values())
    assert {o for *_, o in exact_dedup.with_owners([(0, 0, 0)], {}, 7)} == {0}


def test_index_files_are_key_ranges(spark):
    df = spark.createDataFrame([(i, f"text {i % 150}") for i in range(400)], "doc_id long, text string").repartition(5)
    index = exact_dedup.build_index(spark, df)
    rows = index.entries.select("owner", "bucket", F.col("key"), F.input_file_name().alias("file")).collect()
    unsigned = lambda k: k % (1 << 64)
    spans = {}
    for r in rows:
        spans.setdefault(r.file, []).append(unsigned(r.key))
    edges = sorted((min(k), max(k)) for k in spans.values())
    assert len(edges) > 1 and all(a[1] < b[0] for a, b in zip(edges[:-1], edges[1:], strict=True))
    assert all(len({r.owner for r in rows if r.file == f}) == 1 for f in spans)
    plan = exact_dedup.exact_groups(spark, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_groups(spark):
    docs = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 100_000), (8, "X" * 100_000)]
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, key int, chain int").repartition(3)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(spark, df, capacity=2).collect()}
    for i, t in docs:
        same = [j for j, u in docs if lower(u) == lower(t)]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(lower(t).encode()).hexdigest())
    kept = exact_dedup.deduplicate(spark, df)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8] and kept.columns == df.columns


def test_exact_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(spark, empty).count() == 0 and exact_dedup.deduplicate(spark, empty).count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "c"), (2, "c")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.deduplicate(spark, df).collect()), key=repr) == [(1, "a"), (2, "c"), (None, "b")]


def brute_lines(docs, least):
    """Every run of worded lines, of any length, that has enough words and occurs before."""
    import re

    split = {i: t.split("\n") for i, t in docs}
    worded = {i: [(p, x) for p, x in enumerate(ls) if re.search(line_dedup.WORD, x)] for i, ls in split.items()}
    n_words = lambda run: sum(len(re.findall(line_dedup.WORD, x)) for _, x in run)
    seen, gone = {}, {i: set() for i in split}
    for i in sorted(split):
        for a in range(len(worded[i])):
            for b in range(a + 1, len(worded[i]) + 1):
                run = worded[i][a:b]
                if n_words(run) >= least:
                    key = tuple(x for _, x in run)
                    if key in seen and seen[key] < (i, a):
                        gone[i].update(range(run[0][0], run[-1][0] + 1))
                    else:
                        seen.setdefault(key, (i, a))
    return {i: "\n".join(x for p, x in enumerate(ls) if p not in gone[i]) for i, ls in split.items()}


@pytest.mark.parametrize("seed", range(3))
def test_lines_against_every_run(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 4))) for _ in range(9)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(25)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark, df, min_words=7).collect()}
    assert got == brute_lines(docs, 7)


@pytest.mark.parametrize("hot", [1, 8, 1000])
def test_lines_however_names_are_joined(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(hot)
    common, pool = "a b", ["c", "d e f", "g h", "i", "", "j k l m"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else common for _ in range(rng.randint(0, 40)))) for i in range(30)]
    docs += [(100, "\n".join(["c"] * 60)), (101, "\n".join(["c"] * 33))]  # overlaps itself; 33 lines lie in 60
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (2, 5):
        got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark, df.repartition(n), min_words=20).collect()}
        assert got == brute_lines(docs, 20)


def test_ranks_are_the_order_of_suffixes(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(4, 12)))) for i in range(12)]
    scratch = line_dedup.Scratch(spark, "lines")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows, levels = line_dedup.suffix_ranks(scratch, df, "doc_id", "text", 4)
    name = {r.own_id: r.a for r in line_dedup.line_ids(df, "doc_id", "text", 4).select(F.concat_ws(":", "doc", "i").alias("own_id"), "a").collect()}
    suffix = lambda r, n: tuple(name[f"{r.doc}:{i}"] for i in range(r["at"], r["at"] + n) if f"{r.doc}:{i}" in name)
    assert levels == 2
    found = rows.collect()
    for k in range(levels + 1):
        whole = [(suffix(r, 1 << k), r[f"r{k}"]) for r in found if len(suffix(r, 1 << k)) == 1 << k]
        ranked = sorted(x for x in whole if x[1] is not None)
        assert [x[1] for x in ranked] == sorted(x[1] for x in ranked) and len({x[0] for x in ranked}) == len({x[1] for x in ranked})
        alone = [x[0] for x in whole if x[1] is None]
        assert len(alone) == len(set(alone)) and not set(alone) & {x[0] for x in ranked}


def test_line_edges(spark):
    run = "one two three\nfour five"
    df = spark.createDataFrame([(1, run, 0), (2, f"x\n{run}\ny", 0), (3, None, 0), (4, "", 0), (5, run, 0), (5, run, 0)], "doc_id long, text string, n_lines int")
    out = line_dedup.deduplicate_lines(spark, df, min_words=5)
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in out.collect())
    assert got == [(1, run, 0), (2, "x\ny", 2), (3, None, 0), (4, "", 0), (5, "", 2), (5, "", 2)]
    assert line_dedup.deduplicate_lines(spark, df.limit(0)).count() == 0


def mixed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n long, whole int")
    levels, even = {c: F.col(c) for c in ("lang", "source")}, {c: F.lit(1) for c in ("lang", "source")}
    return mixing.mix(spark, df, levels, even, F.col("n"), **({"fraction": 0.5, "max_epochs": 1, "seed": 3} | kw))


def test_shortage_goes_to_siblings_before_others(spark):
    rows = [(i, "a", "s", 10, 0) for i in range(1)] + [(100 + i, "a", "t", 10, 0) for i in range(30)] + [(200 + i, "b", "u", 10, 0) for i in range(100)]
    out = mixed(spark, rows, fraction=40 / 131)
    by = {(r.lang, r.source): r["sum(n)"] for r in out.groupBy("lang", "source").sum("n").collect()}
    assert by == {("a", "s"): 10, ("a", "t"): 190, ("b", "u"): 200}
    assert out.columns == ["doc_id", "lang", "source", "n", "whole", "epoch"]


def test_epochs_repeat_scarce_leaves(spark):
    rows = [(i, "a", "s", 10, 0) for i in range(4)] + [(100 + i, "b", "t", 10, 0) for i in range(20)]
    out = mixed(spark, rows, fraction=0.5, max_epochs=2).collect()
    a = [r for r in out if r.lang == "a"]
    assert len(a) == 6 and sorted({r.epoch for r in a}) == [0, 1] and len([r for r in out if r.lang == "b"]) == 6
    again = mixed(spark, rows[::-1], fraction=0.5, max_epochs=2).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixing_edges(spark):
    assert mixed(spark, []).count() == 0
    rows = [(None, None, "s", 5, 0), (1, None, None, None, 0), (2, "b", "s", 0, 0), (3, "b", "t", 8, 0), (3, "b", "t", 8, 0)]
    out = mixed(spark, rows, fraction=1.0).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 3, 3]
