"""SQL on the smallest tables, hot groups, long texts, repeated rows and columns of clashing names."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from joinscout.llm import exact_dedup, line_dedup, ngram_join, packing, quality, queries, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(r[columns.index(c)] for c in columns) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall()]
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(rows, key=repr)


def test_common_texts_have_several_owners(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FEW", 3)
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", 200)
    docs = [(i, "Hot" if i % 3 else f"text {i % 40}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    index = exact_dedup.build_index(spark, df)
    assert index.directory.select("bucket").distinct().count() > 1 and index.entries.count() == len({t for _, t in docs})
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(spark, df).collect()}
    assert got == {i: (max(j for j, u in docs if u == t), sum(u == t for _, u in docs)) for i, t in docs}


@pytest.mark.parametrize("filtered", [0, 1 << 22])
def test_near_copies_with_and_without_the_filter(spark, monkeypatch, filtered):
    monkeypatch.setattr(ngram_join, "FILTERED", filtered)
    monkeypatch.setattr(ngram_join, "PART_BYTES", 1000)
    rng = random.Random(8)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(80)] for _ in range(12)]
    docs = []
    for i in range(60):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = "x" + str(rng.randint(0, 9))
        docs.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(76)} for i, t in docs}
    root = {i: i for i in sets}
    for i in sets:  # smallest id reachable
        todo, seen = [i], {i}
        while todo:
            a = todo.pop()
            for b in sets:
                if b not in seen and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    seen.add(b)
                    todo.append(b)
        root[i] = min(seen)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == root


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(1)
    long = "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 9)) for _ in range(12)) for _ in range(20_000))
    rows = [(i, f"good text number {i} of some words", 0, 0.5) for i in range(30)] + [(100, long, 0, 0.5), (101, long, 0, 0.5), (102, "", 0, 0.5), (103, None, 0, 0.5), (1, "good text number 1 of some words", 0, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, terms int, score double").withColumns({"uid": F.lit(1), "label": F.lit("x"), "length": F.lit(2), "piece": F.lit(3)})
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, toxic int, quality int")
    for out in (toxicity.toxicity(spark, docs, labels), quality.quality_scores(spark, docs, labels)):
        found = out.collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id == 1}) == 1
    packed = packing.pack_documents(spark, docs, tokens.default_tokenizer(), 2048, 0)
    frame = packed.frame()
    assert frame.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty() and frame.where("doc_id = 1").count() == 2
    assert packed.sequences == frame.select("sequence_id").distinct().count() and packed.bound <= packed.sequences
    cut = {r.doc_id: (r.n_lines, r.n_deleted) for r in line_dedup.deduplicate_lines(spark, docs).where("doc_id >= 100").collect()}
    assert cut == {100: (20_000, 0), 101: (20_000, 20_000), 102: (1, 0), 103: (1, 0)}


def test_packing_meets_the_optimum_of_small_tables(spark):
    """Sequences and bound on both sides of the fewest that any packing needs."""
    rng = random.Random(5)
    word = tokens.Encoder(tokens.default_tokenizer())
    assert len(word.encode(["a"])[0]) == 4

    def fewest(sizes, room):
        best = [len(sizes)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in {b: j for j, b in enumerate(bins)}.values():
                if bins[k] >= sizes[i]:
                    place(i + 1, bins[:k] + [bins[k] - sizes[i]] + bins[k + 1 :])
            place(i + 1, [*bins, room - sizes[i]])

        sizes = sorted(sizes, reverse=True)
        place(0, [])
        return best[0]

    for _ in range(3):
        n = [rng.randint(0, 18) for _ in range(10)]
        df = spark.createDataFrame([(i, " ".join(["a"] * k)) for i, k in enumerate(n)], "doc_id long, text string")
        packed = packing.pack_documents(spark, df, tokens.default_tokenizer(), 20, 0)
        opt = fewest([k + 1 for k in n], 20)
        assert packed.bound <= opt <= packed.sequences <= opt + 1


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = str(tmp_path / stage.__name__)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
    assert docs.count() == 0
