"""op11 to op13 against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from joinscout.llm import lexical, license_scan, merkle


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))


def plain_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for item in {i for i, _ in items}:
        wanted = {w for i, t in items if i == item for w in terms(t)}
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m)) for w in wanted if b[w])
            if s > 0:
                scores.append((-s, i))
        out[item] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ÉTÉ", "日本", "a b", "x_y"]
    texts = [" ".join(rng.choices(words, weights=[60 / (i + 1) for i in range(len(words))], k=rng.randint(1, 30))) for _ in range(150)]
    texts += [texts[0]] * 20 + [None, "", " -- ", "W1 w1 W1", "zq " * 30_000]
    return [(i, t) for i, t in enumerate(texts)]


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r.rank)):
        out.setdefault(r.item_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


@pytest.mark.parametrize(("pairs", "most_terms"), [(65_536, 200_000), (3, 200_000), (65_536, 0)])
def test_search(spark, corpus, monkeypatch, pairs, most_terms):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "TERMS", most_terms)
    items = [(1, "w1 W2 w2 w30"), (2, "Straße 日本 nothing"), (3, None), (4, "unseen"), (5, "w5"), (5, "w6 w5"), (6, "zq"), (7, " ".join(f"w{i}" for i in range(40)))]
    docs = spark.createDataFrame([(i, t, 1, "q", 2, 3) for i, t in corpus], "doc_id long, text string, uid int, term string, bucket int, id int").repartition(5)
    got = ranked(lexical.rank_documents(spark, docs, spark.createDataFrame(items, "item_id long, text string"), 7))
    want = {k: v for k, v in plain_search(corpus, items, 7).items() if v}
    assert got == want and set(got) == {1, 2, 5, 6, 7}


def test_search_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (None, "c")], "item_id long, text string")
    got = {(r.item_id, r.rank, r.id) for r in lexical.rank_documents(spark, docs, items, 5).collect()}
    assert got == {(1, 1, None), (1, 2, 1), (1, 3, 1), (None, 1, 2)}
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        assert lexical.rank_documents(spark, a, b, 5).count() == 0


def test_search_moves_no_matches(spark, corpus):
    """Scores are summed in the files of postings; only the best of a task are shuffled."""
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    index = lexical.Index(spark, docs)
    assert (index.documents, index.terms) == (sum(bool(terms(t)) for _, t in corpus), sum(len(terms(t)) for _, t in corpus))
    few = spark.createDataFrame([(1, "w1"), (1, "w2")], "item_id long, term string").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(lexical.BUCKETS)).cast("int"))
    matches = index.impacts().join(F.broadcast(few.withColumn("w", F.lit(1))), ["bucket", "term"])
    scores = matches.groupBy("uid", "id", "item_id").agg(F.sum("impact").alias("score"))
    plan = lexical.best(scores, 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("HashAggregate") and "hashpartitioning(uid" not in plan
    assert plan.rindex("Exchange hashpartitioning") < plan.index("HashAggregate")
    index.drop()


# ---- manifest ----


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def up(nodes):
    return [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i - i % 16
        out.append((nodes[a:i], nodes[i + 1 : a + 16]))
        i //= 16
    return out


def plain_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text)"""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = {}, {}
    for s in sources:
        mine = sorted([(r[0] is not None, r[0] or 0, leaf_of(r), r) for r in rows if r[1] == s], key=lambda x: x[:3])
        order[s], trees[s] = [x[3] for x in mine], levels_of([x[2] for x in mine])
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(order[s]):
            steps = path(trees[s], i) + path(top, k)
            hit = r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0
            own = leaf_of((*r[:4], lower(r[4]) if r[4] is not None else None)) if hit else leaf_of(r)
            for a, b in steps:
                own = H(*a, own, *b)
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], H(*[x for a, b in steps for x in a + b]), own, own == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def got_manifest(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", grp string, pos int").repartition(parts)
    out = merkle.document_manifest(spark, df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(map(tuple, out.collect()), key=repr)


def test_manifest(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(120)]  # two levels
    rows += [(1000 + i, None, None, None, None) for i in range(17)] + [(2000, "", "de", 0, ""), (2001, "é", "fr", 3, "ÀÉ a" * 30_000)]
    rows += [(3000, "twice", "en", 1, "Same")] * 3 + [(None, "twice", None, None, "NULL id")]
    rows += [(4000 + i, f"only{i}", "en", 1, "A") for i in range(20)]  # more than sixteen sources
    got = got_manifest(spark, rows)
    assert got == plain_manifest(rows)
    assert got == got_manifest(spark, rows, 7)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [4097, 9000])
def test_manifest_of_several_blocks(spark, n):
    rows = [(i, "hot", None, i, f"T{i}") for i in range(n)] + [(n, "cold", None, 1, "t")]
    assert got_manifest(spark, rows, 5) == plain_manifest(rows)


def test_manifest_edges(spark):
    assert got_manifest(spark, []) == []
    for one in ([(1, "a", "b", 2, "C")], [(None, None, None, None, None)]):
        assert got_manifest(spark, one) == plain_manifest(one)
    assert [merkle.depth_of(n) for n in (1, 2, 16, 17, 256, 257)] == [0, 1, 1, 2, 2, 3]


# ---- licences ----


def plain_licenses(text, known, weights):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    base, labels, score = [], set(), 0.0
    for t in known:
        for s in range(-60, len(words)):
            if s + t.phrases[0][0] >= 0 and all(tuple(words[s + at : s + at + len(p)]) == p for at, p in t.phrases):
                labels.add(t.label)
                if t.base:
                    base.append((s, t.label))
                score = max(score, sum(weights[w] for j, w in enumerate(t.words) if 0 <= s + j < len(words) and words[s + j] == w) / sum(weights[w] for w in t.words))
    starts = sorted(s for s, _ in base)
    return len(words), starts, len(base), starts[0] if starts else None, starts[-1] if starts else None, sorted({x for _, x in base}), sorted(labels), score


def test_license_scan(spark):
    rng = random.Random(5)
    known = license_scan.templates()
    texts = [None, "", "  ", "All rights reserved.", "ALL RIGHTS\nreserved all rights reserved", "CC-BY cc by cc BY by", "all rights", "reserved rights all", "license public general", "gnu General Public License", "x" * 50_000 + " cc by", "cc by " * 5000]
    pool = sorted({w for t in known for w in t.words})
    for t in known:
        words = list(t.words)
        texts.append(" ".join(words))
        texts.append("Über " + " ".join(words).title() + ", (C) 2020")
        texts.append(" ".join(words[t.phrases[0][0] :]))  # what stands before the first key phrase is missing
        texts.append(" ".join(words[: rng.randint(0, len(words))] + ["other"] + words))
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choices(pool, k=80)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, words int, present string").repartition(4)
    weights = license_scan.idf(docs, known)
    cut = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) for t in texts]
    assert weights == {w: max(1, math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * sum(w in c for c in cut) + 1)))) for w in pool}
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(spark, docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_licenses(t, known, weights), t
    assert {"mit", "apache", "gpl", "cc-by-nc", "reserved"} <= {x for v in got.values() for x in v[6]}


def test_license_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(spark, empty).count() == 0
    twice = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_base, r.labels) for r in license_scan.scan(spark, twice).collect()) == [(0, 0, []), (1, 1, ["cc-by"]), (1, 1, ["cc-by"])]
    with pytest.raises(ValueError, match="key phrase"):
        license_scan.template("x", "no phrase")
    plan = license_scan.scan(spark, twice)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
