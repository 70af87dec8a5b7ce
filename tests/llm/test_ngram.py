import random

import numpy as np
import pytest

from joinscout.llm import ngram_join as nj
from joinscout.llm.shingles import shingle_sets


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def sets(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs):
    s = [sets(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((d, len(s[i]), ids[find(i)]) for i, (d, _) in enumerate(docs))


def test_sets_match_python():
    texts = [None, "", "  \t\n", "One two", "a b c d e", "A b c d e f g A b c d e", "x y é É \x1f z w q", "tab\tnew\nline v f\x0b g\x0c h"]
    for t, s in zip(texts, shingle_sets(texts), strict=True):
        assert len(s) == len(sets(t)) and (np.diff(s.astype(object)) > 0).all()


def test_long_text_is_the_same_in_pieces(monkeypatch):
    from joinscout.llm import shingles

    text = " ".join(f"w{i * i % 997}" for i in range(5000))
    whole = shingle_sets([text])[0]
    monkeypatch.setattr(shingles, "LONGEST", 512)
    assert (shingle_sets([text])[0] == whole).all()


@pytest.mark.parametrize("size", [1, 2, 4, 5, 9, 10, 37, 150])
def test_similar_sets_meet(size):
    bands = nj.Bands(80, 100)
    rng = np.random.default_rng(size)
    for _ in range(40):
        pool = np.unique(rng.integers(1, 1 << 63, 3 * size, dtype=np.uint64))
        a = np.sort(rng.permutation(pool)[:size])
        drop, add = rng.integers(0, size // 5 + 1), rng.integers(0, size // 5 + 1)
        b = np.sort(np.concatenate([rng.permutation(a)[drop:], np.setdiff1d(pool, a)[:add]]))
        if len(a) and len(b) and nj.linked(a, b, 80, 100):
            assert np.intersect1d(bands.names(a), bands.names(b)).size
            x, y = nj.bitmap(a), nj.bitmap(b)
            assert nj.bound_allows(len(a), x, len(b), y, 80, 100)


def near_copies(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    docs, base = [], [rng.choice(vocab) for _ in range(60)]
    passage = [rng.choice(vocab) for _ in range(30)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:  # a chain of edits: neighbours link, ends don't
            base = base[:]
            base[rng.randrange(len(base))] = rng.choice(vocab)
            w = base
        elif kind < 0.7:
            w = passage + [rng.choice(vocab) for _ in range(rng.randint(2, 30))]
        elif kind < 0.8:
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 8))]
        else:
            w = rng.choice(docs)[1].split() if docs and docs[-1][1] else []
        docs.append((i * 3 % (3 * n + 1), " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 16)
    docs = near_copies(seed) + [(9001, None), (9002, ""), (9003, "One Two"), (9004, "one two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, nj.jaccard_components(spark, df).collect()))
    assert got == brute(docs)


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.jaccard_components(spark, empty).count() == 0
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, t, 5), (1, t, 6), (None, t, 7), (2, "q", 8), (2, "q", 8)], "doc_id long, text string, uid long")
    got = sorted(map(tuple, nj.jaccard_components(spark, df).collect()), key=repr)
    assert got == sorted([(1, 6, 1), (1, 6, 1), (None, 6, 1), (2, 1, 2), (2, 1, 2)], key=repr)
    assert nj.keep_one(spark, df).columns == ["doc_id", "text", "uid"]


def test_keep_one_tells_rows_of_an_id_apart(spark):
    a, near = " ".join(f"a{i}" for i in range(60)), " ".join(f"a{i}" for i in range(59))
    b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "bce")
    rows = [(3, a), (5, near), (5, b), (7, c), (7, c + " more"), (None, e), (None, e + " more"), (8, e + " less"), (9, b + " x"), (None, c + " z")]
    rows += [(10, " ".join(f"f{i}" for i in range(60)))] * 3 + [(None, " ".join(f"g{i}" for i in range(60)) + x) for x in ("", "", " y")] + [(11, ""), (11, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = nj.keep_one(spark, docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, (r.text or "")[:1]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, "a"), (5, "b"), (7, "c"), (8, "e"), (10, "f"), (None, "g"), (11, ""), (11, ""), (None, "")], key=str)
