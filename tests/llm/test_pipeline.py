import re

import pytest

import corpus_pipeline as cp
from joinscout.llm import line_dedup

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n=5):
    w = re.findall(line_dedup.WORD, lower(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again, the input first."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_quality_keeps_rows_as_they_are(stages, spark):
    before, after = {r.doc_id: r for r in stages[0]}, {r.doc_id: r for r in stages[1]}
    assert all(before[i] == r for i, r in after.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in before]
    assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i, q in labels.items() if q == 0) <= 0.1 * len(labels)


def test_exact_copies_go(stages):
    want = {}
    for r in stages[1]:
        want[lower(r.text)] = max(want.get(lower(r.text), -1), r.doc_id)
    assert sorted(want.values()) == sorted(r.doc_id for r in stages[2])


def test_near_copies_go(stages):
    rows = sorted(stages[2])
    sets, root = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert sorted(r.doc_id for r in stages[3]) == sorted(i for i in root if find(i) == i)


def test_mixture_fits_its_budget(stages):
    words = lambda rows: sum(len(re.findall(line_dedup.WORD, r.text or "")) for r in rows)
    assert {r.doc_id for r in stages[4]} <= {r.doc_id for r in stages[3]} and len({r.doc_id for r in stages[4]}) == len(stages[4])
    assert 0.5 * words(stages[3]) <= words(stages[4]) <= cp.MIX["fraction"] * words(stages[3])


def test_pieces_fill_sequences(stages):
    by = {}
    for r in stages[5]:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cp.CAPACITY
    assert {r.doc_id for r in stages[5]} == {r.doc_id for r in stages[4]}


def test_run_is_the_stages(stages, spark):
    assert sorted((r.doc_id, r.piece, r.length) for r in cp.run(spark, SF).collect()) == sorted((r.doc_id, r.piece, r.length) for r in stages[5])
