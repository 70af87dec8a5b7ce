import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinscout.llm import quality, toxicity
from joinscout.llm.training import labelled_sample

SF = "/root/testdata/sf0.1"


def made(n=600):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "moron"])
        docs.append((i, " ".join(f"{w.upper()}!!" for w in words) if bad else " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = made()
    docs += [(9000, None), (9001, ""), (9002, "idiot"), (None, "w1 w2")]
    labels += [(None, 1, 1), (3, None, None), (9000, 2, 5)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect() if r.doc_id is not None and r.doc_id < 9000 and r[name] is not None}
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_quality(spark, tables):
    docs, labels = tables
    rows = quality.quality_scores(spark, docs, labels).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert accuracy(rows, labels, "quality") >= 0.95
    kept = quality.keep_good(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() < 604


def test_toxicity(spark, tables):
    docs, labels = tables
    rows = toxicity.toxicity(spark, docs, labels).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert accuracy(rows, labels, "toxic") >= 0.95
    by = {r.doc_id: r for r in rows}
    assert by[9002].predicted == 1 and by[9002].evidence[0].label == 1 and by[9000].predicted == 0 and by[9001].evidence == []


def test_without_labels_or_rows(spark, tables):
    docs, labels = tables
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity(spark, docs, none).collect()} == {0}
    assert {round(r.score, 6) for r in quality.quality_scores(spark, docs, none).collect()} == {0.3}
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0 == quality.quality_scores(spark, docs.limit(0), labels).count()


def test_sample_leaves_out_the_held_fold_and_contradictions(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1, 0), (2, 0)], "doc_id long, y int")
    sample, counts = labelled_sample(labels, "y", 10)
    ids = [r.id for r in sample.collect()]
    assert len(ids) == 20 and 1 not in ids and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids) and sum(counts.values()) < 100


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    x = rng.random((300, 12)) * (rng.random((300, 12)) < 0.3)
    q = rng.random((40, 12)) * (rng.random((40, 12)) < 0.3)
    index = toxicity.BlockMaxIndex.build(np.arange(300), np.zeros(300), np.ones(300), x, size=16)
    best, sim = index.search(q, 5)
    full = q @ x[np.array([np.flatnonzero(np.arange(300) == i)[0] for i in index.ids])].T
    for i in range(40):
        want = sorted(((-s, j) for j, s in enumerate(full[i]) if s > 0))[:5]
        assert np.allclose(sorted(-s for s, _ in want), sorted(sim[i][best[i] >= 0])) and list(best[i][best[i] >= 0]) == [j for _, j in want]


def test_held_out_accuracy_on_the_test_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(spark, docs, labels).collect()
    english = {r.doc_id for r in docs.where("lang = 'en'").join(labels.where("quality = 1"), "doc_id").select("doc_id").collect()}
    assert accuracy([r for r in rows if r.doc_id in english], labels, "toxic") >= 0.99
    # toxic rows in other languages have many words that are rare each; test_toxic_rows_of_every_language holds their recall
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    # held-out rows only: no row's own label counts in its score any more, so training rows are no easier than others
    assert accuracy(rows, labels, "toxic") >= 0.95 and np.mean([r.predicted for r in rows if r.doc_id in clean and r.held_out]) <= 0.005
    assert np.mean([r.predicted for r in rows if r.doc_id in clean]) <= 0.01
    assert accuracy(quality.quality_scores(spark, docs, labels).collect(), labels, "quality") >= 0.97


def test_toxic_rows_of_every_language(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(spark, docs, labels).collect()
    toxic = {r.doc_id: r.lang for r in docs.join(labels.where("toxic = 1"), "doc_id").collect()}
    held = {r.doc_id: r.predicted for r in rows if r.held_out and r.doc_id in toxic}
    english, other = ([p for i, p in held.items() if (toxic[i] == "en") == want] for want in (True, False))
    print("toxicity, held out: accuracy", accuracy(rows, labels, "toxic"), "recall en", sum(english), len(english), "other", sum(other), len(other))
    assert np.mean(other) >= 0.85 and np.mean(english) >= 0.9 and accuracy(rows, labels, "toxic") >= 0.98


def test_an_example_is_not_its_own_neighbour(spark):
    docs = spark.createDataFrame([(i, f"word{i} common text here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    for r in toxicity.toxicity(spark, docs, labels).collect():
        assert r.doc_id not in {e.doc_id for e in r.evidence}


@pytest.mark.parametrize("score", [lambda s, d, l: toxicity.toxicity(s, d, l), lambda s, d, l: quality.quality_scores(s, d, l)])
def test_scores_do_not_depend_on_partitions(spark, score):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" and more"))))  # ids that repeat
    one, other = (sorted((r.doc_id, round(r.score, 9)) for r in score(spark, docs.repartition(n), labels.repartition(n)).collect()) for n in (3, 11))
    assert one == other


def test_isotonic_calibration():
    votes, shares = toxicity.calibrate(np.array([0.1, 0.2, 0.2, 0.6, 0.7, 0.9]), np.array([0.0, 0, 1, 1, 0, 1]), np.ones(6))
    assert list(shares) == sorted(shares) and np.allclose(np.interp([0.1, 0.2, 0.65, 0.95], votes, shares), [0, 0.5, 0.5, 1])


def test_evidence_against_brute_force(spark):
    """Cosines of whole texts, words of no example among them, from plain counts."""
    rng = random.Random(12)
    words = [a + b for a in "abcdefgh" for b in "klmnopqr"]
    docs = [(i, " ".join(rng.choices(words[: 60 if i < 40 else 50], k=rng.randint(4, 30)) + [f"{words[i - 40]}x{words[j % 7]}" for j in range(0 if i < 40 else rng.randint(0, 12))])) for i in range(70)]
    labels = {i: int(rng.random() < 0.4) for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    rows = toxicity.toxicity(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    bags = {i: Counter(t.split()) for i, t in docs}
    known = {w for i in labels for w in bags[i]}
    df = Counter(w for b in bags.values() for w in b)
    pos, total = sum(labels.values()), len(labels)
    weight = {}
    for w in known:
        a, m = sum(y for i, y in labels.items() if w in bags[i]), sum(w in bags[i] for i in labels)
        chi2 = total * (a * (total - pos - m + a) - (m - a) * (pos - a)) ** 2 / (pos * (total - pos) * m * max(total - m, 0.5))
        weight[w] = (math.log((1 + len(docs)) / (1 + df[w])) + 1) * chi2
    unseen = math.log((1 + len(docs)) / 2) + 1
    vec = {i: {w: (1 + math.log(c)) * weight.get(w, unseen) for w, c in b.items()} for i, b in bags.items()}
    dot = lambda a, b: sum(v * b[w] for w, v in a.items() if w in b)
    for r in rows:
        want = sorted((dot(vec[r.doc_id], vec[j]) / math.sqrt(dot(vec[r.doc_id], vec[r.doc_id]) * dot(vec[j], vec[j])) for j in labels if j != r.doc_id), reverse=True)[:3]
        assert [e.cosine for e in r.evidence] == pytest.approx(want, abs=1e-9)


def test_copies_are_each_others_neighbours(spark):
    """Twenty labelled rows of one toxic text and twenty of one clean one: a copy of either is known."""
    docs = [(i, "poison bile spite venom scorn malice" if i % 2 else "bread and butter with some fresh tea") for i in range(60)]
    labels = [(i, i % 2) for i in range(50)]
    rows = toxicity.toxicity(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r.predicted == r.doc_id % 2 and abs(r.score - r.predicted) < 0.1 for r in rows)


def test_matrix_is_bounded_in_bytes(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.random((200, 40)) * (rng.random((200, 40)) < 0.4)
    q = rng.random((30, 40))
    make = lambda: toxicity.BlockMaxIndex.build(np.arange(200), np.zeros(200), np.ones(200), x, size=16)
    wide = make()
    monkeypatch.setattr(toxicity, "MATRIX_BYTES", 200 * 8 * 6)
    narrow = make()
    assert wide.matrix.shape[1] == 40 and narrow.matrix.shape[1] <= 6
    for a, b in zip(wide.search(q, 5), narrow.search(q, 5), strict=True):
        assert np.allclose(a, b)


def test_quality_is_fitted_on_every_labelled_row(spark):
    """Far more than 2000 rows a class: every row outside the fold counts in mean, pairs and threshold, on either side of an uneven split."""
    rng = np.random.default_rng(4)
    y = (rng.random(9000) < 0.97).astype(int)
    x = np.round(rng.random((9000, len(quality.FEATURES))) + 0.2 * y[:, None], 6)
    rows = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(9000)], "id long, label int, x array<double>")
    model, again = (quality.fit(spark, rows.repartition(n)) for n in (3, 7))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    assert np.array_equal(model.weights, again.weights) and model.threshold == again.threshold and model.quantile == again.quantile
    placed = quality.numbered(quality.Scratch(spark, "test"), rows.select(F.col("label").alias("grp"), "id", "x"), ["id"])
    blocks = quality._blocks(placed, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    assert all({r.grp for r in b.rows} == {0, 1} and len(b.rows) <= 2 * quality.BLOCK for b in blocks.collect())
    assert blocks.select(F.explode("rows.pos"), F.size("rows")).count() >= 9000
    strength = np.round(model.strength(x), 9)
    cuts = [strength.min() - 1, *sorted(set(strength)), strength.max() + 1]
    errors = [(y[strength < c] == 1).sum() + (y[strength >= c] == 0).sum() for c in cuts]
    got = (y[strength < model.threshold] == 1).sum() + (y[strength >= model.threshold] == 0).sum()
    assert got == min(errors) and abs(model.quantile - (strength < model.threshold).mean()) < 1e-9
