"""Quality by Bradley-Terry ranking: scores learned from pairs of a better and a worse document.

Each document is a vector of text statistics. For pairs of a good and a bad labelled document, logistic loss on the difference
of their vectors gives weights; a document's strength is its weighted sum. The threshold is a quantile of the strengths of the labelled rows, the one that
separates them best. Scores are the logistic of strength, shifted so that the threshold has a set score.

All labelled rows are fitted on, whatever their number: they lie in blocks, a pass over which gives the sums of a step, and the threshold comes from counts of strengths.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, held_out
from .merkle import numbered
from .training import labelled_rows

#: Partners of each labelled row at least, and the score that the threshold gets.
PARTNERS, AT = 10, 0.3
#: Rows of the larger class in a block, slabs of strengths, and what a step's sums are multiplied by to be whole numbers.
BLOCK, SLABS, WHOLE = 64, 256, 1 << 30
FEATURES = ("length", "upper", "symbol", "bar", "bang", "digit", "stop", "word_length", "distinct", "top_word", "repeat", "lone_symbol_end", "line_repeat", "line_length")
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1  # upper
_KIND[48:58] = 2  # digit
for _c in b"#$%&*@^~<>{}[]\\=+_":
    _KIND[_c] = 3  # symbol
_KIND[ord("|")] = 4
_KIND[ord("!")] = 5
for _c in b".,;:?'\"()-":
    _KIND[_c] = 6  # ordinary punctuation


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; all 0 for null, empty or blank."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    kinds = np.bincount(_KIND[raw], minlength=7)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(words)
    return [
        np.log1p(k), kinds[1] / n, kinds[3] / n, kinds[4] / k, kinds[5] / k, kinds[2] / n, kinds[6] / k, min(n / k, 40) / 10,
        len(counts) / k**0.85, counts.most_common(1)[0][1] / k, sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        sum(w[-1] in "#$%&*!|" for w in words) / k, 1 - len(set(lines)) / len(lines), np.log1p(k / len(lines)),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    quantile: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(AT / (1 - AT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _vectors(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "x"])


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and `x`, the FEATURES of the text, of every row."""
    return docs.select("doc_id", "text").mapInArrow(_vectors, docs.select("doc_id").schema.add("x", T.ArrayType(T.DoubleType())))


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow column of vectors."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature over rows(x), from exact sums, so the order of rows doesn't count."""
    exact = lambda c: F.sum(c.cast("decimal(38,10)"))
    at = range(len(FEATURES))
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[exact(F.col("x")[i]).alias(f"s{i}") for i in at], *[exact(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}") for i in at]).first()
    mean = [Fraction(r[f"s{i}"]) / r.n for i in at]
    scale = np.array([float(max(Fraction(r[f"q{i}"]) / r.n - mean[i] ** 2, 0)) ** 0.5 for i in at])
    return np.array([float(m) for m in mean]), np.where(scale > 1e-6, scale, 1.0)


def _blocks(placed: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(block, rows): BLOCK rows of the larger class and as large a part of the other one. Where that has fewer rows than there are blocks, each stands in several."""
    k = max(-(-max(sizes.values()) // BLOCK), 1)
    first = F.expr(f"(pos * {k}L + n - 1) div n")
    last = F.expr(f"((pos + 1) * {k}L + n - 1) div n - 1")
    to = F.when(F.col("n") >= k, F.array(F.expr(f"pos * {k}L div n"))).otherwise(F.sequence(first, last))
    dealt = placed.select(F.explode(to).alias("block"), "grp", "pos", "x")
    return dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("grp", "pos", "x"))).alias("rows"))  # about 2 * BLOCK rows


def _step(blocks: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of gradient and second derivative over all pairs, and their number. A block's sums are added up as whole numbers, so it doesn't matter which task has it."""
    k = len(w)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            total = np.zeros(k + k * k + 1, np.int64)
            column = batch.column(1)
            ends, flat = np.asarray(column.offsets), column.values
            label, z = flat.field("grp").to_numpy(zero_copy_only=False), np.clip((_matrix(flat.field("x")) - mean) / scale, -8, 8)
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                good, bad = z[lo:hi][label[lo:hi] == 1], z[lo:hi][label[lo:hi] == 0]
                i = np.arange(max(len(good), len(bad)))[:, None]
                d = (good[i % len(good)] - bad[(i + np.arange(PARTNERS)) % len(bad)]).reshape(-1, k)
                p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
                sums = np.concatenate([d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
                total += np.concatenate([np.rint(sums * WHOLE).astype(np.int64), [len(d)]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["v"])

    parts = blocks.mapInArrow(run, "v array<long>").select(F.posexplode("v")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("v"))  # a row a batch
    v = [int(r.v) for r in parts.orderBy("pos").collect()]
    found = np.array([x / WHOLE for x in v[:-1]])
    return found[:k], found[k:].reshape(k, k), v[-1]


def _threshold(strengths: DataFrame) -> tuple[float, float]:
    """Of strengths(label, s) the cut with the fewest errors, the lowest of several, and the part of rows below it.

    Distinct strengths are counted and cut into SLABS; sums run within a slab and go on from the slabs before, of which there is a row each."""
    counts = strengths.groupBy("s").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad"))
    cuts = counts.agg(F.percentile_approx("s", [i / SLABS for i in range(1, SLABS)], 2000).alias("q"))  # one row
    placed = counts.crossJoin(F.broadcast(cuts)).withColumn("slab", F.size(F.filter("q", lambda c: c <= F.col("s")))).drop("q")
    over = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)  # a row a slab
    slabs = placed.groupBy("slab").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    slabs = slabs.select("slab", F.coalesce(F.sum("g").over(over), F.lit(0)).alias("g"), F.coalesce(F.sum("b").over(over), F.lit(0)).alias("b"))
    inside = Window.partitionBy("slab").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumns({"ig": F.coalesce(F.sum("good").over(inside), F.lit(0)), "ib": F.coalesce(F.sum("bad").over(inside), F.lit(0))}).join(slabs, "slab")
    below = rows.select("s", "good", "bad", (F.col("g") + F.col("ig")).alias("g"), (F.col("b") + F.col("ib")).alias("b"))
    best = below.agg(F.min(F.struct((F.col("g") - F.col("b")).alias("wrong"), "s", (F.col("g") + F.col("b")).alias("n"))).alias("m"), F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("s").alias("top")).first()
    if best.good - best.bad < best.m.wrong:  # nothing is kept
        return best.top + 1, 1.0
    low = counts.where(F.col("s") < best.m.s).agg(F.max("s")).first()[0]
    return best.m.s - 1 if low is None else (low + best.m.s) / 2, best.m.n / (best.good + best.bad)


def fit(spark: SparkSession, rows: DataFrame, ridge: float = 1e-2, steps: int = 30) -> Model:
    """Fit on all rows(id, label, x), ids unique. Rows of a class go in order of a hash of the id; each meets PARTNERS rows of the other class or more.
    One class alone gives equal scores. Only sums over all rows reach the driver."""
    scratch = Scratch(spark, "quality")
    w = np.zeros(len(FEATURES))
    placed = numbered(scratch, rows.select(F.col("label").alias("grp"), F.xxhash64("id").alias("h"), "id", "x"), ["h", "id"])
    sizes = {r.grp: r.n for r in placed.groupBy("grp").agg(F.max("n").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(w, w + 1, w, 0.0, 1.0, 0.0)
    mean, scale = _moments(placed)
    blocks = scratch.save(_blocks(placed, sizes), "blocks")
    for _ in range(steps):  # Newton's method
        gradient, hessian, n = _step(blocks, w, mean, scale)
        change = np.linalg.solve(hessian / n + ridge * np.eye(len(w)), gradient / n + ridge * w)
        w = w - change
        if np.abs(change).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0, 1.0, 0.0)

    def strengths(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(model.strength(_matrix(b.column(1))), 9) + 0.0)], names=["label", "s"])

    model.threshold, model.quantile = _threshold(scratch.save(placed.select("grp", "x").mapInArrow(strengths, "label int, s double"), "strengths"))
    scratch.drop()
    return model


def train(spark: SparkSession, found: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on every labelled row outside the held-out fold, from `vectors` of the documents; of an id that repeats one vector counts, so the
    same rows give the same model however they are dealt."""
    rows = found.select(F.col("doc_id").alias("id"), "x").join(labelled_rows(labels, label), "id")
    return fit(spark, rows.groupBy("id", "label").agg(F.min("x").alias("x")))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs and `score`, between 0 and 1. Null, empty and blank texts have the score of a vector of zeros; a column `score` is replaced."""
    kept = [c for c in docs.columns if c != "score"]
    schema = docs.select(*kept).schema.add("score", "double")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], names=[*b.schema.names, "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= AT) of every row; without labels every score is AT. Texts are read once; their vectors are written."""
    found = Scratch(spark, "quality").save(vectors(docs), "vectors")
    model = train(spark, found, labels)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))), pa.float64())], names=["doc_id", "score"])

    scored = found.mapInArrow(run, found.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier doesn't reject, with their columns."""
    model = train(spark, vectors(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))), labels)
    return score_documents(docs, model).where(F.col("score") >= AT).select(*docs.columns)
