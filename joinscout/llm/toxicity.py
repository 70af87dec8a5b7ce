"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the labelled examples. Their TF-IDF weights are multiplied by their chi-square with the label, so words that
go with neither class hardly count, but none is left out (near copies among the examples count once). Document frequencies are those of
all documents. Words that no example has are in the length of a text's vector, with the weight of a word of one document and the chi-square
that is expected of a word that goes with neither class, which is 1. Examples are dealt into blocks; for each term a block keeps the largest weight of its postings, so the products of a
query's weights with these bound every example of the block from above. A query's best blocks are scored first, then those whose
bound reaches its k-th similarity. The neighbours vote by nearness; an isotonic fit to leave-one-out votes makes it a probability. An example that has
near copies among the labelled rows of its class is left with them when it is left out, so it stays its own neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held_out
from .shingles import mix, shingle_sets
from .training import labelled_sample

#: Labelled rows of each class, neighbours, examples a block, blocks a query scores first, and queries and their terms scored together.
PER_CLASS, K, BLOCK, FIRST, TOGETHER, TERMS = 2000, 15, 64, 4, 100, 30_000
#: Terms that more than this part of the examples have are kept as columns of a matrix, others as postings.
COMMON = 1 / 16
#: Bytes of that matrix at most; the most frequent terms have its columns.
MATRIX_BYTES = 64 << 20
#: Characters of texts that are cut into words together.
AT_ONCE = 4_000_000
_BETWEEN = r"[^\p{L}\p{Nl}\p{No}]+"


def cut_words(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(ends, numbers, words): the lower-case words of each text of an Arrow array as numbers into the distinct ones. Null is empty; "" is no word."""
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.utf8_lower(pc.fill_null(pc.cast(texts, pa.large_string()), ""))
    parts = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _BETWEEN, " "))
    coded = parts.flatten().dictionary_encode()
    return parts.offsets.to_numpy() - parts.offsets[0].as_py(), coded.indices.to_numpy(), coded.dictionary.to_pylist()


def batches_of(column, most: int = AT_ONCE):
    """Slices of an Arrow column of texts that have about so many bytes, one text at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(pc.cast(column, pa.large_string())), 0).to_numpy(zero_copy_only=False).tolist()
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= most):
            size += sizes[end]
            end += 1
        yield at, end - at
        at = end


def _marks(s: np.ndarray) -> list[int]:
    """A hash of each three of four min-hashes."""
    least = np.array([mix(s + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min() if len(s) else 0 for j in range(4)], np.uint64)
    return [int(mix(np.delete(least, j) + np.arange(3, dtype=np.uint64)).sum().astype(np.int64)) for j in range(4)]


def _example_words(batches):
    """Distinct words and near-copy marks of labelled examples."""
    import pyarrow as pa

    for b in batches:
        for at, k in batches_of(b.column("text")):
            part = b.slice(at, k)
            marks = [_marks(s) for s in shingle_sets(part.column("text").to_pylist())]
            ends, numbers, words = cut_words(part.column("text"))
            own = [sorted({words[i] for i in set(numbers[x:y].tolist())} - {""}) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(own, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))], names=["id", "label", "words", "marks"])


def choose_terms(scratch: Scratch, docs: DataFrame, sample: DataFrame) -> tuple[DataFrame, set[int], list[str], np.ndarray]:
    """(examples kept, those of them with copies, terms, the chi-square of each). Of examples of a class that share three of four min-hashes the smallest id is kept."""
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), "id")  # at most 2 * PER_CLASS rows
    rows = rows.select("id", "label", "text").mapInArrow(_example_words, "id long, label int, words array<string>, marks array<long>")
    rows = rows.groupBy("id", "label").agg(F.min(F.struct("words", "marks")).alias("e"))  # of an id that repeats one text
    rows = scratch.save(rows.select("id", "label", "e.words", "e.marks"), "examples")
    marks = rows.select("id", "label", F.posexplode("marks").alias("j", "mark"))
    first = marks.groupBy("label", "j", "mark").agg(F.min("id").alias("first"))
    copies = scratch.save(marks.join(first, ["label", "j", "mark"]).where("id <> first").groupBy("id").agg(F.min("first").alias("first")), "copies")
    kept = rows.join(copies, "id", "left_anti")
    stands = {r.id: r.first for r in copies.orderBy("id").collect()}  # at most 2 * PER_CLASS rows
    for i in stands:  # in order of id, and first < id, so the first of a first is known
        stands[i] = stands.get(stands[i], stands[i])
    copied = set(stands.values())
    n = {r.label: r["count"] for r in kept.groupBy("label").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return kept.select("id", "label"), copied, [], np.zeros(0)
    seen = kept.select("label", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.sum("label").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("m"))
    total = pos + neg
    a, m = F.col("a"), F.col("m")
    chi2 = total * (a * (neg - (m - a)) - (m - a) * (pos - a)) ** 2 / (F.lit(float(pos * neg)) * m * F.greatest(total - m, F.lit(0.5)))
    best = seen.select("word", chi2.alias("chi2")).toArrow()  # words of at most 2 * PER_CLASS rows
    words, weights = np.array(best.column("word").to_pylist(), object), best.column("chi2").to_numpy()
    order = np.argsort(words, kind="stable")
    return kept.select("id", "label"), copied, words[order].tolist(), weights[order]


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, terms (indexes) and counts of each row's whole text, and rest: the sum of (1 + ln tf)^2 of its words that are no terms."""
    index = {w: i for i, w in enumerate(terms)}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at, k in batches_of(b.column("text")):
                ends, numbers, words = cut_words(b.column("text").slice(at, k))
                # terms first, then other words by their number in the batch; -1 is no word
                code = np.array([index.get(w, len(terms) + i) if w else -1 for i, w in enumerate(words)], np.int64)[numbers]
                wide = len(terms) + len(words) + 1
                cell, n = np.unique((np.repeat(np.arange(k), np.diff(ends)) * wide + code)[code >= 0], return_counts=True)
                row, code = cell // wide, cell % wide
                known = code < len(terms)
                rest = np.bincount(row[~known], (1 + np.log(n[~known])) ** 2, k)
                lists = pa.array(np.searchsorted(row[known], np.arange(k + 1)).astype(np.int32))
                each = [pa.ListArray.from_arrays(lists, pa.array(x[known].astype(np.int32))) for x in (code, n)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, k), *each, pa.array(rest, pa.float64())], names=["doc_id", "terms", "counts", "rest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, terms array<int>, counts array<int>, rest double")


@dataclass
class Rows:
    """Sparse rows: the terms and values of row i are those from ends[i] to ends[i + 1]."""

    ends: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    @staticmethod
    def of(x: np.ndarray | Rows) -> Rows:
        if isinstance(x, Rows):
            return x
        at, terms = np.nonzero(x)
        return Rows(np.searchsorted(at, np.arange(len(x) + 1)), terms, x[at, terms])

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def any(self) -> np.ndarray:
        return np.diff(self.ends) > 0

    def take(self, rows: np.ndarray) -> Rows:
        at, n = _spread(self.ends[rows], self.ends[rows + 1] - self.ends[rows])
        return Rows(np.concatenate([[0], np.cumsum(n)]), self.terms[at], self.values[at])


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places start[i] to start[i] + n[i] for each i, n)."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n), n


def vectors(terms: list, counts: list, weight: np.ndarray, rest=0.0) -> Rows:
    """Unit vectors of (1 + ln tf) * weight; no terms where a text has none. rest: squared length of each text's other words."""
    ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(int)
    flat = lambda x, kind: np.concatenate([np.asarray(v, kind) for v in x]) if len(x) else np.empty(0, kind)
    return weighted(ends, flat(terms, int), flat(counts, float), weight, rest)


def weighted(ends: np.ndarray, t: np.ndarray, c: np.ndarray, weight: np.ndarray, rest=0.0) -> Rows:
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    some = weight[t] > 0
    row, t, v = row[some], t[some], (1 + np.log(c[some])) * weight[t[some]]
    norm = np.sqrt(np.bincount(row, v * v, len(ends) - 1) + rest)
    return Rows(np.searchsorted(row, np.arange(len(ends))), t, v / norm[row])


def flat_lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of an Arrow column of lists."""
    ends = column.offsets.to_numpy()
    return (ends - ends[0]).astype(int), column.flatten().to_numpy(zero_copy_only=False)


@dataclass
class BlockMaxIndex:
    """Postings by term and block. A term's entries (one a block that has it) hold its largest weight in the block and where its postings there are.

    Terms that many examples have are columns of a matrix instead, with their largest weight in each block beside it.
    """

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    size: int
    entry_ends: np.ndarray
    blocks: np.ndarray
    top: np.ndarray
    posting_ends: np.ndarray
    rows: np.ndarray
    values: np.ndarray
    column: np.ndarray
    matrix: np.ndarray
    matrix_top: np.ndarray

    @staticmethod
    def build(ids, labels, weights, x: np.ndarray | Rows, size: int = BLOCK) -> BlockMaxIndex:
        x = Rows.of(x)
        at = x.row_numbers()
        heavy = np.full(len(x), -1)
        by_value = np.lexsort((-x.terms, x.values, at))  # the last of each row is its heaviest term
        heavy[at[by_value]] = x.terms[by_value]
        order = np.lexsort((ids, heavy)) if len(ids) else np.empty(0, int)  # alike examples together
        ids, labels, weights, x = ids[order], labels[order], weights[order], x.take(order)
        at = x.row_numbers()
        n_terms = int(x.terms.max()) + 1 if len(x.terms) else 0
        many = np.bincount(x.terms, minlength=n_terms)
        most = MATRIX_BYTES // (8 * max(1, len(ids)))
        least = np.partition(many, n_terms - most - 1)[n_terms - most - 1] if n_terms > most else 0
        many = many > max(COMMON * len(ids), least)
        column = np.where(many, np.cumsum(many) - 1, -1)
        n_blocks = -(-len(ids) // size)
        matrix = np.zeros((n_blocks * size, int(many.sum())))
        if n_terms:
            own = many[x.terms]
            matrix[at[own], column[x.terms[own]]] = x.values[own]
        matrix_top = matrix.reshape(n_blocks, size, -1).max(1) if matrix.size else np.zeros((n_blocks, matrix.shape[1]))
        by_term = np.lexsort((at, x.terms))
        by_term = by_term[~many[x.terms[by_term]]] if n_terms else by_term
        terms, rows, values = x.terms[by_term], at[by_term], x.values[by_term]
        block = rows // size
        first = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])) if len(terms) else np.empty(0, int)
        top = np.maximum.reduceat(values, first) if len(first) else np.empty(0)
        entry_ends = np.searchsorted(terms[first], np.arange(n_terms + 1))
        return BlockMaxIndex(ids, labels, weights, size, entry_ends, block[first], top, np.append(first, len(rows)), rows, values, column, matrix[: len(ids)], matrix_top)

    def search(self, q: np.ndarray | Rows, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the k nearest examples of each query, exactly; ties to the earlier row; -1 and 0 where there are fewer.

        without: for each query an example row that doesn't count, or -1.
        """
        q = Rows.of(q)
        best, sim = np.full((len(q), k), -1), np.zeros((len(q), k))
        at = 0 if len(self.ids) else len(q)
        while at < len(q):  # long texts have more terms, so fewer of them go together
            end = min(len(q), at + TOGETHER, max(at + 1, int(np.searchsorted(q.ends, q.ends[at] + TERMS, "right")) - 1))
            part = np.arange(at, end)
            best[part], sim[part] = self._search(q.take(part), k, None if without is None else without[part])
            at = end
        return best, sim

    def _search(self, q: Rows, k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n, m, n_blocks = len(q), len(self.ids), -(-len(self.ids) // self.size)
        known = np.flatnonzero(q.terms < len(self.column))
        dense = np.zeros((n, self.matrix.shape[1]))
        shared = known[self.column[q.terms[known]] >= 0]
        dense[q.row_numbers()[shared], self.column[q.terms[shared]]] = q.values[shared]
        t = q.terms[known]
        entry, count = _spread(self.entry_ends[t], self.entry_ends[t + 1] - self.entry_ends[t])
        who, value = np.repeat(q.row_numbers()[known], count), np.repeat(q.values[known], count)
        cell = who * n_blocks + self.blocks[entry]
        # a little above, as sums in another order may differ in their last bits
        bound = np.bincount(cell, value * self.top[entry], n * n_blocks).reshape(n, n_blocks)
        bound = (bound + dense @ self.matrix_top.T) * (1 + 1e-9)
        s = np.zeros(n * m)

        def score(live: np.ndarray):
            some = np.flatnonzero(live.ravel()[cell])
            e = entry[some]
            at, c = _spread(self.posting_ends[e], self.posting_ends[e + 1] - self.posting_ends[e])
            s[:] += np.bincount(np.repeat(who[some] * m, c) + self.rows[at], np.repeat(value[some], c) * self.values[at], n * m)
            for j in np.flatnonzero(live.any(0)):
                rows = slice(j * self.size, min(m, (j + 1) * self.size))
                some = np.flatnonzero(live[:, j])
                s.reshape(n, m)[some, rows] += dense[some] @ self.matrix[rows].T
            s[:] = np.round(s, 12)  # sums in another order are the same
            if without is not None:
                own = np.flatnonzero(without >= 0)
                s.reshape(n, m)[own, without[own]] = 0

        def kth() -> np.ndarray:
            return np.partition(s.reshape(n, m), m - k, axis=1)[:, m - k] if k <= m else np.zeros(n)

        done = bound > 0
        if n_blocks > FIRST:
            done &= bound >= np.partition(bound, n_blocks - FIRST, axis=1)[:, n_blocks - FIRST, None]
        score(done)
        left = ~done & (bound > 0) & (bound >= kth()[:, None])
        if left.any():
            score(left)
        r, c = np.nonzero((s.reshape(n, m) > 0) & (s.reshape(n, m) >= kth()[:, None]))
        near = s[r * m + c]
        order = np.lexsort((c, -near, r))
        r, c, near = r[order], c[order], near[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, near, place = (x[place < k] for x in (r, c, near, place))
        best, sim = np.full((n, k), -1), np.zeros((n, k))
        best[r, place], sim[r, place] = c, near
        return best, sim

    def vote(self, best: np.ndarray, sim: np.ndarray, prior: float) -> np.ndarray:
        """The distance-weighted share of label 1 among neighbours; prior where there are none."""
        w = np.where(best >= 0, sim / (1.02 - np.minimum(sim, 1)), 0) * self.weights[best] if len(self.ids) else np.zeros(best.shape)
        y = self.labels[best] if len(self.ids) else np.zeros(best.shape)
        total = w.sum(1)
        return np.where(total > 0, (w * y).sum(1) / np.where(total > 0, total, 1), prior)


@dataclass
class Model:
    weight: np.ndarray
    unseen: float
    index: BlockMaxIndex
    prior: float
    votes: np.ndarray
    shares: np.ndarray

    def score(self, terms: Rows, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of texts, their nearest examples and similarities; a text that is an example itself (own: its row, or -1) isn't its own neighbour, unless it has copies."""
        best, sim = self.index.search(terms, K, own)
        return self.calibrated(self.index.vote(best, sim, self.prior)), best, sim

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        return np.interp(vote, self.votes, self.shares) if len(self.votes) else vote


def calibrate(vote: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes, shares of label 1) of an isotonic fit: the ends of each of its steps, with a line from one step to the next."""
    at, place = np.unique(vote, return_inverse=True)
    ones, total = np.bincount(place, weight * y, len(at)), np.bincount(place, weight, len(at))
    steps: list[list[float]] = []  # lowest and highest vote, weight of label 1, weight
    for step in zip(at, at, ones, total, strict=True):
        steps.append(list(step))
        while len(steps) > 1 and steps[-2][2] * steps[-1][3] >= steps[-1][2] * steps[-2][3]:
            _, high, ones, total = steps.pop()
            steps[-1][1:] = [high, steps[-1][2] + ones, steps[-1][3] + total]
    return np.array([v for low, high, _, _ in steps for v in (low, high)]), np.array([ones / total for _, _, ones, total in steps for _ in "lh"])


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) and evidence (up to three nearest examples: doc_id, label, cosine).

    Null, empty and other texts without a word of the examples have the calibrated share of label 1 among labelled examples without one.
    Without labels of both classes the score is the share of label 1 for all (0 if there are no labels). Repeated rows are scored each.
    """
    scratch = Scratch(spark, "toxicity")
    sample, counts = labelled_sample(labels, label, per_class)
    sample = scratch.save(sample, "sample")
    examples, copied, terms, chi2 = choose_terms(scratch, docs, sample)
    compact = scratch.save(term_counts(docs, terms), "terms")
    n = compact.count()
    df = np.ones(len(terms))
    seen = compact.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # words of at most 2 * per_class rows
    df[seen.column("t").to_numpy()] = seen.column("count").to_numpy()
    by_term = (np.log((1 + n) / (1 + df)) + 1) * chi2
    unseen = float(np.log((1 + n) / 2) + 1) ** 2 if n else 0.0  # of a word that one document has, with a chi-square of 1
    found = compact.withColumnRenamed("doc_id", "id").join(F.broadcast(examples), "id").groupBy("id", "label").agg(F.min(F.struct("terms", "counts", "rest")).alias("e"))
    found = found.select("id", "label", "e.terms", "e.counts", "e.rest").orderBy("id").collect()  # at most 2 * per_class rows
    y = np.array([r.label for r in found], float)
    x = vectors([np.array(r.terms, int) for r in found], [np.array(r.counts) for r in found], by_term, unseen * np.array([r.rest for r in found]))
    # a class's examples stand for all of its labelled rows
    share = {c: counts.get(c, 0) / max(1.0, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0]) if len(y) else y
    none = ~x.any() if len(y) else np.empty(0, bool)
    total = sum(counts.values())
    prior = float((weight * y)[none].sum() / weight[none].sum()) if none.any() else (counts.get(1, 0) / total if total else 0.0)
    index = BlockMaxIndex.build(np.array([r.id for r in found], np.int64)[~none], y[~none], weight[~none], x.take(np.flatnonzero(~none)))
    alone = {int(i): k for k, i in enumerate(index.ids) if int(i) not in copied}
    vote = np.full(len(y), prior)
    if (~none).any():
        own = np.array([alone.get(r.id, -1) for r, z in zip(found, none, strict=True) if not z])
        vote[~none] = index.vote(*index.search(x.take(np.flatnonzero(~none)), K, own), prior)
    votes, shares = calibrate(vote, y, weight) if terms else (np.empty(0), np.empty(0))
    model = Model(by_term, unseen, index, prior, votes, shares)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own = np.array([alone.get(i, -1) for i in part.column("doc_id").to_pylist()], int)
                rest = model.unseen * part.column("rest").to_numpy()
                score, best, sim = model.score(weighted(*flat_lists(part.column("terms")), flat_lists(part.column("counts"))[1], model.weight, rest), own)
                near = [[{"doc_id": int(index.ids[r]), "label": int(index.labels[r]), "cosine": float(s)} for r, s in zip(rs[:3], ss[:3], strict=True) if r >= 0] for rs, ss in zip(best, sim, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64()), pa.array(near, kind)], names=["doc_id", "score", "evidence"])

    out = compact.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: bigint, label: int, cosine: double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
