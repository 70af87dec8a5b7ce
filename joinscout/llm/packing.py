"""Best-fit packing of token sequences, certified by lower bounds and repacked where they show a gap.

Documents become pieces of at most `capacity` ids. Pieces of full length are sequences by themselves. The
others are dealt over partitions, each packed by best-fit decreasing; dual feasible functions bound its number
of sequences from below. Every partition then gives up its worst-filled sequences (more if its bound shows a gap); they are
pooled, dealt over fewer partitions and packed again, until the sequences in all match the bound
of the whole, or a round gains nothing. A result is kept only if it has fewer sequences.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import encoder

#: Pieces a partition packs at a time.
PART = 20_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each length, by the fullest sequence that has room. Ties in the order given."""
    order = np.argsort(-lengths, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by room left
    rooms, n, out = 0, 0, np.empty(len(lengths), np.int64)  # rooms: bit r is set if free[r] has any
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        out[i] = b
        left = room - size
        if left:
            free[left].append(b)
            rooms |= 1 << left
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions; counts[x]: number of pieces of length x."""
    x = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.cumsum(counts), np.cumsum(counts * x)
    best = -(-int(volume[-1]) // capacity)
    e = np.arange(0, capacity // 2 + 1)
    # small pieces (< e) count nothing, large ones (> capacity - e) a whole sequence, the others their length
    small = np.where(e > 0, volume[np.maximum(e - 1, 0)], 0)
    total = capacity * (number[-1] - number[capacity - e]) + volume[capacity - e] - small
    best = max(best, int(-(-total.max() // capacity)))
    for k in range(1, 40):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


@dataclass
class Packed:
    """pieces: uid and the document's columns; placements: uid, sequence_id, offset; certificate: one row a round; sequences used, and the bound that no packing is below."""

    pieces: DataFrame
    placements: DataFrame
    certificate: list[dict]
    sequences: int
    bound: int

    def frame(self) -> DataFrame:
        return self.pieces.join(self.placements, "uid")


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, words: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (binary) of every row; null text counts as empty, which has the end id only."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, uid = encoder(tokenizer, words), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids_of = enc.encode(batch.column("text").slice(at, 1000))
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").slice(at, 1000).to_pylist(), ids_of, strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((uid, doc_id, piece, start // 4, len(part) // 4, part))
                        uid += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["uid", "doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "uid long, doc_id long, piece int, start long, length long, ids binary")


def _pack_parts(pool: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """uid, length, part, bin, offset, fill, bins, bound."""

    def pack(table):
        import pyarrow as pa

        uid, length = table.column("uid").to_numpy(), table.column("length").to_numpy()
        order = np.argsort(uid, kind="stable")
        uid, length = uid[order], length[order].astype(np.int64)
        bins = best_fit_decreasing(length, capacity)
        by = np.argsort(bins, kind="stable")
        sizes, b = length[by], bins[by]
        first = np.concatenate([[True], b[1:] != b[:-1]])
        before = np.cumsum(sizes) - sizes
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, length).astype(np.int64)
        n = len(uid)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        part = table.column("part")[0].as_py()
        return pa.table({"uid": uid[by], "length": sizes, "part": np.full(n, part, np.int64), "bin": b, "offset": offset, "fill": fill[b], "bins": np.full(n, len(fill), np.int64), "bound": np.full(n, bound, np.int64)})

    dealt = pool.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(pack, "uid long, length long, part long, bin long, offset long, fill long, bins long, bound long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, words: int | None = None) -> Packed:
    """Pack docs(doc_id, text) into as few sequences of at most `capacity` ids as bounds and exchange reach.

    Each document is its ids and then end_id; only longer ones are cut. Null or empty text is the end id alone;
    rows that repeat are packed each for itself (uid tells them apart); an empty table gives no piece; other columns aren't read.
    `words` bounds the encoder's cache, for workers whose memory other stages have used before.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(pieces_of(docs, tokenizer, capacity, end_id, words), "pieces")
    narrow = pieces.select("uid", "length")
    whole = narrow.where(F.col("length") == capacity).select("uid", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [whole]
    pool = narrow.where(F.col("length") < capacity)
    # the histogram has at most `capacity` rows
    histogram = {r.length: r["count"] for r in pool.groupBy("length").count().collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    total_bound, n = lower_bound(counts, capacity), int(counts.sum())
    certificate: list[dict] = []
    best = None  # the round kept for the pool, and its sequences
    kept_bins = 0
    for step in itertools.count():  # each round but the last saves a sequence, so it ends
        if not n:
            break
        parts = max(1, -(-n // PART))
        packed = scratch.save(_pack_parts(pool, parts, step, capacity), f"round{step}")
        by_part = packed.groupBy("part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        s = by_part.agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound"), F.sum((F.col("bins") == F.col("bound")).cast("int")).alias("certified")).first()
        certificate.append({"round": step, "pieces": n, "parts": parts, "sequences": kept_bins + s.bins, "parts_bound": s.bound, "certified": s.certified, "bound": total_bound})
        if best is not None and s.bins >= best[1]:
            break  # the exchange gained nothing: the round before stands
        best = (packed, s.bins, step)
        if kept_bins + s.bins <= total_bound or parts == 1 and step:
            break
        # a part with a gap gives its worst sequences, several for each one too many; a certified part its worst one
        worst = packed.groupBy("part", "bin").agg(F.max("fill").alias("fill"), F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        worst = worst.withColumn("rank", F.expr("row_number() over (partition by part order by fill, bin)"))
        worst = worst.where(F.expr(f"rank <= 1 + 40 * (bins - bound) and fill < {capacity}")).select("part", "bin", F.lit(True).alias("given"))
        marked = scratch.save(packed.join(worst, ["part", "bin"], "left"), f"marked{step}")
        stay = marked.where(F.col("given").isNull())
        pool = marked.where(F.col("given")).select("uid", "length")
        given = marked.where(F.col("given")).agg(F.count("*").alias("n"), F.count_distinct("part", "bin").alias("bins")).first()
        placed.append(_sequences(stay, step))
        kept_bins += s.bins - given.bins
        best, n = (marked.where(F.col("given")), given.bins, step), given.n
    if best is not None and n:
        placed.append(_sequences(best[0], best[2]))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    full = whole.count()
    return Packed(pieces, out, certificate, full + kept_bins + (best[1] if best is not None and n else 0), full + total_bound)


def _sequences(packed: DataFrame, step: int) -> DataFrame:
    """Sequences of packed parts are even numbers made of round, part and bin."""
    number = F.shiftleft(F.lit(step).cast("long"), 44) + F.shiftleft(F.col("part"), 18) + F.col("bin")
    return packed.select("uid", (number * 2).alias("sequence_id"), "offset")
