"""N-gram Jaccard join: exact links between documents whose word shingles are similar.

Tiles. A pair's band is set by the larger of its two set sizes; in a band, the hash range of shingles is cut into m slices, and
similar sets differ in at most d shingles, so at least m - d slices are the same in both. Each document names its slices by their content
and goes to the tiles of its first d + 1 names, fuller slices before others and then by hash; as the order is the same for all, any two
similar sets then meet in a tile.

Links. In a tile every document is first held against the tile's first one. Only tiles that afterwards lie in more than one component are
gone through pair by pair, and only between components. Hashed bitmaps bound the overlap from above by bit counts; what remains is decided by
intersecting the sorted shingle arrays. So a tile of many copies costs one comparison a document, and no link between components is lost.

Map tasks meet equal names among their own documents first, so that a tile gets one entry from each of them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions_for
from .components import components
from .shingles import mix, shingle_sets

_U = np.uint64
#: Documents a chunk of a map task holds, names it holds, and documents a tile is compared over at a time.
CHUNK, NAMES, TILE = 30_000, 2_000_000, 512
#: Input for each part of the names.
PART_BYTES = 16 << 20
#: Marks an entry that stands for several documents of its chunk; their numbers are below it.
SEVERAL = np.uint16(1 << 15)
#: Bits of the filter that keeps most texts without candidates from being shingled again, and candidates up to which it is used; beyond, texts are joined with them first.
FILTER_BITS, FILTERED = 1 << 23, 1 << 22


class Bands:
    """Bands of set sizes for a similarity of num / den, and the slices of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def top(self, band: int) -> int:
        return 4 << band

    def of(self, size: int) -> int:
        band = 0
        while self.top(band) < size:
            band += 1
        return band

    def differ(self, a: int, b: int) -> int:
        """The most shingles that similar sets of these sizes do not share."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def slices(self, band: int) -> int:
        d = self.differ(self.top(band), self.top(band))
        return math.ceil(1.1 * (d + 1)) + 1

    def names(self, hashes: np.ndarray) -> np.ndarray:
        """Tile names of one sorted shingle set."""
        size, out = len(hashes), []
        most = size * self.den // self.num
        for band in range(self.of(size), self.of(most) + 1):
            m = self.slices(band)
            wanted = self.differ(size, min(most, self.top(band))) + 1
            slot = ((hashes >> _U(32)) * _U(m)) >> _U(32)
            first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            content = np.add.reduceat(mix(hashes), first)
            name = mix(content + mix(slot[first] + _U(band << 32)))
            if len(name) > wanted:
                # fuller slices first: few shingles in a row are common to many documents that share a passage
                fullness = np.minimum(np.diff(np.append(first, size)), 255).astype(np.uint64)
                name = name[np.argpartition((_U(255) - fullness) << _U(56) | name >> _U(8), wanted - 1)[:wanted]]
            elif len(name) < wanted:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), slot[first])[: wanted - len(name)]
                name = np.concatenate([name, mix(mix(empty + _U(band << 32)) + _U(1))])
            out.append(name)
        return np.concatenate(out) if len(out) > 1 else out[0]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits a shingle, each shingle sets one; width a power of two, so a wide one folds to a narrow one."""
    width = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(hashes & _U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Exact: intersection and union of two sorted arrays."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b)) if len(a) else 0
    return den * common >= num * (len(a) + len(b) - common)


def bound_allows(a: int, bits_a: np.ndarray, b: int, bits_b: np.ndarray, num: int, den: int) -> bool:
    """False if bit counts show that sets of these sizes can't be similar."""
    words = min(len(bits_a), len(bits_b))
    x, y = fold(bits_a, words), fold(bits_b, words)
    most = min(a - int(np.bitwise_count(x & ~y).sum()), b - int(np.bitwise_count(y & ~x).sum()))
    return den * most >= num * (a + b - most)


def _profile(bands: Bands, n: int, parts: int):
    """Map tasks: rows of documents, of tile names by part, and of names that meet within the chunk."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        names: list[np.ndarray] = []
        held = 0

        def table(rows):
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "part", "uid", "doc_id", "text_hash", "n", "a", "b"])

        def flush():
            chunk = (task << 12 | seq) << 16
            for at in range(0, len(docs), 2000):
                yield table([(0, 0, chunk | at + i, d, h, size, bits, None) for i, (d, h, size, bits) in enumerate(docs[at : at + 2000])])
            if not names:
                return
            sig = np.concatenate(names)
            idx = np.repeat(np.arange(len(names), dtype=np.uint16), [len(x) for x in names])
            part = (sig % _U(parts)).astype(np.int64)
            short = sig >> _U(32)  # 32 bits, as parts grow with the input; a chance meeting costs a comparison
            order = np.lexsort((idx, short, part))
            part, short, idx = part[order], short[order], idx[order]
            first = np.concatenate([[True], (short[1:] != short[:-1]) | (part[1:] != part[:-1])])
            run_of = np.cumsum(first) - 1
            many = np.bincount(run_of)[run_of] > 1
            pivot = idx[first][run_of]
            rows = []
            edges = np.searchsorted(part, np.arange(parts + 1)).tolist()
            for p in range(parts):
                a, b = edges[p], edges[p + 1]
                if a == b:
                    continue
                f = first[a:b]
                s, i = short[a:b], idx[a:b]
                entry = np.where(many[a:b][f], i[f] | SEVERAL, i[f])
                rows.append((1, p, chunk, None, None, int(f.sum()), _pack(s[f]), entry.astype(np.uint16).tobytes()))
                if many[a:b].any():
                    k = many[a:b]
                    rows.append((2, p, chunk, None, None, int(k.sum()), _pack(s[k]), i[k].tobytes()))
            k = many & ~first
            pairs = np.unique(pivot[k].astype(np.uint32) << np.uint32(16) | idx[k].astype(np.uint32))
            if len(pairs):
                rows.append((3, 0, chunk, None, None, len(pairs), pairs.tobytes(), None))
            for at in range(0, len(rows), 500):
                yield table(rows[at : at + 500])

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                ids, texts, hashes = (batch.column(i).slice(at, 2000).to_pylist() for i in range(3))
                for doc_id, h, s in zip(ids, hashes, shingle_sets(texts, n), strict=True):
                    docs.append((doc_id, h, len(s), bitmap(s).tobytes() if len(s) else None))
                    names.append(bands.names(s) if len(s) else np.empty(0, np.uint64))
                    held += len(names[-1])
                    if len(docs) >= CHUNK or held >= NAMES:
                        yield from flush()
                        docs, names, held, seq = [], [], 0, seq + 1
        if docs:
            yield from flush()
        pa.default_memory_pool().release_unused()

    return run


def _pack(sig: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, in two planes of 16 bits of which the upper one is mostly zeros."""
    gap = np.diff(sig, prepend=_U(0))
    return gap.astype("<u2").tobytes() + (gap >> _U(16)).astype("<u2").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    k = len(raw) // 4
    return np.cumsum(np.frombuffer(raw, "<u2", k).astype(np.uint64) | np.frombuffer(raw, "<u2", k, 2 * k).astype(np.uint64) << _U(16), dtype=np.uint64)


def _meet(table):
    """Reduce tasks: (tile, uid, pivot, several) of every tile of one part that has entries of more than one chunk."""
    import pyarrow as pa

    sig, uid, several = [], [], []
    for raw, chunk, idx in zip(table.column("a").to_pylist(), table.column("uid").to_pylist(), table.column("b").to_pylist(), strict=True):
        entry = np.frombuffer(idx, np.uint16)
        sig.append(_unpack(raw))
        uid.append((entry & ~SEVERAL).astype(np.int64) | chunk)
        several.append(entry >= SEVERAL)
    s, u, t = np.concatenate(sig), np.concatenate(uid), np.concatenate(several)
    order = np.lexsort((u, s))
    s, u, t = s[order], u[order], t[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    run_of = np.cumsum(first) - 1
    many = np.bincount(run_of)[run_of] > 1
    part = table.column("part")[0].as_py()
    tile = s[many].astype(np.int64) | part << 32
    return pa.table({"tile": tile, "uid": u[many], "pivot": u[first][run_of][many], "several": t[many]})


def _explode_groups(batches):
    """(tile, uid) of the names that meet within a chunk."""
    import pyarrow as pa

    for batch in batches:
        for part, chunk, raw, idx in zip(*(batch.column(c).to_pylist() for c in ("part", "uid", "a", "b")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_unpack(raw).astype(np.int64) | part << 32), pa.array(np.frombuffer(idx, np.uint16).astype(np.int64) | chunk)], names=["tile", "uid"])


def _explode_pairs(batches):
    import pyarrow as pa

    for batch in batches:
        for chunk, raw in zip(batch.column("uid").to_pylist(), batch.column("a").to_pylist(), strict=True):
            p = np.frombuffer(raw, np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p >> 16 | chunk), pa.array(p & 0xFFFF | chunk)], names=["a", "b"])


def _prefilter(keys: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits of the keys' hashes; the driver gets at most FILTER_BITS / 64 numbers, whatever the input."""
    place = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(FILTER_BITS))
    words = keys.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key, 5), {FILTER_BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    found = words.toArrow()
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def _sets(n: int, wanted: np.ndarray | None):
    """Shingle sets of the rows whose place is in the bitmap, or of all."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = np.arange(len(place)) if wanted is None else np.flatnonzero(wanted[place >> 6] >> (place & 63).astype(np.uint64) & _U(1))
            for at in range(0, len(hit), 500):
                part = batch.take(pa.array(hit[at : at + 500]))
                sets = shingle_sets(part.column("text").to_pylist(), n)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), part.column("text_hash"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "doc_id", "text_hash", "hashes"])

    return run


def _bounded(num: int, den: int):
    """Pairs that bit counts leave."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "bits", "n_b", "bits_b")), strict=True)
            keep = [
                i for i, (m, x, k, y) in enumerate(rows)
                if min(m, k) * den >= num * max(m, k) and (x == y or bound_allows(m, np.frombuffer(x, np.uint64), k, np.frombuffer(y, np.uint64), num, den))
            ]
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    return run


def _verify(num: int, den: int):
    """Pairs whose sorted arrays are similar."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(batch.column("hashes").to_pylist(), batch.column("hashes_b").to_pylist(), strict=True)
            keep = [i for i, (x, y) in enumerate(rows) if x == y or linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)]
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    return run


def _tiles(batches, columns: tuple[str, ...]):
    """Each tile's columns as lists, from rows in order of tile, i and j."""
    held: dict[str, list] = {c: [] for c in columns}
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("tile", "i", "j")), strict=True))
        lists = {c: batch.column(c).to_pylist() for c in columns}
        at = 0
        while at < len(keys):
            if keys[at] != key:
                if held["uid"]:
                    yield key, held
                key, held = keys[at], {c: [] for c in columns}
            end = at
            while end < len(keys) and keys[end] == key:
                end += 1
            for c in columns:
                held[c] += lists[c][at:end]
            at = end
    if held["uid"]:
        yield key, held


def _partners(key: tuple, tile: dict[str, list], num: int, den: int):
    """(row, later rows by size) of other components that bit counts leave as partners."""
    across = key[1] != key[2]
    order = sorted(range(len(tile["uid"])), key=lambda r: (tile["n"][r], tile["uid"][r]))
    raw, n, root, side = tile["bits"], tile["n"], tile["root"], tile["side"]
    words = min(len(b) for b in raw) // 8
    if len(order) <= 24:
        bits = [int.from_bytes(b if len(b) == 8 * words else fold(np.frombuffer(b, np.uint64), words).tobytes(), "little") for b in raw]
        for k, r in enumerate(order):
            hit = []
            for o in order[k + 1 :]:
                if n[o] * num > n[r] * den:
                    break
                if root[r] == root[o] or across and side[r] == side[o]:
                    continue
                most = min(n[r] - (bits[r] & ~bits[o]).bit_count(), n[o] - (bits[o] & ~bits[r]).bit_count())
                if den * most >= num * (n[r] + n[o] - most):
                    hit.append(o)
            if hit:
                yield r, hit
        return
    place = np.array(order)
    size, roots, sides = np.array(n)[place], np.array(root)[place], np.array(side)[place]
    bits = np.stack([fold(np.frombuffer(raw[r], np.uint64), words) for r in order])
    for k in range(len(order)):
        end = int(np.searchsorted(size, size[k] * den // num, side="right"))
        differ = roots[k + 1 : end] != roots[k]
        if across:
            differ &= sides[k + 1 : end] != sides[k]
        others = np.flatnonzero(differ) + k + 1
        if len(others):
            b = bits[others]
            most = np.minimum(size[k] - np.bitwise_count(bits[k] & ~b).sum(1).astype(np.int64), size[others] - np.bitwise_count(b & ~bits[k]).sum(1).astype(np.int64))
            others = others[den * most >= num * (size[k] + size[others] - most)]
            if len(others):
                yield order[k], place[others].tolist()


TILE_COLUMNS = ("tile", "uid", "root", "side", "i", "j", "n", "bits")


def _tile_hits(num: int, den: int):
    """(a, b): pairs of other components that bit counts leave, as few of each tile as join all of its documents that have any."""

    def run(batches):
        import pyarrow as pa

        out: list[tuple[int, int]] = []
        for key, tile in _tiles(batches, TILE_COLUMNS):
            parent: dict[int, int] = {}

            def find(r, parent=parent):
                parent.setdefault(r, r)
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            for r, others in _partners(key, tile, num, den):
                for o in others:
                    x, y = find(r), find(o)
                    if x != y:
                        parent[x] = y
                        out.append((tile["uid"][r], tile["uid"][o]))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _tile_links(num: int, den: int):
    """Links between components within each tile, as few as join them."""

    def run(batches):
        import pyarrow as pa

        out: list[tuple[int, int]] = []
        for key, tile in _tiles(batches, (*TILE_COLUMNS, "hashes")):
            parent = {r: r for r in tile["root"]}
            sets: dict[int, np.ndarray] = {}

            def find(r, parent=parent):
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            def hashes(r, sets=sets, tile=tile):
                if r not in sets:
                    sets[r] = np.frombuffer(tile["hashes"][r], np.uint64)
                return sets[r]

            for r, others in _partners(key, tile, num, den):
                for o in others:
                    x, y = find(tile["root"][r]), find(tile["root"][o])
                    if x != y and linked(hashes(r), hashes(o), num, den):
                        parent[max(x, y)] = min(x, y)
                        out.append((tile["uid"][r], tile["uid"][o]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _roots(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows: uid, doc_id, text_hash and n of every row; roots: uid and root of the rows that link)."""
    scratch = Scratch(spark, "ngram")
    bands, parts = Bands(num, den), partitions_for(docs, PART_BYTES)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    schema = "kind byte, part int, uid long, doc_id long, text_hash long, n long, a binary, b binary"
    profile = scratch.save(own.mapInArrow(_profile(bands, words, parts), schema), "profile")
    rows = profile.where("kind = 0").select("uid", "doc_id", "text_hash", "n")
    bits = profile.where("kind = 0 and n > 0").select("uid", "n", F.col("a").alias("bits"))

    met = profile.where("kind = 1").select("part", "uid", "a", "b").groupBy("part").applyInArrow(_meet, "tile long, uid long, pivot long, several boolean")
    met = scratch.save(met, "met")
    scratch.sweep()
    in_chunk = profile.where("kind = 3").select("uid", "a").mapInArrow(_explode_pairs, "a long, b long")
    pairs = met.where("uid <> pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).unionByName(in_chunk).distinct()
    left, right = bits.select(F.col("uid").alias("a"), "n", "bits"), bits.select(F.col("uid").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    pairs = scratch.save(pairs.join(right, "b").join(left, "a").mapInArrow(_bounded(num, den), "a long, b long"), "pairs")
    scratch.sweep()

    place = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(FILTER_BITS)).alias("place")
    keyed = own.select(F.xxhash64("doc_id", "text_hash").alias("key"), "doc_id", "text_hash", "text").select("key", "doc_id", "text_hash", place, "text")

    def sets_of(uids: DataFrame, name: str) -> DataFrame:
        """(uid, hashes): shingles again, of some rows only, by their id and text."""
        named = rows.join(uids.distinct(), "uid").select("uid", F.xxhash64("doc_id", "text_hash").alias("key"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
        named = scratch.save(named, f"{name}-names")
        keys, schema = named.select("key").distinct(), "key long, doc_id long, text_hash long, hashes binary"
        if named.count() <= FILTERED:
            found = keyed.mapInArrow(_sets(words, _prefilter(named)), schema).join(keys, "key", "left_semi")
        else:
            found = keyed.join(keys, "key", "left_semi").select(*keyed.columns).mapInArrow(_sets(words, None), schema)
        found = found.dropDuplicates(["key", "doc_id", "text_hash"])  # rows that repeat have one text
        # beside the key, which it is dealt by, a row must have the id and the text
        same_id = F.coalesce(found["doc_id"].bitwiseXOR(named["d"]), F.when(found["doc_id"].isNull() & named["d"].isNull(), 0).otherwise(1)) == 0
        same = (found["text_hash"].bitwiseXOR(named["h"]) == 0) & same_id
        return scratch.save(found.join(named, (found["key"] == named["key"]) & same).select("uid", "hashes"), name)

    sets = sets_of(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))), "sets")
    checked = pairs.join(sets.select(F.col("uid").alias("b"), F.col("hashes").alias("hashes_b")), "b").join(sets.withColumnRenamed("uid", "a"), "a")
    links = scratch.save(checked.select("a", "b", "hashes", "hashes_b").mapInArrow(_verify(num, den), "a long, b long"), "links")
    scratch.drop(sets)
    scratch.sweep()
    roots = scratch.save(components(scratch, links), "roots")

    # tiles in more than one component yet
    member = met.where("not several").select("tile", "uid").unionByName(profile.where("kind = 2").select("part", "uid", "a", "b").mapInArrow(_explode_groups, "tile long, uid long"))
    member = member.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("tile", "uid", F.coalesce("root", "uid").alias("root"))
    member = scratch.save(member, "members")
    alike = [F.count(F.lit(1)).alias("size"), F.expr("bit_xor(xxhash64(uid))").alias("x"), F.expr("bit_xor(xxhash64(uid, 1))").alias("y")]
    open_tiles = member.groupBy("tile").agg(F.min("root").alias("r"), F.max("root").alias("s"), *alike)
    # tiles of the same documents are one
    open_tiles = open_tiles.where("r <> s").groupBy("size", "x", "y").agg(F.min("tile").alias("tile")).select("tile", "size")

    def dealt(df: DataFrame) -> DataFrame:
        """Rows of (tile, size, uid, root) by blocks of TILE: each block meets itself and every other."""
        df = df.withColumn("k", F.expr(f"cast(ceil(size / {TILE}) as int)"))
        df = df.withColumn("side", F.expr("cast(pmod(xxhash64(uid, 3), k) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        return df.select("tile", "uid", "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def in_tiles(df: DataFrame) -> DataFrame:
        return df.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")

    split = dealt(member.join(open_tiles, "tile")).join(bits, "uid").select(*TILE_COLUMNS)
    hits = scratch.save(in_tiles(split).mapInArrow(_tile_hits(num, den), "a long, b long").distinct(), "hits")
    scratch.drop(member)
    scratch.sweep()
    more = hits.limit(0)
    if not hits.isEmpty():
        # documents that may still link, each with its shingles once: what bit counts join is a tile
        near = scratch.save(components(scratch, hits).select(F.col("node").alias("uid"), F.col("root").alias("tile")), "near")
        near = near.join(near.groupBy("tile").agg(F.count(F.lit(1)).alias("size")), "tile").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
        near = scratch.save(near.select("tile", "size", "uid", F.coalesce("root", "uid").alias("root")), "near")
        some = dealt(near).join(bits, "uid").join(sets_of(near.select("uid"), "tile-sets"), "uid").select(*TILE_COLUMNS, "hashes")
        more = scratch.save(in_tiles(some).mapInArrow(_tile_links(num, den), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        joined = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        upper = components(scratch, joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        low = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = scratch.save(low.unionByName(upper).groupBy("node").agg(F.min("root").alias("root")), "roots")
    return rows, roots.withColumnRenamed("node", "uid")


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row.

    Two rows link when den * |intersection| >= num * |union| of their distinct word shingles (A-Z lower-cased; fewer words than a shingle are one).
    Null and empty texts, and those without words, have no shingle and link with nothing. Repeated rows link like any
    others. A null id is a row like any other; a component's smallest id is a real one if it has any. Empty tables give an empty result.
    """
    rows, roots = _roots(spark, docs, id_col, text_col, words, num, den)
    members = rows.join(roots, "uid").select("uid", "root", "doc_id")
    smallest = members.groupBy("root").agg(F.min("doc_id").alias("smallest"))
    classes = members.join(smallest, "root").select("uid", "smallest")
    out = rows.join(classes, "uid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the smallest id, then text hash, null ids last.

    Rows are told apart by id and text, so other rows of an id stay. Of rows of a component equal in both one stays.
    """
    rows, roots = _roots(spark, docs, id_col, text_col, words, num, den)
    each = rows.join(roots, "uid").groupBy("root", F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count(F.lit(1)).alias("m"))
    each = Scratch(spark, "near").save(each, "each")
    best = each.groupBy("root").agg(F.min(F.struct("none", "id", "hash")).alias("best"))
    marked = each.join(best, "root").withColumn("gone", ~F.struct("none", "id", "hash").eqNullSafe(F.col("best")))

    def meets(names: DataFrame, how: str) -> DataFrame:
        names = names.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"))
        return own.join(names, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), how)

    own = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    if each.where("m > 1").isEmpty():
        return meets(marked.where("gone"), "left_anti").drop("__own")
    several = marked.where("not gone and m > 1")
    first = meets(several, "left_semi").drop_duplicates([id_col, "__own"])
    return meets(marked.where("gone").unionByName(several), "left_anti").unionByName(first).drop("__own")


def oracle(words: int = 5, num: int = 80, den: int = 100) -> str:
    """The same in SQL, by all pairs that share a shingle, over documents."""
    return f"""
    WITH RECURSIVE w AS MATERIALIZED (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
    s AS MATERIALIZED (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < {words} THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - {words - 2}), lambda i: array_to_string(t[i : i + {words - 1}], ' ')) END) AS g FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS MATERIALIZED (
      SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING {den} * count(*) >= {num} * (p.n + q.n - count(*))),
    reach AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, y FROM reach JOIN links ON links.x = reach.other)
    SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(reach.other), w.doc_id) AS component_id
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.doc_id = w.doc_id
    GROUP BY w.doc_id
    """
