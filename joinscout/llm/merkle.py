"""Merkle manifest of a dataset: a tree of fanout 16 over each source's documents, a tree over the sources, and a proof for every row.

Nodes are 64-byte hex digests. A group's leaves are numbered in order by ranges of rows, without a sort of a whole source in one task, and cut into
aligned blocks of 16**3. A task has a block's digests as one contiguous numpy matrix, which it hashes level by level, 16 rows at once; siblings
come by index arithmetic. The blocks' tops are the leaves of the next pass. Then the passes are gone through from the top: a
block gets what stands beside its ancestors (once a block, not once a row) and gives it to its own nodes with what stands beside them.

Defined results: null and equal ids are ordered before others and by leaf, equal rows are leaves of their own with equal
digests; null source is a source of its own, the first; an empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, shuffle_partitions

FANOUT = 16
#: Levels of a pass; a block has FANOUT**LEVELS leaves.
LEVELS = 3
BLOCK = FANOUT**LEVELS
HEX = 64


def encoded(fields: list[Column]) -> Column:
    """Each value as its length in bytes, a colon and itself, null as a hyphen, one after the other."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.concat(*parts)


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(encoded(fields).cast("binary"), 256)


def depth_of(n: int) -> int:
    """Levels above n leaves."""
    d = 0
    while FANOUT**d < n:
        d += 1
    return d


# ---- one block, as numpy ----


def matrix(digests) -> object:
    """Digests as rows of 64 bytes."""
    import numpy as np

    return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, HEX)


def hashed(rows: list[bytes]) -> object:
    import numpy as np

    return np.frombuffer("".join([sha256(r).hexdigest() for r in rows]).encode("ascii"), np.uint8).reshape(-1, HEX)


def tree_levels(leaves, levels: int) -> list:
    """The block's matrices from the leaves up; each row above hashes FANOUT rows, the last one what is left."""
    out = [leaves]
    for _ in range(levels):
        raw = out[-1].tobytes()
        out.append(hashed([raw[i : i + FANOUT * HEX] for i in range(0, len(raw), FANOUT * HEX)]))
    return out


def siblings(levels: list, n: int):
    """For leaf i of n: (bytes, starts of each leaf and level in them, how many bytes stand on the left). By index arithmetic over the stacked levels."""
    import numpy as np

    height = len(levels) - 1
    base = np.cumsum([0, *[len(x) for x in levels[:-1]]])[:-1] if height else np.zeros(0, np.int64)
    stack = np.concatenate(levels[:-1]) if height else np.zeros((0, HEX), np.uint8)
    leaf, step = np.arange(n)[:, None], np.arange(FANOUT - 1)[None, :]
    index, there, left = [], [], np.zeros((n, height), np.int64)
    for level in range(height):
        own = leaf // FANOUT**level
        place = own % FANOUT
        at = own - place + step + (step >= place)
        index.append(at + base[level])
        there.append(at < len(levels[level]))
        left[:, level] = place[:, 0] * HEX
    if not height:
        return b"", np.zeros((n, 1), np.int64), left
    there = np.stack(there, 1)
    sizes = there.sum(2) * HEX
    starts = np.concatenate([[0], np.cumsum(sizes.ravel())])
    raw = stack[np.stack(index, 1)[there]].tobytes()
    return raw, np.concatenate([starts[:-1].reshape(n, height), starts[height::height, None]], 1), left


# ---- passes over the groups ----

_UP = "left array<binary>, right array<binary>, subroot string, root string"


def _tops(key, table):
    """A block's top node."""
    import pyarrow as pa

    order = table.column("pos").to_numpy().argsort()
    digests = table.column("digest").take(pa.array(order)).to_pylist()
    depth = depth_of(table.column("n")[0].as_py()) - LEVELS * table.column("pass")[0].as_py()
    top = tree_levels(matrix(digests), max(0, min(LEVELS, depth)))[-1]
    return pa.table({"grp": table.column("grp").slice(0, 1), "pos": pa.array([key[1].as_py()], pa.int64()), "n": table.column("n").slice(0, 1), "digest": pa.array([top.tobytes().decode("ascii")])})


def _climb(own, lefts: list[bytes], rights: list[bytes]):
    for a, b in zip(lefts, rights, strict=True):
        own = sha256(a + own + b).hexdigest().encode("ascii")
    return own


def _block(nodes, above) -> tuple:
    """A block's nodes in order, and for each the siblings of its levels; what stands beside the block's ancestors."""
    import pyarrow as pa

    nodes = nodes.take(pa.array(nodes.column("pos").to_numpy().argsort()))
    up = above.to_pylist()[0]
    depth = depth_of(nodes.column("n")[0].as_py()) - LEVELS * nodes.column("pass")[0].as_py()
    levels = tree_levels(matrix(nodes.column("digest").to_pylist()), max(0, min(LEVELS, depth)))
    raw, starts, left = siblings(levels, len(nodes))
    return nodes, up, raw, starts.tolist(), left.tolist()


def _inherit(nodes, above):
    """(grp, pos, left, right, subroot, root) of a block's nodes: what stands beside them and beside their ancestors, from below up."""
    import pyarrow as pa

    nodes, up, raw, starts, left = _block(nodes, above)
    lefts, rights = [], []
    for s, l in zip(starts, left, strict=True):
        lefts.append([raw[a : a + w] for a, w in zip(s[:-1], l, strict=True)] + up["left"])
        rights.append([raw[a + w : b] for a, b, w in zip(s[:-1], s[1:], l, strict=True)] + up["right"])
    n = len(nodes)
    return pa.table({"grp": nodes.column("grp"), "pos": nodes.column("pos"), "left": pa.array(lefts, pa.list_(pa.binary())), "right": pa.array(rights, pa.list_(pa.binary())), "subroot": pa.array([up["subroot"]] * n, pa.string()), "root": pa.array([up["root"]] * n, pa.string())})


def _prove(nodes, above):
    """Each leaf's proof digest, and the root that its claimed digest folds to."""
    import pyarrow as pa

    nodes, up, raw, starts, left = _block(nodes, above)
    rest = b"".join(a + b for a, b in zip(up["left"], up["right"], strict=True))
    proofs, folded = [], []
    for s, l, claimed in zip(starts, left, nodes.column("claimed").to_pylist(), strict=True):
        proofs.append(sha256(raw[s[0] : s[-1]] + rest).hexdigest())
        own = _climb(claimed.encode("ascii"), [raw[a : a + w] for a, w in zip(s[:-1], l, strict=True)], [raw[a + w : b] for a, b, w in zip(s[:-1], s[1:], l, strict=True)])
        folded.append(_climb(own, up["left"], up["right"]).decode("ascii"))
    n = len(nodes)
    return pa.table({"id": nodes.column("id"), "leaf": nodes.column("digest"), "subroot": pa.array([up["subroot"]] * n, pa.string()), "root": pa.array([up["root"]] * n, pa.string()), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)})


def numbered(scratch: Scratch, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(grp, ...) with `pos` in its group by `order` (from 0) and the group's `n`.

    Rows are dealt by ranges and sorted within; a group's counts a range give the first number of each. A group may take many ranges.
    """
    keys = ["grp", *order]
    spread = rows.repartitionByRange(shuffle_partitions(scratch.spark), *[F.asc_nulls_first(k) for k in keys]).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys])
    spread = scratch.save(spread.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "order")
    ranges = spread.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("m"), F.min("__row").alias("__lo"))
    over = Window.partitionBy("grp").orderBy("__part")  # a row a range
    before = F.coalesce(F.sum("m").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("grp").alias("__g"), F.col("__part").alias("__p"), (before - F.col("__lo")).alias("__shift"), F.sum("m").over(Window.partitionBy("grp")).alias("n"))
    out = spread.join(ranges, F.col("grp").eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return out.withColumn("pos", F.col("__row") + F.col("__shift")).drop("__g", "__p", "__part", "__row", "__shift")


def _passes(scratch: Scratch, leaves: DataFrame) -> list[DataFrame]:
    """The tables of nodes of each pass, leaves first, one node a group last."""
    out = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    kind = leaves.schema["grp"].dataType.simpleString()
    for p in range(-(-depth_of(most) // LEVELS)):
        nodes = out[-1].select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest", F.lit(p).alias("pass"))
        out.append(scratch.save(nodes.groupBy("grp", "block").applyInArrow(_tops, f"grp {kind}, pos long, n long, digest string"), "tops"))
    return out


def _down(scratch: Scratch, passes: list[DataFrame], up: DataFrame, until: int) -> DataFrame:
    """What stands beside the nodes of pass `until` and their ancestors; up: beside the top nodes."""
    kind = passes[0].schema["grp"].dataType.simpleString()
    for p in reversed(range(until, len(passes) - 1)):
        up = scratch.save(_joined(passes[p], p, up, ["digest"]).applyInArrow(_inherit, f"grp {kind}, pos long, {_UP}"), "beside")
    return up


def _joined(nodes: DataFrame, p: int, up: DataFrame, columns: list[str]):
    """Blocks of pass p with what stands beside their top nodes, once a block."""
    blocks = nodes.select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", F.lit(p).alias("pass"), *columns)
    return blocks.groupBy("grp", "block").cogroup(up.withColumnRenamed("pos", "block").groupBy("grp", "block"))


def manifest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows(id, grp, leaf, claimed).

    claimed: the digest that is put in the leaf's place when the proof is folded to `folded_root`.
    """
    scratch = Scratch(spark, "merkle")
    named = rows.select("id", "grp", F.col("leaf").alias("digest"), "claimed", F.monotonically_increasing_id().alias("__tie"))
    leaves = scratch.save(numbered(scratch, named, ["id", "digest", "__tie"]).drop("__tie"), "leaves")
    passes = _passes(scratch, leaves)
    tops = passes[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("source"), "digest")
    roots = scratch.save(numbered(scratch, tops, ["source"]), "roots")
    above = _passes(scratch, roots)
    first = above[-1].select("grp", "pos", F.lit(None).cast("array<binary>").alias("left"), F.lit(None).cast("array<binary>").alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    first = first.withColumns({"left": F.array().cast("array<binary>"), "right": F.array().cast("array<binary>")})
    beside = _down(scratch, above, first, 0)
    placed = roots.select("pos", F.col("source").alias("grp"), "digest").join(beside.drop("grp", "subroot"), "pos")
    up = scratch.save(placed.select("grp", F.lit(0).cast("long").alias("pos"), "left", "right", F.col("digest").alias("subroot"), "root"), "sources")
    up = _down(scratch, passes, up, 1)
    kind = leaves.schema["id"].dataType.simpleString()
    proved = _joined(leaves, 0, up, ["digest", "claimed", "id"]).applyInArrow(_prove, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The manifest of documents by source; where 5 divides the crc32 of an id, the claimed row has its text's A-Z lower-cased."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = leaf_digest([F.col(c) for c in fields])
    tampered = leaf_digest([*[F.col(c) for c in fields[:-1]], F.when(F.col("text").isNotNull(), ascii_lower(F.col("text")))])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), leaf.alias("leaf"), F.when(hit, tampered).otherwise(leaf).alias("claimed"))
    return manifest(spark, rows).withColumnRenamed("id", "doc_id")


def oracle(levels: int = 4, above: int = 3) -> str:
    """SQL for sources of at most 16**levels documents and at most 16**above sources."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def steps(name: str, by: str, n: int) -> str:
        out = []
        for i in range(n):
            out.append(f"""
            {name}_r{i} AS (SELECT {by}, pos // 16 AS run, list(d ORDER BY pos) AS ds, sum(count(*)) OVER (PARTITION BY {by}) AS alive FROM {name}{i} GROUP BY {by}, pos // 16),
            {name}{i + 1} AS (SELECT {by}, run AS pos, CASE WHEN alive > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {name}_r{i})""")
        return ",".join(out)

    def fold(name: str, on: str, n: int, start: str, first: str) -> tuple[str, str]:
        """Fold column `own` and proof text `proof` through n levels."""
        out, last = [], start
        for i in range(n):
            ds, place = "r.ds", f"(({first} // {16**i}) % 16)"
            out.append(f"""
            {start}_{i} AS (SELECT x.* EXCLUDE (own, proof),
              CASE WHEN alive > 1 THEN sha256(array_to_string({ds}[1:{place}], '') || own || array_to_string({ds}[{place} + 2:], '')) ELSE own END AS own,
              CASE WHEN alive > 1 THEN proof || array_to_string({ds}[1:{place}], '') || array_to_string({ds}[{place} + 2:], '') ELSE proof END AS proof
              FROM {last} x JOIN {name}_r{i} r ON {on} AND r.run = {first} // {16 ** (i + 1)})""")
            last = f"{start}_{i}"
        return ",".join(out), last

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 of a short decimal text by the bitwise rule
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"""
    a, last_a = fold("s", "x.src IS NOT DISTINCT FROM r.src", levels, "f", "x.pos")
    b, last_b = fold("g", "true", above, "h", "x.gpos")
    return f"""
    WITH c AS (SELECT doc_id, source, {" || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars"))} AS head, {field("text")} AS tail, {field(low)} AS low, xor({crc}, 4294967295) % 5 = 0 AS hit FROM documents),
    v AS (SELECT doc_id, source AS src, sha256(head || tail) AS leaf, CASE WHEN hit THEN sha256(head || low) ELSE sha256(head || tail) END AS claimed FROM c),
    p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM v),
    s0 AS (SELECT src, pos, leaf AS d FROM p),
    {steps("s", "src", levels)},
    t AS (SELECT src, d AS subroot, row_number() OVER (ORDER BY src::BLOB NULLS FIRST) - 1 AS gpos FROM s{levels}),
    g0 AS (SELECT 0 AS one, gpos AS pos, subroot AS d FROM t),
    {steps("g", "one", above)},
    f AS (SELECT p.doc_id, p.leaf, p.src, p.pos, t.gpos, t.subroot, claimed AS own, '' AS proof FROM p JOIN t ON p.src IS NOT DISTINCT FROM t.src),
    {a},
    h AS (SELECT * FROM {last_a}),
    {b}
    SELECT doc_id, leaf, subroot, (SELECT d FROM g{above}) AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = (SELECT d FROM g{above}) AS verified FROM {last_b}
    """
