"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations only.

A text's key is its 64-bit hash; the slot of a key is its first bits. The directory begins with one bucket and doubles: a bucket
with more distinct texts than `capacity` is split by its next bit, until it fits or the slot bits are used up (there are more of
them the more rows there are). Owners have consecutive buckets, so each a range of keys, cut so that their bytes are about equal. Every row's text goes to
the owner of its bucket, which compares bytes, counts equal texts and writes an entry for each. A key of very many rows, as a common text makes, has helpers
beside its owner, and their entries of one text are put together by the owner, by key and digest. Entries of one key whose texts differ are chained, and each
link has its number. An owner's entries are one file of the index, in order of bucket and key.

Rows are then looked up: the directory tells their owner and bucket, and the bucket's entries the row that stays. Entries of so many rows that an owner would feel them
are bounded in number and go to all tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, partitions_for

#: Slot bits at least and at most, bytes of input for each owner, and owners at most.
SLOT_BITS, MOST_BITS, OWNER_BYTES, MOST_OWNERS = 12, 20, 16 << 20, 1 << 16
#: A key or entry is common above this part of the rows (or an owner's part, where there are more owners), and rows of one at least.
COMMON, FEW = 1000, 100
#: Bytes that a row counts for beside its text when owners' ranges are cut.
ROW_BYTES = 64


@dataclass
class Index:
    """entries: owner, bucket, key, chain, sha256, keep_id, group_size; directory: slot, bucket, depth, owner; rows: id, key, sha256, size of every row; bits of a slot; rows above which a text is common; number of owners."""

    entries: DataFrame
    directory: DataFrame
    rows: DataFrame
    bits: int
    common: int
    owners: int

    def placed(self, df: DataFrame) -> DataFrame:
        """df (with key) and the bucket and owner that the directory has for it."""
        return df.withColumn("slot", slot_of(self.bits)).join(F.broadcast(self.directory.select("slot", "bucket", "owner")), "slot").drop("slot")  # 2**MOST_BITS rows at most


def slot_of(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("key"), 64 - bits).cast("int")


def split_directory(counts: dict[int, int], capacity: int, bits: int = SLOT_BITS) -> list[tuple[int, int, int]]:
    """(slot, bucket, depth) for all 2**bits slots; a bucket is named by its first slot."""
    prefix = [0]
    for s in range(1 << bits):
        prefix.append(prefix[-1] + counts.get(s, 0))
    out, todo = [], [(0, 0)]
    while todo:
        first, depth = todo.pop()
        width = 1 << (bits - depth)
        if depth < bits and prefix[first + width] - prefix[first] > capacity:
            todo += [(first, depth + 1), (first + width // 2, depth + 1)]
        else:
            out += [(s, first, depth) for s in range(first, first + width)]
    return out


def with_owners(directory: list[tuple[int, int, int]], load: dict[int, int], owners: int) -> list[tuple[int, int, int, int]]:
    """(slot, bucket, depth, owner): consecutive buckets to each owner, with about equal parts of the slots' load."""
    of_bucket: dict[int, int] = {}
    for slot, bucket, _ in directory:
        of_bucket[bucket] = of_bucket.get(bucket, 0) + load.get(slot, 0)
    total, before, owner = max(1, sum(of_bucket.values())), 0, {}
    for bucket in sorted(of_bucket):
        owner[bucket] = min(owners - 1, (2 * before + of_bucket[bucket]) * owners // (2 * total))  # by the bucket's middle
        before += of_bucket[bucket]
    return [(slot, bucket, depth, owner[bucket]) for slot, bucket, depth in directory]


def build_index(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000) -> Index:
    """Index docs by their text, lower-cased in A-Z only; null counts as empty.

    Of equal texts the row with the largest id is kept (null ids last of all; rows with the same id and text
    count one each). An empty table gives an empty index. Other columns aren't read.
    """
    scratch = Scratch(spark, "exact")
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"))
    digest = F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha256")
    rows = scratch.save(norm.select("id", F.xxhash64("norm").alias("key"), digest, F.octet_length("norm").cast("long").alias("size")), "rows")
    n, owners = rows.count(), min(MOST_OWNERS, partitions_for(docs, OWNER_BYTES))
    capacity = max(1, min(capacity, n // (4 * owners)), n >> (MOST_BITS - 2))  # buckets enough for all owners, and slots enough for all buckets
    bits = min(MOST_BITS, max(SLOT_BITS, math.ceil(math.log2(n / capacity + 1)) + 2))
    index = Index(rows, rows, rows, bits, max(FEW, n // max(COMMON, owners)), owners)
    # fewer keys than the larger of COMMON and MOST_OWNERS
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > index.common).select("key", F.ceil(F.col("m") / index.common).alias("helpers"))
    hot = F.broadcast(scratch.save(hot, "hot"))
    # at most 2**bits counts reach the driver; texts of a hot key load no owner more than others
    load = F.sum(F.when(F.col("helpers").isNull(), F.col("size") + ROW_BYTES).otherwise(0))
    found = rows.join(hot, "key", "left").groupBy(slot_of(bits).alias("slot")).agg(F.approx_count_distinct("key").alias("texts"), load.alias("load")).collect()
    directory = with_owners(split_directory({r.slot: r.texts for r in found}, capacity, bits), {r.slot: r["load"] for r in found}, owners)
    index.directory = scratch.save(spark.createDataFrame(directory, "slot int, bucket int, depth int, owner int").coalesce(1), "directory")
    # whole texts go to the owners of their buckets, where they are compared; grouping needs no other exchange
    texts = index.placed(norm.select("id", F.xxhash64("norm").alias("key"), "norm")).join(hot, "key", "left")
    helper = F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.col("helpers")), F.lit(0))
    texts = texts.withColumn("task", F.pmod(F.col("owner") + helper, F.lit(owners)).cast("int")).repartitionById(owners, "task")
    found = texts.groupBy("task", "owner", "bucket", "key", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = scratch.save(found.select("owner", "bucket", "key", digest, "keep_id", "group_size"), "found")
    # one exchange: an owner's entries are put together, chained and written in order where they meet
    merged = found.repartitionById(owners, "owner").groupBy("owner", "bucket", "key", "sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chained = merged.withColumn("chain", F.expr("cast(row_number() over (partition by owner, bucket, key order by sha256) - 1 as int)"))
    entries = chained.select("owner", "bucket", "key", "chain", "sha256", "keep_id", "group_size").sortWithinPartitions("bucket", "key", "chain")
    index.entries = scratch.save(entries, "index")
    scratch.drop(found)
    return index


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Where the kept id stands on several equal rows, each of them says kept; `deduplicate` below takes one.
    """
    index = build_index(spark, docs, id_col, text_col, capacity)
    at, entry = ["owner", "bucket", "key", "sha256"], index.entries.select("owner", "bucket", "key", "sha256", "keep_id", "group_size")
    rows, big = index.placed(index.rows.drop("size")), F.col("group_size") > index.common
    common = rows.join(F.broadcast(entry.where(big)), at)  # fewer entries than the larger of COMMON and MOST_OWNERS
    rest = rows.join(F.broadcast(entry.where(big).select(*at)), at, "left_anti").repartitionById(index.owners, "owner")
    rest = rest.join(entry.where(~big).repartitionById(index.owners, "owner"), at)
    found = common.unionByName(rest)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def deduplicate(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000) -> DataFrame:
    """docs without later copies: for each text the row with the largest id, all columns as they were.

    Rows equal in id and text are told apart by nothing, so one of them stays.
    """
    groups = exact_groups(spark, docs, id_col, text_col, capacity).where("kept")
    scratch = Scratch(spark, "exact")
    kept = scratch.save(groups.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("__n")), "kept")
    marked = docs.withColumns({"__own": F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)})
    hit = marked.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi")
    if not kept.where("__n > 1").isEmpty():
        hit = hit.drop_duplicates([id_col, "__own"])
    return hit.drop("__own")
