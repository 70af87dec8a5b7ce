"""Ranked lexical search: term-bucketed postings, a join with the items' terms, integer scores, top k by window.

Postings are rows (bucket, term, document, length, count) of a table that is bucketed by document, so that all postings of a
document lie in one file, and sorted by the bucket of their term, so that a scan for a few terms skips the other row groups. Scores of
a document and an item are summed where its postings lie, without a shuffle of matches, and each task hands on no more than its own k
best of an item. Work grows with matches, what is shuffled with postings.

Defined results: null and empty texts have no terms and count in nothing; rows of one document id are documents of their own, equal
scores are ordered by id and then by row; rows of one item id are one item with the terms of all, once each; an item without a
document that scores above 0 has no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, partitions_for

#: What stands between terms.
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Buckets of terms; the bucket of a document's own row.
BUCKETS, DOCUMENT = 1024, -1
#: Bytes of documents' files to a file of postings, and how many files Spark allows at most.
BYTES, MOST_FILES = 16 << 20, 100_000
#: Text that is cut at once in a task, bytes; a longer text alone.
AT_ONCE = 4 << 20
#: Rows (item, term) of a block of items, which is broadcast; terms that restrict an index while it is built. More: more blocks, an index of all terms.
PAIRS, TERMS = 65_536, 200_000


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of about AT_ONCE bytes."""
    at, size = 0, 0
    for i, n in enumerate(sizes):
        if i > at and size + n > AT_ONCE:
            yield at, i - at
            at, size = i, 0
        size += n
    if sizes:
        yield at, len(sizes) - at


def _counter(wanted):
    """Batches of (uid, id, text) to rows (uid, id, n, term, tf), and for each text a row of null term whose tf is n."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        only = None if wanted is None else pa.array(wanted.value, pa.large_string())
        for batch in batches:
            texts = pc.fill_null(pc.cast(batch.column(2), pa.large_string()), "")
            for start, length in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist()):
                cut = pc.split_pattern_regex(pc.ascii_lower(texts.slice(start, length)), NOT_TERM)
                doc = np.repeat(np.arange(length), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
                flat = cut.flatten()
                some = pc.greater(pc.binary_length(flat), 0)
                doc, flat = doc[some.to_numpy(zero_copy_only=False)], flat.filter(some).dictionary_encode()
                n = np.bincount(doc, minlength=length).astype(np.int64)
                codes, names = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
                if only is not None:
                    known = pc.is_valid(pc.index_in(names, value_set=only)).to_numpy(zero_copy_only=False)[codes]
                    doc, codes = doc[known], codes[known]
                cell, tf = np.unique(doc * max(len(names), 1) + codes, return_counts=True)
                doc, codes = np.divmod(cell, max(len(names), 1))
                row = pa.array(np.concatenate([np.arange(length), doc]) + start)
                term = pa.concat_arrays([pa.nulls(length, pa.string()), names.take(pa.array(codes)).cast(pa.string())])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(n[np.concatenate([np.arange(length), doc])]), term, pa.array(np.concatenate([n, tf.astype(np.int64)]))], names=["uid", "id", "n", "term", "tf"])

    return run


def term_counts(rows: DataFrame, wanted=None) -> DataFrame:
    """(uid, id, n, term, tf, bucket) of rows (uid, id, text): a row a text and term, and one a text of null term and bucket DOCUMENT."""
    schema = T.StructType([rows.schema["uid"], rows.schema["id"], *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("term", T.StringType()), ("tf", T.LongType()))]])
    return rows.mapInArrow(_counter(wanted), schema).withColumn("bucket", F.when(F.col("term").isNull(), F.lit(DOCUMENT)).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")))


class Index:
    """Postings of documents as a table bucketed by document; `documents` and `terms` count those that have terms."""

    def __init__(self, spark: SparkSession, docs: DataFrame, terms: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text"):
        """`terms`: index only these (all, if None); counts and lengths are of all terms in any case."""
        self.spark = spark
        self.scratch = Scratch(spark, "lexical")
        self.files = min(MOST_FILES, partitions_for(docs, BYTES))
        rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        found = term_counts(rows, None if terms is None else spark.sparkContext.broadcast(sorted(terms)))
        self.name = f"lexical_{uuid.uuid4().hex[:12]}"
        dealt = found.repartition(self.files, "uid").sortWithinPartitions("bucket", "term")
        dealt.write.bucketBy(self.files, "uid").sortBy("bucket", "term").option("path", self.scratch.folder("postings")).option("compression", "zstd").saveAsTable(self.name)
        counts = spark.table(self.name).where(F.col("bucket") == DOCUMENT).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.documents, self.terms = counts

    def postings(self) -> DataFrame:
        return self.spark.table(self.name).where(F.col("bucket") != DOCUMENT)

    def frequencies(self) -> DataFrame:
        """(bucket, term, df)"""
        return self.postings().groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))

    def impacts(self) -> DataFrame:
        """(uid, id, bucket, term, impact): what a match counts, before the term's weight."""
        m = F.expr(f"10 + (90L * n * {self.documents}L) div {max(self.terms, 1)}L")
        return self.postings().withColumn("m", m).select("uid", "id", "bucket", "term", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("impact"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.scratch.drop()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, bucket, term), once each."""
    rows = items.select(F.lit(0).cast("long").alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return term_counts(rows).where("term is not null").select(F.col("id").alias("item_id"), "bucket", "term").distinct()


def weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2 * df + 1).cast("double"))).cast("long")


def best(scores: DataFrame, k: int, groups: int) -> DataFrame:
    """(item_id, rank, id, score): each item's k best. A task hands on k rows of an item, then a group of tasks does, so the last step of an item stays small."""
    order = [F.desc("score"), F.asc("id"), F.asc("uid")]
    some = scores.withColumn("__g", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "__g").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "id", "score")


def search(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, id, score) of item_terms; written to the shared folder, so the index may go."""
    out = Scratch(index.spark, "ranked")
    weighted = terms.join(index.frequencies(), ["bucket", "term"]).withColumn("w", weight(F.col("df"), index.documents)).where("w > 0").drop("df")
    weighted = out.save(weighted, "terms")
    blocks = max(1, -(-weighted.count() // PAIRS))
    found = []
    for b in range(blocks):
        block = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        buckets = [r[0] for r in block.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        matches = index.impacts().where(F.col("bucket").isin(buckets)).join(F.broadcast(block), ["bucket", "term"])
        scores = matches.groupBy("uid", "id", "item_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score")).where("score > 0")
        found.append(out.save(best(scores, k, 1 + index.files // 256), "best"))
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    return ranked


def rank_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, id, score): the k documents that score highest for each item."""
    terms = Scratch(spark, "items").save(item_terms(items, item_col, item_text_col), "terms")
    distinct = terms.select("term").distinct()
    few = distinct.count() <= TERMS
    index = Index(spark, docs, [r[0] for r in distinct.collect()] if few else None, id_col, text_col)  # at most TERMS words
    try:
        return search(index, terms, k)
    finally:
        index.drop()


def oracle(k: int = 10) -> str:
    def terms(text: str) -> str:
        return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

    return f"""
    WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {terms("coalesce(text, '')")} AS ts FROM documents),
    s AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
    p AS (SELECT uid, doc_id, n, term, count(*) AS tf FROM (SELECT uid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, unnest({terms("coalesce(text, '')")}) AS term FROM benchmark),
    f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
    m AS (SELECT item_id, uid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
          FROM p JOIN q USING (term) JOIN f USING (term), s GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, uid)::INT AS rank, doc_id, score FROM m WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, uid) <= {k}
    """
