"""Line deduplication by a suffix array over lines, in DataFrame operations only.

Lines that have words get ids (two 64-bit hashes of their text), and every document is a sequence of ids. A line that occurs once
is in no repeated run, so sequences are cut there, and only pieces with `min_words` words go on. Prefix doubling ranks their
suffixes: names of one line are ranked by a range sort of the distinct ids, names of 2h lines by one of the distinct pairs of the rank
at a position and the rank h lines on. So ranks of a level are the order of the suffixes by that many lines, over all documents;
positions of equal rank are an interval of the suffix array with a longest common prefix of that many lines or more. A name that
only one suffix has gets no rank: its common prefix with both neighbours is shorter.

A run counts if it has `min_words` words. As every line has a word, the shortest counting run from a position, and the shortest up
to it, have at most `min_words` lines: doubling ends at the longest of them, as order by further lines would split intervals that count
already. The interval of a run of n lines is that of the ranks of its first and its last 2**k lines, 2**k <= n < 2**(k + 1). A maximal
repeated run is the union of the shortest counting runs inside it; in each interval the first in order of (doc_id, text, line)
stays, and the lines of all later ones are deleted.

Names are counted where they lie before they move, so a hot line or passage is a single row of the sort. Ranks come back to
positions by a join in which names of more than a part in `HOT` of all positions are broadcast, of which there are fewer than `HOT`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Names that more than one in so many positions have are joined by broadcast.
HOT = 1000


def line_ids(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """doc, own (hash of its text), i (number among lines with words), p (line number from 0), w (words), a, b (id), of documents with min_words words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("own"), F.split(text, "\n", -1).alias("lines"))
    cells = F.transform("lines", lambda x, i: F.struct(i.alias("p"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("w"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    rows = rows.select("doc", "own", F.filter(cells, lambda x: x["w"] > 0).alias("cells"))
    rows = rows.where(F.expr("aggregate(cells, 0L, (s, x) -> s + x.w)") >= min_words)
    return rows.select("doc", "own", F.posexplode("cells").alias("i", "c")).select("doc", "own", "i", "c.*")


def counted(rows: DataFrame, by: list[str], *more) -> DataFrame:
    """The names that more than one row has: by, n, and what else is asked for."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *more).where("n > 1")


def with_names(rows: DataFrame, names: DataFrame, by: list[str], total: int, value: str, how: str = "left") -> DataFrame:
    """rows with the column `value` of the name that they have (null, or left out, without one); no task takes all rows of a hot name.

    Rows without a name, or with one that is broadcast, are spread by a salt.
    """
    many = F.col("n") * HOT > total
    hot = F.broadcast(names.where(many).select(*by, F.col(value).alias("__hot")))  # fewer than HOT rows, as counts add up to the total at most
    rest = names.where(~many).select(*[F.col(c).alias(f"__{c}") for c in by], F.lit(0).alias("__salt"), F.col(value).alias("__rest"))
    rows = rows.join(hot, by, "left")
    open_ = F.col("__hot").isNull() & F.expr(" and ".join(f"{c} is not null" for c in by))
    rows = rows.withColumn("__spread", F.when(open_, 0).otherwise(F.pmod(F.xxhash64("doc", "own", "at"), F.lit(1 << 30)).cast("int") + 1))
    match = (F.col("__spread") == F.col("__salt")) & F.expr(" and ".join(f"{c} = __{c}" for c in by))
    rows = rows.join(rest, match, "left").withColumn(value, F.coalesce("__hot", "__rest")).drop("__hot", "__rest", "__spread", "__salt", *[f"__{c}" for c in by])
    return rows if how == "left" else rows.where(F.col(value).isNotNull())


def ranked(scratch: Scratch, names: DataFrame, by: list[str]) -> DataFrame:
    """Names with their rank: whole numbers in the order of the names, with gaps."""
    ordered = names.repartitionByRange(shuffle_partitions(names.sparkSession), *by).sortWithinPartitions(*by)
    return scratch.save(ordered.withColumn("rank", F.monotonically_increasing_id()), "names")


def suffix_ranks(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, int]:
    """(positions, levels): doc, own, piece, at, p, from_n, upto_n, r0 ... of the positions that may be in a repeated run.

    r{k} is the rank of the suffix by its first 2**k lines, null if no other has the same. from_n and upto_n are the lines of the shortest
    counting run from the position and up to it, null where the piece has none.
    """
    lines = scratch.save(line_ids(docs, id_col, text_col, min_words).withColumnRenamed("i", "at"), "lines")
    names = ranked(scratch, counted(lines, ["a", "b"]), ["a", "b"])
    rows = with_names(lines, names, ["a", "b"], lines.count(), "rank", "inner")
    # rows equal in id and text are one document
    rows = rows.groupBy("doc", "own", "at").agg(F.first("p").alias("p"), F.first("w").alias("w"), F.first("rank").alias("r0"))
    rows = rows.withColumn("piece", F.col("at") - F.row_number().over(Window.partitionBy("doc", "own").orderBy("at")))
    piece = Window.partitionBy("doc", "own", "piece")
    upto = F.sum("w").over(piece.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("w"))
    # lines that begin less than min_words words after this one, or end less than that before its end
    on, back = piece.orderBy("before").rangeBetween(0, min_words - 1), piece.orderBy("upto").rangeBetween(1 - min_words, 0)
    rows = rows.withColumn("from_n", F.when(F.max("upto").over(on) - F.col("before") >= min_words, F.count(F.lit(1)).over(on)))
    rows = rows.withColumn("upto_n", F.when(F.col("upto") - F.min("before").over(back) >= min_words, F.count(F.lit(1)).over(back)))
    rows = rows.withColumn("longest", F.max("from_n").over(piece)).where("longest is not null")  # pieces with min_words words
    rows = scratch.save(rows.select("doc", "own", "piece", "at", "p", "from_n", "upto_n", "r0"), "positions")
    total, longest = rows.agg(F.count(F.lit(1)), F.greatest(F.max("from_n"), F.max("upto_n"))).first()
    levels = (longest or 1).bit_length() - 1
    for k in range(levels):
        pairs = rows.withColumn("x", F.col(f"r{k}")).withColumn("y", F.lead(f"r{k}", 1 << k).over(piece.orderBy("at")))
        pairs = scratch.save(pairs.withColumn("x", F.when(F.col("y").isNotNull(), F.col("x"))), "pairs")
        names = ranked(scratch, counted(pairs.where("x is not null and y is not null"), ["x", "y"]), ["x", "y"])
        before, rows = rows, scratch.save(with_names(pairs, names, ["x", "y"], total, "rank").withColumnRenamed("rank", f"r{k + 1}").drop("x", "y"), "positions")
        scratch.drop(before)
        scratch.drop(pairs)
    return rows, levels


def counting_runs(positions: DataFrame, levels: int) -> DataFrame:
    """doc, own, at, first, last (line numbers from 0), n (lines), x, y: the shortest counting runs that may repeat, and the ranks that name their interval."""
    ranks = F.array(*[f"r{k}" for k in range(levels + 1)])
    cells = positions.groupBy("doc", "own", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "p", "from_n", "upto_n", ranks.alias("r")))).alias("cells"))

    def runs(field, start):
        def run(c, j):
            n = c[field].cast("int")
            begin = start(j, n)
            k = F.length(F.bin(n.cast("long"))) - 1
            first, last = F.get(F.col("cells"), begin), F.get(F.col("cells"), begin + n - 1)
            tail = F.get(F.col("cells"), begin + n - F.pow(F.lit(2), k).cast("int"))
            return F.when(n.isNotNull(), F.struct(first["at"].alias("at"), first["p"].alias("first"), last["p"].alias("last"), n.alias("n"), F.get(first["r"], k).alias("x"), F.get(tail["r"], k).alias("y")))

        return F.transform("cells", run)

    both = F.array_distinct(F.concat(runs("from_n", lambda j, n: j), runs("upto_n", lambda j, n: j - n + 1)))
    return cells.select("doc", "own", F.explode(F.filter(both, lambda r: r["x"].isNotNull() & r["y"].isNotNull())).alias("r")).select("doc", "own", "r.*")


def deleted_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc, own, spans: the line intervals [first, last] to delete of each document that has any, apart and in order."""
    scratch = Scratch(spark, "lines")
    runs = scratch.save(counting_runs(*suffix_ranks(scratch, docs, id_col, text_col, min_words)), "runs")
    place = F.struct(F.col("doc"), F.col("own"), F.col("first"))
    by = ["n_lines", "x", "y"]
    runs = runs.withColumnRenamed("n", "n_lines")
    # one row an interval: equal runs are counted where they lie before anything moves
    firsts = scratch.save(counted(runs, by, F.min(place).alias("start")), "firsts")
    later = with_names(runs, firsts, by, runs.count(), "start", "inner").where(place > F.col("start")).select("doc", "own", "first", "last").distinct()
    order = Window.partitionBy("doc", "own").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc", "own", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return spans.groupBy("doc", "own").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs taken out of the text, and the columns n_lines and n_deleted.

    Lines without words take no part in a run; those between the first and last line of a deleted run go with
    it. Null text counts as empty and stays null. Rows equal in id and text count as one document, so they
    don't delete each other. Null ids come first. A text of which every line goes becomes empty.
    Other columns go through; n_lines and n_deleted are replaced if there.
    """
    spans = deleted_lines(spark, docs, id_col, text_col, min_words).select(F.col("doc").alias("__doc"), F.col("own").alias("__own"), F.col("spans").alias("__spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    rows = docs.select(*kept).withColumn("__text_hash", F.xxhash64(text))
    rows = rows.join(spans, (F.col(id_col).eqNullSafe(F.col("__doc"))) & (F.col("__text_hash") == F.col("__own")), "left")
    rows = rows.withColumn("__lines", F.split(text, "\n", -1))
    n = F.size("__lines")
    gone = F.expr("coalesce(aggregate(__spans, 0, (s, x) -> s + x.last - x.first + 1), 0)")
    # what lies before, between and after the deleted intervals
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("__spans")),
        lambda j: F.slice(
            F.col("__lines"),
            F.when(j == 0, F.lit(1)).otherwise(F.get(F.col("__spans"), F.greatest(j - 1, F.lit(0)))["last"] + 2),
            F.greatest(
                F.lit(0),
                F.coalesce(F.get(F.col("__spans"), j)["first"], n) - F.when(j == 0, F.lit(0)).otherwise(F.get(F.col("__spans"), F.greatest(j - 1, F.lit(0)))["last"] + 1),
            ),
        ),
    )
    cleaned = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return rows.select(*[cleaned.alias(text_col) if c == text_col else F.col(c) for c in kept], n.alias("n_lines"), gone.alias("n_deleted"))


def oracle(min_words: int = MIN_WORDS) -> str:
    """The same in SQL, run by run, over documents."""
    return f"""
    WITH l AS (
      SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
      FROM documents),
    w AS (
      SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
    s AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k,
             sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
      FROM w WHERE words > 0),
    pairs AS (
      SELECT a.doc_id, a.k AS k1, b.k AS k2, a.pos AS first, b.pos AS last, b.upto - a.upto + a.words AS n, a.words AS w1, b.words AS w2
      FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + {min_words - 1}),
    runs AS (
      SELECT *, (n - w2 < {min_words}) AS shortest_from, (n - w1 < {min_words}) AS shortest_upto
      FROM pairs WHERE n >= {min_words} AND (n - w2 < {min_words} OR n - w1 < {min_words})),
    named AS (
      SELECT r.doc_id, r.first, r.last, string_agg(s.line, chr(10) ORDER BY s.k) AS content
      FROM runs r JOIN s ON s.doc_id = r.doc_id AND s.k BETWEEN r.k1 AND r.k2
      GROUP BY r.doc_id, r.first, r.last),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS r FROM named),
    gone AS (
      SELECT DISTINCT l.doc_id, l.pos FROM l JOIN ranked q ON q.doc_id = l.doc_id AND l.pos BETWEEN q.first AND q.last AND q.r > 1)
    SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS text
    FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos
    GROUP BY l.doc_id
    """
