"""Joinable columns between tables: by name, description, values and time; what to recommend, and a plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import name_column, normalize_name, numeric_clean, set_jaccard, tokens
from .joins import asof_join
from .matching import embedded, embedding_pairs

# Tolerances tried for a time alignment, seconds.
TOLERANCES = (1, 5, 10, 30, 60, 120, 300, 600, 1800, 3600)
# Normalised names of configuration columns.
CONFIG_KEYS = ("n", "c", "cpu_limit", "ram_limit", "ram_limit_mb", "cpu_limit_mb")
# Joinable roles, first to last.
ROLES = ("temporal_key", "exact_key", "config_key")


def _least(c: Column, n: int) -> Column:
    """The n smallest of several minima by a value's hash: as many distinct values, or fewer where hashes meet."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.min(F.when(F.pmod(F.xxhash64(c), F.lit(n)) == i, c)) for i in range(n)]), lambda x: x.isNotNull())))


def column_profiles(df: DataFrame, table: str, descriptions: dict[str, str] | None = None, approximate: bool = True) -> DataFrame:
    """table, column, name, dtype, non_null_ratio, unique_ratio (of approximate counts unless said), samples (up to five values), description; one pass."""
    descriptions = descriptions or {}
    n = F.count(F.lit(1))
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    per = {c: (F.coalesce(F.try_divide(F.count(F.col(c)), n), F.lit(0.0)), F.least(F.lit(1.0), F.coalesce(F.try_divide(distinct(F.col(c)), n), F.lit(0.0))), _least(F.col(c).cast("string"), 5)) for c in df.columns}
    flat = df.agg(*[m.alias(f"m{j}_{i}") for i, ms in enumerate(per.values()) for j, m in enumerate(ms)])
    rows = [
        F.struct(
            F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(normalize_name(c)).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col(f"m0_{i}").alias("non_null_ratio"), F.col(f"m1_{i}").alias("unique_ratio"), F.col(f"m2_{i}").alias("samples"), F.lit(descriptions.get(c, "")).alias("description"),
        )
        for i, c in enumerate(df.columns)
    ]
    return flat.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def column_values(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """(table, column, value): each column's distinct values as text, numbers rounded to six places.

    A text column of which more than four fifths read as numbers is one of numbers (told by one aggregate), and its other values don't count.
    """
    texts = [c for c in columns or df.columns if df.schema[c].dataType.typeName() == "string"]
    shares = df.agg(*[F.try_divide(F.count(numeric_clean(F.col(c))), F.count(c)).alias(f"s{i}") for i, c in enumerate(texts)]).first() if texts else ()
    numbers = {c for c, share in zip(texts, shares, strict=True) if (share or 0) > 0.8}

    def text(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        x = F.col(c)
        if c in numbers:
            return F.round(numeric_clean(x), 6).cast("string")
        return F.round(x.cast("double"), 6).cast("string") if kind in ("byte", "short", "integer", "long", "float", "double", "decimal") else x.cast("string")

    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns or df.columns])
    return df.select(F.explode(cells).alias("c")).select(F.lit(table).alias("table"), "c.column", "c.value").where("value is not null").distinct()


def value_jaccard(values: DataFrame) -> DataFrame:
    """Every pair of columns of different tables that share a value: common, left_n, right_n and their Jaccard.

    Values are met by an equi-join on the value, whose rows are distinct by column; a value that c columns have makes c * c rows.
    """
    sizes = values.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"))
    a = values.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), "value")
    b = values.select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), "value")
    met = a.join(b, "value").where("left_table < right_table").groupBy("left_table", "left_column", "right_table", "right_column").agg(F.count(F.lit(1)).alias("common"))
    left = sizes.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), F.col("n").alias("left_n"))
    right = sizes.select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), F.col("n").alias("right_n"))
    out = met.join(left, ["left_table", "left_column"]).join(right, ["right_table", "right_column"])
    return out.withColumn("jaccard", F.col("common") / (F.col("left_n") + F.col("right_n") - F.col("common")))


def time_alignment(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """One row: match ratio for each tolerance of the grid, the recommended one (nearest to 0.9, the smaller of two), the median distance."""
    l, r = left.select(F.col(left_on).alias("t")).where("t is not null").distinct(), right.select(F.col(right_on).alias("t")).where("t is not null").distinct()
    if r.count() < l.count():
        l, r = r, l
    near = asof_join(l, r.withColumnRenamed("t", "u"), "t", "u", direction="nearest")
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if l.schema["t"].dataType.typeName().startswith(("timestamp", "date")) else F.col(c).cast("double")
    near = near.select(F.abs(sec("t") - sec("__right_u")).alias("d"))
    out = near.agg(*[F.coalesce(F.avg((F.col("d") <= g).cast("double")), F.lit(0.0)).alias(f"ratio_{g}") for g in TOLERANCES], F.median("d").alias("median_delta"))
    order = F.array(*[F.struct(F.round(F.abs(F.col(f"ratio_{g}") - 0.9), 9).alias("off"), F.lit(g).alias("g"), F.col(f"ratio_{g}").alias("ratio")) for g in TOLERANCES])
    best = F.array_min(order)
    return out.withColumns({"recommended": best["g"], "match_ratio": best["ratio"]})


def infer_relationships(profiles: DataFrame, overlap: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Every pair of columns of two tables with name, description and content similarity, role and confidence.

    profiles: column_profiles of all tables (a row a column); overlap: value_jaccard; times: left_table, right_table, recommended,
    match_ratio, median_delta of pairs of time columns. Pairs are as many as columns by columns, however long the tables.
    """
    cols = ["table", "column", "name", "unique_ratio", "description"]
    a = profiles.select(*[F.col(c).alias(f"left_{c}") for c in cols])
    b = profiles.select(*[F.col(c).alias(f"right_{c}") for c in cols])
    pairs = a.join(b, F.col("left_table") < F.col("right_table"))
    key = ["left_table", "left_column", "right_table", "right_column"]
    pairs = pairs.join(overlap.select(*key, "jaccard"), key, "left").withColumn("content", F.coalesce("jaccard", F.lit(0.0)))
    ln, rn = F.col("left_name"), F.col("right_name")
    is_time = (ln == "time") & (rn == "time")
    if times is not None:
        t = times.select("left_table", "right_table", "recommended", "match_ratio", "median_delta")
        pairs = pairs.join(t, ["left_table", "right_table"], "left").withColumn("content", F.when(is_time, F.coalesce("match_ratio", "content")).otherwise(F.col("content")))
    else:
        pairs = pairs.withColumns({"recommended": F.lit(None).cast("int"), "median_delta": F.lit(None).cast("double")})
    exact = (ln == rn).cast("double")
    partial = (F.contains(ln, rn) | F.contains(rn, ln)).cast("double")
    described = set_jaccard(tokens(F.col("left_description")), tokens(F.col("right_description")))
    uniques = (F.col("left_unique_ratio") + F.col("right_unique_ratio")) / 2
    role = (
        F.when(is_time, F.lit("temporal_key"))
        .when((ln == rn) & ln.isin(*CONFIG_KEYS), F.lit("config_key"))
        .when((ln == rn) & (F.col("content") >= 0.8) & (uniques >= 0.05), F.lit("exact_key"))
        .otherwise(F.lit("semantic_match"))
    )
    confidence = 0.45 * F.greatest(exact, 0.7 * partial) + 0.20 * described + 0.35 * F.col("content")
    return pairs.select(
        *key, F.when(is_time, F.lit("temporal_asof")).otherwise(F.lit("exact")).alias("relation_type"), role.alias("join_role"), F.round(confidence, 6).alias("confidence"), exact.alias("name_exact"),
        partial.alias("name_partial"), F.round(described, 6).alias("metadata_similarity"), F.round("content", 6).alias("content_similarity"),
        F.when(is_time, F.col("recommended")).alias("recommended_tolerance_seconds"), F.when(is_time, F.col("median_delta")).alias("median_nearest_delta"),
    )


def recommend(relationships: DataFrame, least: float = 0.7) -> DataFrame:
    """The best pair of each two tables, relation and role, of confidence `least` or more; roles in order, then confidence."""
    rank = F.when(F.col("join_role") == ROLES[0], 0).when(F.col("join_role") == ROLES[1], 1).otherwise(2)
    good = relationships.where((F.col("confidence") >= least) & F.col("join_role").isin(*ROLES)).withColumn("role_rank", rank)
    w = Window.partitionBy("left_table", "right_table", "relation_type", "join_role").orderBy(F.desc("confidence"), "left_column", "right_column")
    first = good.withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select(
        F.col("left_table").alias("pk_table"), F.col("left_column").alias("pk_column"), F.col("right_table").alias("fk_table"), F.col("right_column").alias("fk_column"),
        "relation_type", "join_role", "confidence", "recommended_tolerance_seconds", "role_rank",
    ).orderBy("role_rank", F.desc("confidence"), "pk_table", "fk_table")


def join_plan(recommended: DataFrame, base: str, temporal_least: float = 0.7) -> dict:
    """How to join a base table: as-of with the largest recommended tolerance (120 s if none), else on a configuration key."""
    rows = [r for r in recommended.where((F.col("pk_table") == base) | (F.col("fk_table") == base)).collect()]  # a row a pair of tables and role
    temporal = [r for r in rows if r.join_role == "temporal_key" and r.confidence >= temporal_least]
    other = lambda r: r.fk_table if r.pk_table == base else r.pk_table
    if temporal:
        tolerance = max((r.recommended_tolerance_seconds or 0 for r in temporal), default=0) or 120
        return {"mode": "asof", "join_key": "time", "tolerance_seconds": tolerance, "tables": sorted({other(r) for r in temporal})}
    config = [r for r in rows if r.join_role in ("config_key", "exact_key")]
    return {"mode": "exact" if config else "none", "join_key": config[0].pk_column if config else None, "tolerance_seconds": None, "tables": sorted({other(r) for r in config})}


def connections(recommended: DataFrame) -> DataFrame:
    """The four columns of a connections file."""
    return recommended.select("fk_table", "fk_column", "pk_table", "pk_column")


def hashed_ngrams(text: str, width: int = 256, n: int = 3) -> list[float]:
    """A unit vector of hashed character n-grams; the offline stand-in for a sentence encoder."""
    padded = f" {normalize_name(text)} "
    out = [0.0] * width
    for i in range(len(padded) - n + 1):
        out[crc32(padded[i : i + n].encode()) % width] += 1.0
    norm = sum(x * x for x in out) ** 0.5 or 1.0
    return [x / norm for x in out]


def schema_matches(
    spark: SparkSession, schemas: dict[str, dict[str, str]], overlap: DataFrame, descriptions: dict | None = None, encoder: Callable[[str], list[float]] = hashed_ngrams, schema_least: float = 0.6, value_least: float = 0.2,
    cells: int | None = None, both: bool = False,
) -> DataFrame:
    """Edges between columns by the cosine of their encoded names and descriptions and the overlap of their values.

    A pair needs the cosine. Columns of different type keep half of it. A pair of little overlap needs a cosine of 0.92; others have the
    mean of cosine and overlap, or half the cosine if nothing overlaps. Columns are encoded and compared in tasks; with `cells` only those that share one
    (see embedding_pairs). `both`: each pair in both directions.
    """
    descriptions = descriptions or {}
    rows = [(t, c, k, f"{c} {descriptions.get(t, {}).get(c, '')}") for t, cs in schemas.items() for c, k in cs.items()]
    columns = spark.createDataFrame(rows, "table string, column string, kind string, text string")
    pairs = embedding_pairs(embedded(columns, encoder), schema_least, cells)
    key = ["left_table", "left_column", "right_table", "right_column"]
    for side in ("left", "right"):
        pairs = pairs.join(columns.select(F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"), F.col("kind").alias(f"{side}_kind")), [f"{side}_table", f"{side}_column"])
    pairs = pairs.join(overlap.select(*key, "jaccard"), key, "left").withColumn("same", F.col("left_kind") == F.col("right_kind"))
    v = F.coalesce("jaccard", F.lit(0.0))
    score = F.when(~F.col("same") | (v <= 0), 0.5 * F.col("cosine")).otherwise(0.5 * F.col("cosine") + 0.5 * v)
    kept = pairs.where(~F.col("same") | (v >= value_least) | (F.col("cosine") >= 0.92))
    out = kept.select(*key, F.round(score, 6).alias("score"))
    return out.unionByName(out.select(F.col(key[2]).alias(key[0]), F.col(key[3]).alias(key[1]), F.col(key[0]).alias(key[2]), F.col(key[1]).alias(key[3]), "score")) if both else out


def bands_for(threshold: float, permutations: int, lost: float = 1e-3) -> int:
    """How many bands of equal length the min-hashes are cut into: the fewest that lose a pair at the threshold with a chance of at most `lost`."""
    for rows in range(permutations, 0, -1):
        if (1 - threshold**rows) ** (permutations // rows) <= lost:
            return permutations // rows
    return permutations


def minhash_edges(values: DataFrame, threshold: float = 0.5, permutations: int = 128, bands: int | None = None) -> DataFrame:
    """KEY and jaccard: pairs of columns of two tables whose exact Jaccard is `threshold` or more, candidates by min-hashes.

    One hash of a value is mixed with each seed; a column is `permutations` minima, whatever its length. Columns that agree in a band are candidates; of these
    the common values are counted, so an estimate decides nothing. A pair at the threshold is lost with a chance of at most 0.001 (see bands_for),
    pairs above it with a smaller one.
    """
    bands = bands or bands_for(threshold, permutations)
    rows = permutations // bands
    h = F.xxhash64("value")
    minima = values.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.xxhash64(h, F.lit(i))).alias(f"h{i}") for i in range(permutations)])
    signed = minima.select("table", "column", "n", F.array(*[F.col(f"h{i}") for i in range(permutations)]).alias("s"))
    keys = F.array(*[F.struct(F.lit(b).alias("b"), F.xxhash64(F.slice("s", b * rows + 1, rows)).alias("k")) for b in range(bands)])
    banded = signed.select("table", "column", "n", F.explode(keys).alias("band")).select("table", "column", "n", "band.b", "band.k")
    left = banded.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), F.col("n").alias("left_n"), "b", "k")
    right = banded.select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), F.col("n").alias("right_n"), "b", "k")
    key = ["left_table", "left_column", "right_table", "right_column"]
    met = left.join(right, ["b", "k"]).where("left_table < right_table").select(*key, "left_n", "right_n").distinct()
    # sizes alone rule some out
    met = met.where(F.least("left_n", "right_n") >= threshold * F.greatest("left_n", "right_n") - 1e-9)
    mine = met.join(values.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), "value"), ["left_table", "left_column"])
    common = mine.join(values.select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), "value"), ["right_table", "right_column", "value"])
    out = common.groupBy(*key, "left_n", "right_n").agg(F.count(F.lit(1)).alias("common"))
    return out.select(*key, (F.col("common") / (F.col("left_n") + F.col("right_n") - F.col("common"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def all_values(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [column_values(df, name) for name, df in tables.items()])


def report(relationships: DataFrame, recommended: DataFrame) -> str:
    """A short text: how many pairs there are of each role, and the recommended ones; a row a pair of tables and role reaches the driver."""
    counts = relationships.groupBy("join_role").count().orderBy("join_role").collect()
    lines = ["# Relationships", "", *[f"- {r.join_role}: {r['count']}" for r in counts], "", "# Recommended", ""]
    return "\n".join(lines + [f"- {r.pk_table}.{r.pk_column} = {r.fk_table}.{r.fk_column} ({r.join_role}, {r.confidence:.2f})" for r in recommended.collect()])


def normalized_names(names: DataFrame, column: str) -> DataFrame:
    return names.withColumn("name", name_column(F.col(column)))
