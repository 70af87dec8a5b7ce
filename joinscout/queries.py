"""Queries over the test tables, at least one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, session
from .functions import columns, policy, scalars
from .operators import augment, discovery, joins, lowrank, matching, models, neighbours, profile, residual, rollups, selection, stats, timeseries
from .plans import graph, ingest, paths, search
from .sources import lake as lakes
from .sources import registry, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df from the work folder, so that what reads it more than once doesn't make it again."""
    place = session.work_dir(spark, name)
    df.write.parquet(place)
    return spark.read.parquet(place)


def query(sql: str | None = None):
    """Register a query and its SQL under the function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
ITEM_FIRST = """first_item AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1)"""

# ---- joins ----


@query(f"""WITH {ITEM_FIRST} SELECT o_orderkey, o_totalprice, l_orderkey, l_partkey, l_quantity FROM orders LEFT JOIN first_item ON o_orderkey = l_orderkey""")
def exact_left_join_m1(spark, d):
    out = joins.exact_left_join(read(spark, d, "orders"), read(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ITEM_ORDER)
    return out.select("o_orderkey", "o_totalprice", "l_orderkey", "l_partkey", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, p_partkey, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def exact_left_join_fanout(spark, d):
    return joins.exact_left_join(read(spark, d, "lineitem"), read(spark, d, "part"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey", "p_brand")


@query("""SELECT o_orderkey, c_acctbal, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_chain_two_hops(spark, d):
    out = joins.exact_left_join(read(spark, d, "orders"), read(spark, d, "customer"), "o_custkey", "c_custkey", ["c_name"])
    out = joins.exact_left_join(out, read(spark, d, "nation"), "c_nationkey", "n_nationkey", ["n_name"])
    return joins.exact_left_join(out, read(spark, d, "region"), "n_regionkey", "r_regionkey", ["r_name"]).select("o_orderkey", "c_acctbal", "n_name", "r_name")


@query(f"""WITH {ITEM_FIRST} SELECT count(*) AS n_rows, count(l_orderkey) AS n_matched, round(count(l_orderkey) / count(*), 6) AS ratio FROM orders LEFT JOIN first_item ON o_orderkey = l_orderkey""")
def match_ratio(spark, d):
    joined = joins.exact_left_join(read(spark, d, "orders"), read(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ITEM_ORDER)
    return rounded(joins.match_ratio(joined, "l_orderkey"), "ratio")


@query(f"""WITH {ITEM_FIRST} SELECT 11 AS n_added, 0 AS n_all_null, round(1 - count(l_orderkey) / count(*), 6) AS mean_missing FROM orders LEFT JOIN first_item ON o_orderkey = l_orderkey""")
def join_diagnostics(spark, d):
    base = read(spark, d, "orders")
    joined = joins.exact_left_join(base, read(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ITEM_ORDER)
    return rounded(joins.join_diagnostics(base, joined), "mean_missing")


@query("""SELECT count(*) AS n_rows, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_found, round(count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) / count(*), 6) AS ratio FROM customer""")
def semi_join_ratio(spark, d):
    return rounded(joins.semi_ratio(read(spark, d, "customer"), read(spark, d, "orders"), "c_custkey", "o_custkey"), "ratio")


@query("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), b AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT a.l_partkey, a.l_suppkey, quantity FROM a LEFT JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def composite_key_join(spark, d):
    items = read(spark, d, "lineitem")
    right = items.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    return joins.left_join_on(items.select("l_partkey", "l_suppkey").distinct(), right, ["l_partkey", "l_suppkey"])


@query("""SELECT s_suppkey, s_name, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def direct_key_join(spark, d):
    nation = read(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return joins.direct_join(read(spark, d, "supplier"), nation, "s_nationkey", "s_nationkey").select("s_suppkey", "s_name", "s_nationkey", "n_name", "n_regionkey")


@query("""WITH a AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1), p AS (SELECT user_id AS k, max(value) AS top FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT user_id AS k, min(value) AS low FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT a.k, n, top AS purchases__top, low AS clicks__low FROM a LEFT JOIN p ON a.k IS NOT DISTINCT FROM p.k LEFT JOIN c ON a.k IS NOT DISTINCT FROM c.k""")
def fold_exact_joins(spark, d):
    e = read(spark, d, "events").withColumnRenamed("user_id", "k")
    tables = {"purchases": e.where("event_type = 'purchase'").groupBy("k").agg(F.max("value").alias("top")), "clicks": e.where("event_type = 'click'").groupBy("k").agg(F.min("value").alias("low"))}
    return joins.fold_joins(e.groupBy("k").agg(F.count(F.lit(1)).alias("n")), tables, "k")


def _asof(direction: str, by: bool, tolerance: int | None) -> str:
    key = "l.user_id = r.user_id AND " if by else ""
    cut = (lambda x: f"CASE WHEN abs(epoch_us(l.ts) - epoch_us({x}.ts)) <= {tolerance}000000 THEN {x}.event_id END") if tolerance is not None else (lambda x: f"{x}.event_id")
    base = "WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT * FROM events WHERE event_type = 'click')"
    if direction != "nearest":
        op = ">=" if direction == "backward" else "<="
        return f"{base} SELECT l.event_id, {cut('r')} AS click_id FROM l ASOF LEFT JOIN r ON {key}l.ts {op} r.ts"
    return f"""{base}, b AS (SELECT l.event_id, r.event_id AS bid, r.ts AS bts FROM l ASOF LEFT JOIN r ON {key}l.ts >= r.ts), f AS (SELECT l.event_id, r.event_id AS fid, r.ts AS fts FROM l ASOF LEFT JOIN r ON {key}l.ts <= r.ts),
    x AS (SELECT l.event_id, l.ts AS lts, CASE WHEN bid IS NULL THEN fid WHEN fid IS NULL OR l.ts - bts <= fts - l.ts THEN bid ELSE fid END AS cid FROM l JOIN b USING (event_id) JOIN f USING (event_id))
    SELECT x.event_id, {"CASE WHEN abs(epoch_us(lts) - epoch_us(r.ts)) <= " + str(tolerance) + "000000 THEN cid END" if tolerance is not None else "cid"} AS click_id FROM x LEFT JOIN r ON r.event_id = cid"""


def _asof_query(spark, d, direction, by, tolerance):
    e = read(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    right = e.where("event_type = 'click'").select("ts", "user_id", F.col("event_id").alias("click_id"))
    if not by:
        right = right.drop("user_id")
    out = joins.asof_join(left, right, "ts", "ts", by=["user_id"] if by else [], tolerance=tolerance, direction=direction, order="click_id")
    return out.select("event_id", "click_id")


@query(_asof("backward", True, 86400))
def asof_backward(spark, d):
    return _asof_query(spark, d, "backward", True, 86400)


@query(_asof("forward", True, 86400))
def asof_forward(spark, d):
    return _asof_query(spark, d, "forward", True, 86400)


@query(_asof("nearest", True, 43200))
def asof_nearest(spark, d):
    return _asof_query(spark, d, "nearest", True, 43200)


@query(_asof("nearest", False, None))
def asof_nearest_unlimited(spark, d):
    return _asof_query(spark, d, "nearest", False, None)


@query(_asof("backward", False, 60))
def asof_backward_no_entity(spark, d):
    return _asof_query(spark, d, "backward", False, 60)


# ---- graph and search ----

LINKS = [("orders", "customer", "o_custkey", "c_custkey", 1.0), ("customer", "nation", "c_nationkey", "n_nationkey", 1.0), ("nation", "region", "n_regionkey", "r_regionkey", 1.0), ("lineitem", "orders", "l_orderkey", "o_orderkey", 1.0), ("lineitem", "part", "l_partkey", "p_partkey", 0.9), ("supplier", "nation", "s_nationkey", "n_nationkey", 0.8)]
MORE = [("orders", "customer", "o_custkey", "c_custkey", 0.4), ("supplier", "nation", "s_nationkey", "n_nationkey", 0.95), ("part", "supplier", "p_size", "s_nationkey", 0.3)]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + ") AS g(from_id, to_id, from_column, to_column, weight)"


UNDIRECTED = f"u AS (SELECT from_id, to_id, weight FROM {_values(LINKS)} UNION ALL SELECT to_id, from_id, weight FROM {_values(LINKS)})"


def lake(spark: SparkSession, d: str) -> search.Lake:
    names = ("orders", "customer", "nation", "region")
    return search.Lake({n: read(spark, d, n) for n in names}, graph.edges(spark, [e for e in LINKS if e[0] in names and e[1] in names]), {"customer": ["c_name"], "nation": ["n_name"], "region": ["r_name"]})


@query("""SELECT o_totalprice, o_orderkey AS orders__o_orderkey, c_acctbal AS customer__c_acctbal, n_name AS nation__n_name, r_name AS region__r_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_all_breadth_first(spark, d):
    out, _ = search.join_all(lake(spark, d), "orders", search.Settings("o_totalprice"))
    return out.select("o_totalprice", "orders__o_orderkey", "customer__c_acctbal", "nation__n_name", "region__r_name")


@query("""SELECT o_totalprice, o_orderkey AS orders__o_orderkey, c_acctbal AS customer__c_acctbal, r_regionkey AS region__r_regionkey
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_all_depth_first(spark, d):
    out, _ = search.join_all(lake(spark, d), "orders", search.Settings("o_totalprice"), depth_first=True)
    return out.select("o_totalprice", "orders__o_orderkey", "customer__c_acctbal", "region__r_regionkey")


PATH = "orders--orders|o_custkey|c_custkey|customer--customer|c_nationkey|n_nationkey|nation--nation|n_regionkey|r_regionkey|region"


@query("""SELECT o_totalprice, o_orderkey AS orders__o_orderkey, n_name AS nation__n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def materialise_path(spark, d):
    return search.materialise(lake(spark, d), PATH, ["orders__o_orderkey", "nation__n_name"], search.Settings("o_totalprice"))


@query("""SELECT o_totalprice, c_custkey AS customer__c_custkey, r_name AS region__r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def replay_path(spark, d):
    return search.replay(lake(spark, d), PATH, search.Settings("o_totalprice")).select("o_totalprice", "customer__c_custkey", "region__r_name")


@query()
def search_paths(spark, d):
    found = search.search(lake(spark, d), "orders", search.Settings("o_totalprice", parity=False))
    return spark.createDataFrame([(p, float(r), paths.length(p), len(found.features.get(p, []))) for p, r in found.ranking.items()], "path string, rank double, length int, n_features int")


# ---- statistics and selection ----

ORDER_CHAIN = "chain AS (SELECT o_totalprice AS y, c_acctbal, c_nationkey::DOUBLE AS c_nationkey, o_custkey::DOUBLE AS o_custkey, o_orderkey::DOUBLE AS o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"
CHAIN = ["c_acctbal", "c_nationkey", "o_custkey", "o_orderkey"]
UNPIVOT = "p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, y FROM chain WHERE {c} IS NOT NULL AND y IS NOT NULL" for c in CHAIN) + ")"
RANKS = "r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM p)"


def chain(spark, d):
    out = joins.exact_left_join(read(spark, d, "orders"), read(spark, d, "customer"), "o_custkey", "c_custkey", ["c_name"])
    return out.withColumnRenamed("o_totalprice", "y").select("y", *[F.col(c).cast("double").alias(c) for c in CHAIN])


@query(f"WITH {ORDER_CHAIN}, {UNPIVOT} SELECT feature, round(corr(x, y), 6) AS correlation, count(*) AS n FROM p GROUP BY 1")
def pearson_correlation(spark, d):
    return rounded(stats.pearson(chain(spark, d), CHAIN, "y"), "correlation")


@query(f"WITH {ORDER_CHAIN}, {UNPIVOT}, {RANKS} SELECT feature, round(corr(rx, ry), 6) AS correlation, count(*) AS n FROM r GROUP BY 1")
def spearman_correlation(spark, d):
    return rounded(stats.spearman(chain(spark, d), CHAIN, "y"), "correlation").withColumn("n", F.col("n").cast("long"))


SCORED = "s AS (SELECT feature, round(abs(corr(rx, ry)), 6) AS score FROM r GROUP BY 1)"


@query(f"WITH {ORDER_CHAIN}, {UNPIVOT}, {RANKS}, {SCORED} SELECT * FROM s WHERE score > 0 AND score < 1")
def join_chain_relevance(spark, d):
    return rounded(stats.relevance(chain(spark, d), CHAIN, "y"), "score")


@query(f"WITH {ORDER_CHAIN}, {UNPIVOT} SELECT feature, round(abs(corr(x, y)), 6) AS score FROM p GROUP BY 1 HAVING abs(corr(x, y)) > 0 AND abs(corr(x, y)) < 1")
def pearson_relevance(spark, d):
    return rounded(stats.relevance(chain(spark, d), CHAIN, "y", "pearson"), "score")


@query(f"WITH {ORDER_CHAIN}, {UNPIVOT}, {RANKS}, {SCORED} SELECT * FROM s ORDER BY score DESC, feature LIMIT 2")
def spearman_top_half(spark, d):
    return rounded(stats.top_half(chain(spark, d), CHAIN, "y"), "score")


ITEM = "i AS (SELECT l_quantity, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber, (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem)"
ITEMS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _bin(c: str) -> str:
    return f"coalesce(least(floor(({c} - (min({c}) OVER ())) * 5 / nullif((max({c}) OVER ()) - (min({c}) OVER ()), 0)), 4), 0)::INT AS {c}"


BINNED = f"b AS (SELECT {', '.join(map(_bin, ITEMS))}, y FROM i)"


def _entropy(name: str, keys: str, source: str = "q") -> str:
    return f"{name} AS (SELECT feature, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT feature, {keys}, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY 1)"


def _pairs(columns: list[str], y: str, source: str, name: str = "q") -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, {y}::DOUBLE AS y FROM {source}" for c in columns) + ")"


def items(spark, d):
    return read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"), (F.col("l_returnflag") == "R").cast("double").alias("y"))


@query(f"WITH {ITEM}, {BINNED} SELECT *, count(*) AS n FROM b GROUP BY ALL")
def bin_uniform5(spark, d):
    return stats.bin_uniform(items(spark, d), ITEMS).groupBy(*ITEMS, "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ITEM}, {_pairs(ITEMS, 'y', 'i')}, {_entropy('hxy', 'x, y')}, {_entropy('hx', 'x')}, {_entropy('hy', 'y')} SELECT feature, round(hy.h, 6) AS h_target, round(hxy.h - hx.h, 6) AS h_conditional, round(hx.h + hy.h - hxy.h, 6) AS mi FROM hxy JOIN hx USING (feature) JOIN hy USING (feature)")
def mutual_information(spark, d):
    return rounded(stats.mutual_information(items(spark, d), ITEMS, "y"), "h_target", "h_conditional", "mi")


TRIPLES = "q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, l_linenumber::DOUBLE AS y, y::DOUBLE AS z FROM i" for c in ITEMS[:3]) + ")"


@query(f"WITH {ITEM}, {TRIPLES}, {_entropy('a', 'x, z')}, {_entropy('b', 'y, z')}, {_entropy('c', 'x, y, z')}, {_entropy('e', 'z')} SELECT feature, round(a.h + b.h - c.h - e.h, 6) AS cmi FROM a JOIN b USING (feature) JOIN c USING (feature) JOIN e USING (feature)")
def conditional_mutual_information(spark, d):
    return rounded(stats.conditional_mutual_information(items(spark, d), ITEMS[:3], "l_linenumber", "y"), "cmi")


_MI = lambda s: f"{_entropy(f'{s}xy', 'x, y', s)}, {_entropy(f'{s}x', 'x', s)}, {_entropy(f'{s}y', 'y', s)}, {s}mi AS (SELECT feature, {s}x.h + {s}y.h - {s}xy.h AS mi FROM {s}xy JOIN {s}x USING (feature) JOIN {s}y USING (feature))"


@query(f"WITH {ITEM}, {BINNED}, {_pairs(ITEMS[1:], 'y', 'b', 't')}, {_pairs(ITEMS[1:], 'l_quantity', 'b', 's')}, {_MI('t')}, {_MI('s')} SELECT feature, round(tmi.mi - smi.mi, 6) AS score FROM tmi JOIN smi USING (feature)")
def mrmr_scores(spark, d):
    out = stats.redundancy(items(spark, d), ["l_quantity"], ITEMS[1:], "y", parity=False)
    return rounded(out.select("feature", "score"), "score")


SCORES = f"""WITH {ORDER_CHAIN}, {UNPIVOT}, {RANKS}, {SCORED}, m AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, 1 - count({c}) / count(*) AS missing FROM chain" for c in CHAIN)})
SELECT feature, round(score, 6) AS utility, 0 AS pattern_risk, 0 AS identifier_risk, (score >= 0.999)::INT AS proxy_risk, (score >= 0.999)::INT AS privacy_risk, round(missing, 6) AS missing_ratio, round(score - 0.25 * (score >= 0.999)::INT - 0.1 * missing - 0.001, 6) AS score_plus FROM s JOIN m USING (feature)"""


@query(SCORES)
def feature_scores(spark, d):
    return rounded(selection.score_features(chain(spark, d), "y", approximate=False), "utility", "missing_ratio", "score_plus")


@query(f"SELECT feature, score_plus FROM ({SCORES}) ORDER BY score_plus DESC, utility DESC, feature LIMIT 3")
def score_plus_topk(spark, d):
    scores = selection.score_features(chain(spark, d), "y")
    return rounded(selection.chosen(scores, 3).select("feature", "score_plus"), "score_plus")


# ---- profiles and discovery ----


def _describe(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS n_null, count(DISTINCT {c}) <= 1 AS is_constant, round(count(DISTINCT {c}) / count(*), 6) AS cardinality_ratio FROM {table}" for c in columns)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(_describe("orders", ORDER_COLUMNS))
def describe_columns(spark, d):
    return rounded(profile.describe(read(spark, d, "orders"), approximate=False), "cardinality_ratio")


@query(f"SELECT \"column\", cardinality_ratio FROM ({_describe('orders', ORDER_COLUMNS)}) WHERE NOT is_constant ORDER BY 2, 1 LIMIT 3")
def candidate_join_keys(spark, d):
    return rounded(profile.candidate_join_keys(read(spark, d, "orders"), 3, approximate=False), "cardinality_ratio")


def _profile(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.95), 4) AS p95, round(quantile_cont({c}, 0.99), 4) AS p99, max({c})::DOUBLE AS max, round(1 - count({c}) / count(*), 6) AS missing_ratio FROM {table}" for c in columns)


@query(_profile("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def profile_stats(spark, d):
    out = profile.numeric_profile(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], exact=True)
    return rounded(rounded(out, "mean", "std", "p50", "p95", "p99", places=4), "missing_ratio")


@query("SELECT user_id, count(*) AS n_rows, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last, count(*) - count(ts) AS n_unparsed, count(DISTINCT ts) = count(ts) AS is_unique FROM events GROUP BY 1")
def quality_summary(spark, d):
    return profile.quality_summary(read(spark, d, "events"), "ts", ["user_id"])


@query("SELECT user_id, coalesce(max((value < before)::INT), 0) = 0 AS is_monotonic FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY 1")
def monotonic_check(spark, d):
    return profile.is_monotonic(read(spark, d, "events"), "value", ["event_id"], ["user_id"])


@query("""SELECT 'row_count' AS "check", '' AS "column", count(*) >= 1 AS passed FROM events UNION ALL SELECT 'exists', 'ts', true UNION ALL SELECT 'exists', 'nope', false UNION ALL SELECT 'not_null', 'value', count(value) = count(*) FROM events
UNION ALL SELECT 'unique', 'event_id', count(DISTINCT event_id) = count(event_id) FROM events UNION ALL SELECT 'unique', 'user_id', count(DISTINCT user_id) = count(user_id) FROM events UNION ALL SELECT 'no_all_null', '', true""")
def expectation_checks(spark, d):
    return profile.expectations(read(spark, d, "events"), ["ts", "nope"], ["value"], ["event_id", "user_id"])


@query("""SELECT 'props' AS "column", round(avg((TRY_CAST(regexp_replace(props, '[^0-9eE+\\-.]', '', 'g') AS DOUBLE) IS NOT NULL)::INT), 6) AS parsed FROM events UNION ALL SELECT 'event_type', round(avg((TRY_CAST(regexp_replace(event_type, '[^0-9eE+\\-.]', '', 'g') AS DOUBLE) IS NOT NULL)::INT), 6) FROM events""")
def parse_ratios(spark, d):
    return rounded(profile.parse_ratios(read(spark, d, "events"), ["props", "event_type"]), "parsed")


def _num(c: str) -> str:
    return f"round({c}::DOUBLE, 6)"


VALUE_COLUMNS = [("customer", "c_custkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey"), ("orders", "o_custkey"), ("supplier", "s_nationkey"), ("supplier", "s_suppkey")]
VALUES = "v AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {_num(c)} AS x FROM {t} WHERE {c} IS NOT NULL" for t, c in VALUE_COLUMNS) + ")"
OVERLAP = f"{VALUES}, z AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL), o AS (SELECT a.t AS left_table, a.c AS left_column, b.t AS right_table, b.c AS right_column, count(*) AS common FROM v a JOIN v b ON a.x = b.x AND a.t < b.t GROUP BY ALL)"


def _columns(spark, d) -> dict[str, DataFrame]:
    out: dict[str, list[str]] = {}
    for t, c in VALUE_COLUMNS:
        out.setdefault(t, []).append(c)
    return {t: read(spark, d, t).select(*cs) for t, cs in out.items()}


@query(f"WITH {OVERLAP} SELECT o.*, p.n AS left_n, q.n AS right_n, round(common / (p.n + q.n - common), 6) AS jaccard FROM o JOIN z p ON p.t = left_table AND p.c = left_column JOIN z q ON q.t = right_table AND q.c = right_column")
def column_jaccard(spark, d):
    return rounded(discovery.value_jaccard(discovery.all_values(_columns(spark, d))), "jaccard")


def _infer(spark, d):
    tables = {t: df.withColumnsRenamed({c: c.split("_", 1)[1] for c in df.columns}) for t, df in _columns(spark, d).items()}
    profiles = None
    for t, df in tables.items():
        one = discovery.column_profiles(df, t, {"nationkey": "key of a nation", "custkey": "key of a customer"}, approximate=False)
        profiles = one if profiles is None else profiles.unionByName(one)
    return discovery.infer_relationships(profiles, discovery.value_jaccard(discovery.all_values(tables)))


_BARE = ", ".join(f"('{t}', '{c}', '{c.split('_', 1)[1]}', '{ {'nationkey': 'key of a nation', 'custkey': 'key of a customer'}.get(c.split('_', 1)[1], '') }')" for t, c in VALUE_COLUMNS)
HYBRID = f"""{OVERLAP}, k(t, c, name, descr) AS (VALUES {_BARE}), rows_of(t, n) AS (SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier),
u AS (SELECT k.*, z.n AS distinct_n, z.n / rows_of.n AS unique_ratio, list_distinct(regexp_extract_all(descr, '[a-z0-9]+')) AS words FROM k JOIN z ON z.t = k.t AND z.c = k.c JOIN rows_of ON rows_of.t = k.t),
pr AS (SELECT a.t AS left_table, a.name AS left_column, b.t AS right_table, b.name AS right_column, a.name = b.name AS same, contains(a.name, b.name) OR contains(b.name, a.name) AS part, (a.unique_ratio + b.unique_ratio) / 2 AS uniq,
  CASE WHEN len(list_distinct(a.words || b.words)) > 0 THEN len(list_intersect(a.words, b.words)) / len(list_distinct(a.words || b.words)) ELSE 0 END AS descr, coalesce(o.common / (a.distinct_n + b.distinct_n - o.common), 0) AS content
  FROM u a JOIN u b ON a.t < b.t LEFT JOIN o ON o.left_table = a.t AND o.left_column = a.c AND o.right_table = b.t AND o.right_column = b.c),
rel AS (SELECT left_table, left_column, right_table, right_column, CASE WHEN same AND content >= 0.8 AND uniq >= 0.05 THEN 'exact_key' ELSE 'semantic_match' END AS join_role, round(0.45 * greatest(same::INT, 0.7 * part::INT) + 0.2 * descr + 0.35 * content, 6) AS confidence, round(content, 6) AS content_similarity FROM pr)"""


@query(f"WITH {HYBRID} SELECT * FROM rel")
def hybrid_confidence(spark, d):
    return _infer(spark, d).select("left_table", "left_column", "right_table", "right_column", "join_role", "confidence", "content_similarity")


@query(f"WITH {HYBRID} SELECT left_table AS pk_table, left_column AS pk_column, right_table AS fk_table, right_column AS fk_column, join_role, confidence FROM rel WHERE confidence >= 0.5 AND join_role = 'exact_key' QUALIFY row_number() OVER (PARTITION BY left_table, right_table, join_role ORDER BY confidence DESC, left_column, right_column) = 1")
def recommend_connections(spark, d):
    return discovery.recommend(_infer(spark, d), 0.5).select("pk_table", "pk_column", "fk_table", "fk_column", "join_role", "confidence")


@query(f"""WITH l AS (SELECT DISTINCT ts FROM events WHERE event_type = 'purchase'), r AS (SELECT DISTINCT ts FROM events WHERE event_type = 'click'),
n AS (SELECT (SELECT count(*) FROM r) < (SELECT count(*) FROM l) AS swap), a AS (SELECT ts FROM l WHERE NOT (SELECT swap FROM n) UNION ALL SELECT ts FROM r WHERE (SELECT swap FROM n)), b AS (SELECT ts AS u FROM r WHERE NOT (SELECT swap FROM n) UNION ALL SELECT ts FROM l WHERE (SELECT swap FROM n)),
x AS (SELECT a.ts, u AS back FROM a ASOF LEFT JOIN b ON a.ts >= u), y AS (SELECT a.ts, u AS ahead FROM a ASOF LEFT JOIN b ON a.ts <= u), dd AS (SELECT least(coalesce(epoch_us(ts) - epoch_us(back), 9e18), coalesce(epoch_us(ahead) - epoch_us(ts), 9e18)) / 1e6 AS d FROM x JOIN y USING (ts)),
rr AS (SELECT {", ".join(f"avg((d <= {g})::INT) AS ratio_{g}" for g in discovery.TOLERANCES)}, round(median(d), 4) AS median_delta FROM dd),
best AS (SELECT g, ratio FROM ({" UNION ALL ".join(f"SELECT {g} AS g, ratio_{g} AS ratio FROM rr" for g in discovery.TOLERANCES)}) ORDER BY round(abs(ratio - 0.9), 9), g LIMIT 1)
SELECT {", ".join(f"round(ratio_{g}, 6) AS ratio_{g}" for g in discovery.TOLERANCES)}, median_delta, g AS recommended, round(ratio, 6) AS match_ratio FROM rr, best""")
def time_alignment(spark, d):
    e = read(spark, d, "events")
    out = discovery.time_alignment(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), "ts", "ts")
    return rounded(rounded(out, *[f"ratio_{g}" for g in discovery.TOLERANCES], "match_ratio"), "median_delta", places=4)


@query(f"WITH {OVERLAP}, j AS (SELECT left_table, left_column, right_table, right_column, common / (p.n + q.n - common) AS x FROM o JOIN z p ON p.t = left_table AND p.c = left_column JOIN z q ON q.t = right_table AND q.c = right_column) SELECT left_table, left_column, right_table, right_column, round(x, 6) AS jaccard FROM j WHERE x >= 0.5")
def minhash_edges(spark, d):
    return rounded(discovery.minhash_edges(discovery.all_values(_columns(spark, d)), 0.5), "jaccard")


def _cosines() -> str:
    """Pairs of VALUE_COLUMNS of two tables with the cosine of their encoded names."""
    rows = []
    for i, (t, c) in enumerate(VALUE_COLUMNS):
        for u, e in VALUE_COLUMNS[i + 1 :]:
            cosine = sum(x * y for x, y in zip(discovery.hashed_ngrams(f"{c} "), discovery.hashed_ngrams(f"{e} "), strict=True))
            if t != u and cosine >= 0.3:
                a, z = sorted([(t, c), (u, e)])
                rows.append(f"('{a[0]}', '{a[1]}', '{z[0]}', '{z[1]}', {cosine!r}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) AS k(left_table, left_column, right_table, right_column, cosine)"


TYPED = "(VALUES " + ", ".join(f"('{t}', '{c}', (SELECT any_value(typeof({c})) FROM {t}))" for t, c in VALUE_COLUMNS) + ") AS ty(t, c, kind)"


@query(f"""WITH {OVERLAP}, j AS (SELECT o.*, common / (p.n + q.n - common) AS jaccard FROM o JOIN z p ON p.t = left_table AND p.c = left_column JOIN z q ON q.t = right_table AND q.c = right_column),
m AS (SELECT k.*, coalesce(jaccard, 0) AS v, a.kind = b.kind AS same FROM {_cosines()} LEFT JOIN j USING (left_table, left_column, right_table, right_column) JOIN (SELECT * FROM {TYPED}) a ON a.t = left_table AND a.c = left_column JOIN (SELECT * FROM {TYPED}) b ON b.t = right_table AND b.c = right_column)
SELECT left_table, left_column, right_table, right_column, round(CASE WHEN NOT same OR v <= 0 THEN 0.5 * cosine ELSE 0.5 * cosine + 0.5 * v END, 6) AS score FROM m WHERE NOT same OR v >= 0.2 OR cosine >= 0.92""")
def schema_matches(spark, d):
    tables = _columns(spark, d)
    return discovery.schema_matches(spark, {t: dict(df.dtypes) for t, df in tables.items()}, discovery.value_jaccard(discovery.all_values(tables)), schema_least=0.3)


def timed_lake(spark, d) -> search.Lake:
    e = read(spark, d, "events").where("ts is not null")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time")
    part = lambda kind, name: e.where(f"event_type = '{kind}'").groupBy(seconds).agg(F.max("value").alias(name), F.count(F.lit(1)).alias("n"))
    return search.Lake({"clicks": part("click", "high"), "purchases": part("purchase", "paid")}, graph.empty(spark), {"clicks": ["high"], "purchases": ["paid"]})


TIMED = """cl AS (SELECT epoch_us(ts) // 1000000 AS time, max(value) AS high, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), pu AS (SELECT epoch_us(ts) // 1000000 AS time, max(value) AS paid, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
sw AS (SELECT (SELECT count(*) FROM pu) < (SELECT count(*) FROM cl) AS swap), l AS (SELECT time FROM cl WHERE NOT (SELECT swap FROM sw) UNION ALL SELECT time FROM pu WHERE (SELECT swap FROM sw)), r AS (SELECT time AS u FROM pu WHERE NOT (SELECT swap FROM sw) UNION ALL SELECT time FROM cl WHERE (SELECT swap FROM sw)),
x AS (SELECT l.time, u AS back FROM l ASOF LEFT JOIN r ON l.time >= u), y AS (SELECT l.time, u AS ahead FROM l ASOF LEFT JOIN r ON l.time <= u), dd AS (SELECT least(coalesce(time - back, 1e18), coalesce(ahead - time, 1e18)) AS d FROM x JOIN y USING (time)),
al AS (SELECT g, avg((d <= g)::INT) AS ratio FROM dd, (SELECT unnest([1, 5, 10, 30, 60, 120, 300, 600, 1800, 3600]) AS g) GROUP BY g), ch AS (SELECT g, ratio FROM al ORDER BY round(abs(ratio - 0.9), 9), g LIMIT 1), md AS (SELECT median(d) AS m FROM dd)"""


@query(f"""WITH {TIMED} SELECT 'temporal_asof' AS relation_type, 'temporal_key' AS join_role, round(0.45 + 0.35 * ratio, 6) AS confidence, round(ratio, 6) AS content_similarity, g::INT AS recommended_tolerance_seconds, round(m, 4) AS median_nearest_delta FROM ch, md
UNION ALL SELECT 'exact', 'config_key', NULL, NULL, NULL, NULL""")
def temporal_roles(spark, d):
    """The time pair with its tolerance, and the role of the pair of columns n."""
    found = ingest.relationships(timed_lake(spark, d)).where("left_column = right_column")
    timed = F.col("left_column") == "time"
    out = found.select("relation_type", "join_role", F.when(timed, F.col("confidence")).alias("confidence"), F.when(timed, F.col("content_similarity")).alias("content_similarity"), F.col("recommended_tolerance_seconds"), F.round("median_nearest_delta", 4).alias("median_nearest_delta"))
    return out


@query(f"WITH {TIMED} SELECT 'asof' AS mode, 'time' AS join_key, g::INT AS tolerance_seconds, 'purchases' AS tables FROM ch")
def join_plan(spark, d):
    found = discovery.recommend(ingest.relationships(timed_lake(spark, d)), 0.3)
    p = discovery.join_plan(found, "clicks", temporal_least=0.3)
    return spark.createDataFrame([(p["mode"], p["join_key"], p["tolerance_seconds"], ",".join(p["tables"]))], "mode string, join_key string, tolerance_seconds int, tables string")


@query(f"WITH {HYBRID} SELECT right_table AS from_id, left_table AS to_id, right_column AS from_column, left_column AS to_column, confidence AS weight FROM rel WHERE confidence >= 0.55 AND join_role = 'exact_key' QUALIFY row_number() OVER (PARTITION BY left_table, right_table, join_role ORDER BY confidence DESC, left_column, right_column) = 1")
def discovered_edges(spark, d):
    """What discovery finds goes into the graph."""
    return graph.upsert(graph.empty(spark), ingest.edges_of(discovery.recommend(_infer(spark, d), 0.55)))


@query(f"WITH {HYBRID} SELECT left_table, left_column, right_table, right_column, join_role FROM rel WHERE left_table = 'nation' OR right_table = 'nation'")
def relationships_of_base(spark, d):
    return columns.touching(_infer(spark, d), "nation").select("left_table", "left_column", "right_table", "right_column", "join_role")


@query(f"SELECT 'orders' AS \"table\", count(*) AS n, min(o_orderkey) AS least FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500)")
def sampled_scan(spark, d):
    return profile.sampled(read(spark, d, "orders"), 500, ["o_orderdate", "o_orderkey"]).agg(F.lit("orders").alias("table"), F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


@query("SELECT 'nation' AS \"table\", 'n_name' AS \"column\", len(list_sort(list(DISTINCT n_name))[1:5]) AS n_samples, (SELECT count(*) FROM nation) > 0 AS are_values FROM nation")
def profile_samples(spark, d):
    rows = discovery.column_profiles(read(spark, d, "nation"), "nation").where("column = 'n_name'")
    names = read(spark, d, "nation").agg(F.collect_set("n_name").alias("names"))
    met = rows.crossJoin(F.broadcast(names))  # one row
    return met.select("table", "column", F.size("samples").cast("long").alias("n_samples"), (F.size(F.array_except("samples", "names")) == 0).alias("are_values"))


# ---- time series ----

SEC = "epoch_us(ts) / 1e6"
DELTAS = f"g AS (SELECT *, {SEC} - lag({SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events)"


@query(f"WITH {DELTAS} SELECT user_id, event_id, (1 + sum((coalesce(delta, 0) > 86400)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM g")
def gap_segments(spark, d):
    return timeseries.gap_segments(read(spark, d, "events"), "ts", ["user_id"], 86400, "event_id").select("user_id", "event_id", "segment")


@query(f"WITH {DELTAS} SELECT user_id, round(median(delta), 4) AS step FROM g WHERE delta > 0 GROUP BY 1")
def infer_frequency(spark, d):
    return rounded(timeseries.frequency(read(spark, d, "events"), "ts", ["user_id"], exact=True), "step", places=4)


@query(f"WITH {DELTAS}, f AS (SELECT user_id, median(delta) AS step FROM g WHERE delta > 0 GROUP BY 1), x AS (SELECT g.user_id, ts, delta, step, floor(delta / step)::BIGINT - 1 AS missing FROM g JOIN f USING (user_id) WHERE delta > step * 1.5) SELECT user_id, epoch_us(ts) AS at, round(delta, 4) AS delta, missing FROM x WHERE missing > 0")
def gap_report(spark, d):
    out = timeseries.gap_report(read(spark, d, "events"), "ts", ["user_id"], exact=True)
    return rounded(out.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "delta", "missing"), "delta", places=4)


SERIES = "s AS (SELECT user_id, epoch_us(ts) // 3600000000 AS hour, value FROM events WHERE event_type = 'click'), a AS (SELECT user_id, hour, avg(value) AS value FROM s GROUP BY ALL), e AS (SELECT user_id, unnest(generate_series(min(hour), max(hour), 6)) AS hour FROM a GROUP BY user_id), grid AS (SELECT u.user_id, u.hour, a.value FROM (SELECT * FROM e UNION SELECT user_id, hour FROM a) u LEFT JOIN a ON a.user_id = u.user_id AND a.hour = u.hour)"


def grid(spark, d):
    e = read(spark, d, "events").where("event_type = 'click'").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("hour"), "value")
    return timeseries.regular_grid(e, "hour", ["user_id"], 6, ["value"])


@query(f"WITH {SERIES} SELECT user_id, hour, round(value, 6) AS value FROM grid")
def regular_grid(spark, d):
    return rounded(grid(spark, d), "value")


BACK = "last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(f"WITH {SERIES} SELECT user_id, hour, round(coalesce(value, {BACK}, {AHEAD}), 6) AS value FROM grid")
def impute_ffill_bfill(spark, d):
    return rounded(timeseries.impute(grid(spark, d), ["value"], "hour", ["user_id"], "fill"), "value")


BACK_T, AHEAD_T = BACK.replace("value IGNORE", "t IGNORE"), AHEAD.replace("value IGNORE", "t IGNORE")


@query(f"WITH {SERIES}, w AS (SELECT *, CASE WHEN value IS NOT NULL THEN hour END AS t FROM grid), x AS (SELECT *, {BACK} AS bv, {AHEAD} AS av, {BACK_T} AS bt, {AHEAD_T} AS aft FROM w) SELECT user_id, hour, round(coalesce(value, bv + (av - bv) * (hour - bt) / nullif(aft - bt, 0), bv, av), 9) AS value FROM x")
def impute_linear_time(spark, d):
    return rounded(timeseries.impute(grid(spark, d), ["value"], "hour", ["user_id"], "linear"), "value", places=9)


@query(f"WITH {SERIES} SELECT user_id, hour, round(coalesce(value, avg(value) OVER (PARTITION BY user_id)), 6) AS value FROM grid")
def impute_mean(spark, d):
    return rounded(timeseries.impute(grid(spark, d), ["value"], "hour", ["user_id"], "mean"), "value")


WINDOWS = "r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS start FROM events), w AS (SELECT user_id, start, list(value) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS win, lead(value, 16) OVER (PARTITION BY user_id ORDER BY start) AS y FROM r QUALIFY y IS NOT NULL)"


def windows(spark, d):
    return timeseries.sliding_windows(read(spark, d, "events"), "value", "ts", ["user_id"], 16, 4, 1, "event_id")


@query(f"WITH {WINDOWS} SELECT user_id, start, round(list_sum(win), 4) AS total, win[1] AS first, win[16] AS last, y FROM w WHERE start % 4 = 0")
def sliding_windows(spark, d):
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x)
    return windows(spark, d).select("user_id", F.col("start").cast("long").alias("start"), F.round(total, 4).alias("total"), F.get("window", F.lit(0)).alias("first"), F.get("window", F.lit(15)).alias("last"), "y")


@query(f"WITH {WINDOWS} SELECT user_id, start, round(list_avg(win), 6) AS naive_mean, round(win[16] + (win[16] - win[1]) / 15, 6) AS naive_drift, win[16] AS naive_seasonal, round(list_avg(win[9:16]), 6) AS naive_moving_average FROM w WHERE start % 4 = 0")
def naive_forecasts(spark, d):
    out = timeseries.naive_forecasts(windows(spark, d))
    return rounded(out.select("user_id", F.col("start").cast("long").alias("start"), "naive_mean", "naive_drift", "naive_seasonal", "naive_moving_average"), "naive_mean", "naive_drift", "naive_moving_average")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8) AS is_train FROM orders")
def temporal_split(spark, d):
    return timeseries.chronological_split(read(spark, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "is_train")


@query("SELECT c_custkey, c_mktsegment <> (SELECT max(c_mktsegment) FROM customer) AS is_train FROM customer")
def group_holdout(spark, d):
    return timeseries.group_holdout(read(spark, d, "customer"), "c_mktsegment").select("c_custkey", "is_train")


@query("WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8) AS is_train FROM orders), m AS (SELECT median(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM t WHERE is_train) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM t, m")
def scale_train_stats(spark, d):
    rows = timeseries.chronological_split(read(spark, d, "orders"), "o_orderdate", "o_orderkey")
    return rounded(timeseries.scale_by_train(rows, ["o_totalprice"], exact=True).select("o_orderkey", "o_totalprice"), "o_totalprice")


# ---- scalars ----


@query("SELECT event_id, TRY_CAST(nullif(regexp_replace(props, '[^0-9eE+\\-.]', '', 'g'), '') AS DOUBLE) AS x FROM events")
def numeric_clean(spark, d):
    return read(spark, d, "events").select("event_id", scalars.numeric_clean(F.col("props")).alias("x"))


@query("SELECT p_partkey, (p_size * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1e6 ELSE 1e9 END)::DOUBLE AS x FROM part")
def unit_suffix_clean(spark, d):
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 1, F.lit(" MB")).otherwise(F.lit("g")))
    return read(spark, d, "part").select("p_partkey", scalars.unit_suffix_clean(text).alias("x"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 's' WHEN 1 THEN 'ms' WHEN 2 THEN 'us' ELSE 'ns' END AS unit, (epoch_us(ts) // 1000000 * 1000000)::BIGINT AS micros FROM events")
def timestamp_unit(spark, d):
    s = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    x = s * F.pow(F.lit(1000.0), (F.col("event_id") % 4).cast("double"))
    return read(spark, d, "events").select("event_id", scalars.epoch_unit(x).alias("unit"), scalars.epoch_micros(x).alias("micros"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(trim(p_name)), '_ms', ''), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS name FROM part")
def normalized_names(spark, d):
    return read(spark, d, "part").select("p_partkey", scalars.name_column(F.col("p_name")).alias("name"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'nation' ELSE 'base' END AS source_table FROM nation")
def feature_source(spark, d):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("lake/nation."), "n_name")).otherwise(F.col("n_name"))
    return read(spark, d, "nation").select("n_nationkey", scalars.source_table(name).alias("source_table"))


@query("SELECT n_nationkey, len(string_split(n_name, '_')) AS n FROM nation")
def list_literals(spark, d):
    text = F.concat(F.lit("['"), F.replace("n_name", F.lit("_"), F.lit("', '")), F.lit("']"))
    return read(spark, d, "nation").select("n_nationkey", F.size(scalars.list_literal(text)).cast("long").alias("n"))


@query("SELECT n_nationkey, n_regionkey AS x, 2 * n_regionkey AS y, -n_nationkey AS z FROM nation")
def position_parse(spark, d):
    text = F.format_string("pos_x%d_y%d_z%d", F.col("n_regionkey"), 2 * F.col("n_regionkey"), -F.col("n_nationkey"))
    return read(spark, d, "nation").select("n_nationkey", scalars.position(text).alias("p")).select("n_nationkey", "p.x", "p.y", "p.z")


# ---- roll-ups, metrics ----


@query("SELECT l_quantity, median(l_extendedprice) AS median_l_extendedprice, median(l_discount) AS median_l_discount FROM lineitem GROUP BY 1")
def group_median(spark, d):
    return rollups.group_median(read(spark, d, "lineitem"), "l_quantity", ["l_extendedprice", "l_discount"])


@query("SELECT event_type, user_id, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def mean_scores(spark, d):
    return rounded(rollups.mean_by(read(spark, d, "events"), ["event_type", "user_id"], "value"), "mean_value")


@query("SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY 1")
def pivot_scores(spark, d):
    return rounded(rollups.pivot_scores(read(spark, d, "events"), "user_id", "event_type", ["click", "view"], "value"), "click", "view")


RESULTS = "res AS (SELECT o_orderpriority AS scenario, o_orderstatus AS approach, round(avg(o_totalprice) / 1e6, 9) AS r2, round(stddev_samp(o_totalprice) / 1e5, 9) AS rmse, count(*) AS n_features, count(DISTINCT o_custkey)::DOUBLE AS total_time FROM orders GROUP BY ALL)"


def results(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("approach")).agg(
        F.round(F.avg("o_totalprice") / 1e6, 9).alias("r2"), F.round(F.stddev("o_totalprice") / 1e5, 9).alias("rmse"), F.count(F.lit(1)).alias("n_features"), F.count_distinct("o_custkey").cast("double").alias("total_time")
    )


@query(f"WITH {RESULTS}, b AS (SELECT scenario, max(r2) AS base FROM res WHERE approach = 'F' GROUP BY 1) SELECT scenario, approach, round(r2 - base, 6) AS lift FROM res LEFT JOIN b USING (scenario)")
def lift_vs_base(spark, d):
    return rounded(rollups.lift(results(spark, d), ["scenario"], "approach", "F", "r2").select("scenario", "approach", "lift"), "lift")


@query(f"WITH {RESULTS} SELECT scenario, approach, r2 FROM res QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY r2 DESC, approach) = 1")
def best_per_group(spark, d):
    return rollups.best_per_group(results(spark, d), ["scenario"], "r2", "approach").select("scenario", "approach", "r2")


@query(f"""WITH {RESULTS}, w AS (SELECT *, max(r2) FILTER (approach = 'F') OVER (PARTITION BY scenario) AS br, max(rmse) FILTER (approach = 'F') OVER (PARTITION BY scenario) AS bm, max(r2) FILTER (approach = 'O') OVER (PARTITION BY scenario) AS fr, max(rmse) FILTER (approach = 'O') OVER (PARTITION BY scenario) AS fm,
max(n_features) FILTER (approach = 'O') OVER (PARTITION BY scenario) AS fn, max(total_time) FILTER (approach = 'O') OVER (PARTITION BY scenario) AS ft FROM res)
SELECT scenario, approach, round(r2 - br, 6) AS delta_base, round(r2 - fr, 6) AS delta_full, round(((1 - br) - (1 - r2)) / nullif(1 - br, 0), 6) AS error_reduction_base, round(((1 - fr) - (1 - r2)) / nullif(1 - fr, 0), 6) AS error_reduction_full, round((bm - rmse) / nullif(bm, 0), 6) AS rmse_reduction_base, round((fm - rmse) / nullif(fm, 0), 6) AS rmse_reduction_full,
round(1 - n_features / nullif(fn, 0), 6) AS feature_reduction_full, round(ft / nullif(total_time, 0), 6) AS speedup_full FROM w""")
def comparison_columns(spark, d):
    out = rollups.compare(results(spark, d), ["scenario"], "approach", "F", "O")
    new = ["delta_base", "delta_full", "error_reduction_base", "error_reduction_full", "rmse_reduction_base", "rmse_reduction_full", "feature_reduction_full", "speedup_full"]
    return rounded(out.select("scenario", "approach", *new), *new)


@query("WITH t AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'items' ELSE 'base' END AS source_table FROM lineitem ORDER BY abs(l_extendedprice) DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100) SELECT source_table, count(*) AS n FROM t GROUP BY 1")
def source_tally(spark, d):
    rows = read(spark, d, "lineitem")
    key = F.format_string("%010d_%d_%010d", "l_orderkey", "l_linenumber", "l_partkey")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("items."), key)).otherwise(key)
    return rollups.source_tally(rows.select(name.alias("feature"), F.col("l_extendedprice").alias("importance")), "feature", "importance", 100)


@query("SELECT event_type, count(DISTINCT user_id) AS n_features FROM events GROUP BY 1")
def feature_counts(spark, d):
    return rollups.feature_counts(read(spark, d, "events"), ["event_type"], "user_id")


@query("SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 6) AS min_max, round((s_acctbal - avg(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 6) AS centred FROM supplier WINDOW w AS ()")
def normalised_values(spark, d):
    rows = read(spark, d, "supplier").withColumn("one", F.lit(1))
    return rounded(rollups.normalised(rows, "s_acctbal", ["one"]).select("s_suppkey", "min_max", "centred"), "min_max", "centred")


@query("WITH u AS (SELECT user_id, event_id, value, 0 AS new FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, value, 1 FROM events WHERE event_type <> 'click') SELECT user_id, event_id, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, new DESC) = 1")
def append_keep_last(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    return rollups.keep_last(e.where("event_type = 'click'").drop("event_type"), e.where("event_type <> 'click'").drop("event_type"), "user_id", "event_id")


@query("SELECT event_type, max(value) AS best, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def sensitivity(spark, d):
    return rounded(rollups.sensitivity(read(spark, d, "events"), ["event_type"], "value"), "mean")


@query("""SELECT count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e / nullif(y, 0))), 6) AS mape, round(1 - sum(e * e) / (var_pop(y) * count(y)), 6) AS r2 FROM (SELECT l_extendedprice AS y, l_quantity * 3000 - l_extendedprice AS e FROM lineitem)""")
def metrics_regression(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 3000).alias("prediction"))
    return rounded(rounded(models.regression_metrics(rows), "mae", "rmse", places=4), "mape", "r2")


@query("""WITH c AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 25 THEN 'A' WHEN l_quantity < 40 THEN 'N' ELSE 'R' END AS p FROM lineitem), k AS (SELECT DISTINCT y AS k FROM c UNION SELECT DISTINCT p FROM c),
s AS (SELECT k, (SELECT count(*) FROM c WHERE y = k) AS a, (SELECT count(*) FROM c WHERE p = k) AS g, (SELECT count(*) FROM c WHERE y = k AND p = k) AS h FROM k) SELECT round(sum(h) / sum(a), 6) AS accuracy, round(avg(2 * h / (a + g)), 6) AS macro_f1 FROM s""")
def macro_f1(spark, d):
    guess = F.when(F.col("l_quantity") < 25, "A").when(F.col("l_quantity") < 40, "N").otherwise("R")
    return rounded(models.classification_metrics(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), guess.alias("prediction"))), "accuracy", "macro_f1")


@query("""WITH p AS (SELECT l_quantity AS x, (l_returnflag = 'R')::INT AS a, (l_returnflag <> 'R')::INT AS b FROM lineitem), c AS (SELECT x, sum(a) AS a, sum(b) AS b FROM p GROUP BY 1), g AS (SELECT abs(sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER ()) AS gap, lead(x) OVER (ORDER BY x) - x AS width FROM c)
SELECT 'l_quantity' AS "column", round(max(gap), 6) AS ks, round(sum(gap * width), 6) AS wasserstein FROM g""")
def distribution_distance(spark, d):
    rows = read(spark, d, "lineitem")
    return rounded(augment.distribution_distance(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), ["l_quantity"]), "ks", "wasserstein")


@query("SELECT 'l_quantity' AS \"left\", 'l_extendedprice' AS \"right\", round(abs(corr(l_quantity, l_extendedprice) FILTER (l_returnflag = 'R') - corr(l_quantity, l_extendedprice) FILTER (l_returnflag <> 'R')), 6) AS delta FROM lineitem")
def correlation_delta(spark, d):
    rows = read(spark, d, "lineitem")
    return rounded(augment.correlation_delta(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), ["l_quantity", "l_extendedprice"]), "delta")


@query("SELECT part, count(*) AS n FROM (SELECT 'a' AS part FROM events WHERE event_type = 'click' UNION ALL SELECT 'b' FROM events WHERE event_type <> 'click') GROUP BY 1")
def union_frames(spark, d):
    e = read(spark, d, "events")
    both = e.where("event_type = 'click'").select(F.lit("a").alias("part"), "value").unionByName(e.where("event_type <> 'click'").select(F.lit("b").alias("part")), allowMissingColumns=True)
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# ---- filters by name, sources and sinks ----


def staged(spark, d) -> tuple[str, search.Lake]:
    """nation and region written as CSV files with a connections file, and the lake read from them."""
    place = session.work_dir(spark, "lake")
    for name in ("nation", "region"):
        df = read(spark, d, name)
        df.coalesce(1).write.option("header", True).csv(f"{place}/{name}.csv")  # a table of tens of rows
    rows = spark.createDataFrame([("nation", "n_regionkey", "region", "r_regionkey")], "fk_table string, fk_column string, pk_table string, pk_column string")
    rows.coalesce(1).write.option("header", True).csv(f"{place}/connections")
    tables = {n: lakes.read_table(spark, f"{place}/{n}.csv") for n in ("nation", "region")}
    return place, search.Lake(tables, lakes.read_connections(spark, f"{place}/connections"), {"region": ["r_name"]})


@query("SELECT n_nationkey, n_name AS nation__n_name, r_name AS region__r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lake_from_files(spark, d):
    """Tables and connections from files, prefixed and joined."""
    _, lk = staged(spark, d)
    out, _ = search.join_all(lk, "nation", search.Settings("n_nationkey"))
    return out.select(F.col("n_nationkey").cast("int"), "nation__n_name", "region__r_name")


@query("SELECT 'nation' AS from_id, 'region' AS to_id, 'n_regionkey' AS from_column, 'r_regionkey' AS to_column, 1.0::DOUBLE AS weight")
def connections_file(spark, d):
    return staged(spark, d)[1].graph


@query("SELECT event_id, epoch_us(ts) // 1000000 AS time FROM events WHERE event_id % 3 <> 0")
def timed_table(spark, d):
    """A time series from a file whose time is text; rows without a time go."""
    place = session.work_dir(spark, "timed")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("string")
    read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("none")).otherwise(seconds).alias("time")).write.parquet(f"{place}.parquet")
    return lakes.read_timed(spark, f"{place}.parquet", "time", order=True).select("event_id", "time")


@query("WITH r AS (SELECT o_orderpriority AS scenario, o_orderstatus AS approach, count(*) AS n FROM orders GROUP BY ALL) SELECT scenario, approach, n FROM r WHERE scenario IN ('1-URGENT', '2-HIGH') OR scenario = '3-MEDIUM' AND approach = 'F'")
def results_by_manifest(spark, d):
    """Summaries of two scenarios, a raw file for a third, and one that the manifest hasn't."""
    r = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), F.col("o_orderstatus").alias("approach")).agg(F.count(F.lit(1)).alias("n_features")).withColumns({"algorithm": F.lit("RF"), "total_time": F.lit(1.0)})
    raw = r.where("scenario in ('2-HIGH', '3-MEDIUM') and approach = 'F'").withColumnRenamed("scenario", "data_label")
    summaries = [r.where(f"scenario = '{x}'").drop("algorithm") for x in ("1-URGENT", "2-HIGH", "5-LOW")]
    out = registry.union_results(summaries, [raw], ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return out.select("scenario", "approach", F.col("n_features").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def augmented_sink(spark, d):
    """Written under the name that its label and path always have, and read again."""
    place = session.work_dir(spark, "out")
    written = sinks.write_augmented(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), place, "orders", PATH)
    return lakes.read_table(spark, written)


@query(f"WITH {WINDOWS} SELECT user_id, start, len(win) AS n, y FROM w WHERE start % 4 = 0")
def window_sink(spark, d):
    place = sinks.write_windows(windows(spark, d), session.work_dir(spark, "windows"), "events")
    return spark.read.parquet(place).select("user_id", F.col("start").cast("long").alias("start"), F.size("window").cast("long").alias("n"), "y")


def _names(kept: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\"" for c in kept.split())


def telemetry(spark, d) -> DataFrame:
    """lineitem under names as telemetry has them."""
    new = {"l_quantity": "lat95", "l_discount": "lat99", "l_tax": "mean", "l_orderkey": "user_id", "l_linenumber": "n", "l_returnflag": "datetime", "l_partkey": "time"}
    return read(spark, d, "lineitem").select(*[F.col(c).alias(x) for c, x in new.items()])


def listed(spark, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(c,) for c in df.columns], "column string")


@query(_names("lat99 user_id n datetime time"))
def strip_target_proxies(spark, d):
    return listed(spark, columns.strip_target_proxies(telemetry(spark, d), "lat99"))


@query(_names("lat95 lat99 mean user_id n time"))
def strip_time_text(spark, d):
    return listed(spark, columns.strip_time_text(telemetry(spark, d)))


@query(_names("lat95 lat99 mean n datetime time"))
def drop_identity(spark, d):
    return listed(spark, columns.drop_identity(telemetry(spark, d), "lat99"))


@query(_names("lat95 lat99 mean user_id datetime time"))
def drop_join_keys(spark, d):
    return listed(spark, columns.drop_join_keys(telemetry(spark, d), ["time", "n"], "time"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10")
def latency_filter(spark, d):
    return columns.above(telemetry(spark, d), "lat95", 10).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('kpi__lat95', 1), ('kpi__LAT99', 1), ('kpi__mean', 1), ('kpi__latency', 0), ('kpi__n', 0)) AS t(feature, pattern_risk)")
def policy_on_joined_names(spark, d):
    """Columns of a joined table are told by their own name, whatever the prefix and case."""
    new = {"l_quantity": "kpi__lat95", "l_discount": "kpi__LAT99", "l_tax": "kpi__mean", "l_partkey": "kpi__latency", "l_linenumber": "kpi__n"}
    rows = read(spark, d, "lineitem").select(*[F.col(c).alias(x) for c, x in new.items()], F.col("l_extendedprice").alias("y"))
    return selection.score_features(rows, "y", policy.policy_patterns(["target-proxy-private"])).select("feature", "pattern_risk")


@query("SELECT * FROM (VALUES ('event_id'), ('value'), ('user_id'), ('props')) AS t(feature)")
def feature_columns(spark, d):
    return spark.createDataFrame([(c,) for c in profile.feature_columns(read(spark, d, "events"), "ts", None)], "feature string")


# ---- more joins and search ----


@query("""WITH l AS (SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS click_id, epoch_us(ts) * 1000 + event_id % 7 AS t FROM events WHERE event_type = 'click')
SELECT event_id, click_id, l.t - r.t AS d FROM l ASOF LEFT JOIN r ON l.t >= r.t""")
def asof_nanoseconds(spark, d):
    """Whole nanoseconds, which doubles can't hold."""
    e = read(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'purchase'").select("event_id", (F.col("us") * 1000 + F.col("event_id") % 1000).alias("t"))
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), (F.col("us") * 1000 + F.col("event_id") % 7).alias("u"))
    return joins.asof_join(left, right, "t", "u", direction="backward", order="click_id").select("event_id", "click_id", (F.col("t") - F.col("__right_u")).alias("d"))


@query("""WITH l AS (SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'purchase' UNION ALL SELECT -1, 900000000000000), r AS (SELECT max(event_id) AS click_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'click' GROUP BY 2)
SELECT event_id, click_id FROM l ASOF LEFT JOIN r ON l.t >= r.t""")
def asof_outlier(spark, d):
    """One time far from all others."""
    e = read(spark, d, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))
    left = e.where("event_type = 'purchase'").select("event_id", "t").unionByName(spark.createDataFrame([(-1, 900_000_000_000_000)], "event_id long, t long"))
    right = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("t").alias("u"))
    return joins.asof_join(left, right, "t", "u", direction="backward", order="click_id").select("event_id", "click_id")


REPLAY = """c AS (SELECT epoch_us(ts) // 1000000 AS time, max(value) AS high FROM events WHERE event_type = 'click' GROUP BY 1), p AS (SELECT epoch_us(ts) // 1000000 AS time, max(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY 1),
b AS (SELECT p.time, paid, c.time AS bt, high AS bh FROM p ASOF LEFT JOIN c ON p.time >= c.time), a AS (SELECT p.time, c.time AS ft, high AS fh FROM p ASOF LEFT JOIN c ON p.time <= c.time)"""


@query(f"WITH {REPLAY} SELECT paid, time AS purchases__time, CASE WHEN coalesce(time - bt, 1e18) <= coalesce(ft - time, 1e18) THEN CASE WHEN time - bt <= 3600 THEN bh END ELSE CASE WHEN ft - time <= 3600 THEN fh END END AS clicks__high FROM b JOIN a USING (time)")
def temporal_replay(spark, d):
    """A path whose step is an as-of join on the temporal key."""
    s = search.Settings("paid", temporal_key="time", tolerance=3600)
    return search.replay(timed_lake(spark, d), "purchases--purchases|time|time|clicks", s).select("paid", "purchases__time", "clicks__high")


@query("""WITH p AS (SELECT epoch_us(ts) // 1000000 AS time, max(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY 1), c AS (SELECT epoch_us(ts) // 1000000 AS time, max(value) AS high FROM events WHERE event_type = 'click' GROUP BY 1), v AS (SELECT epoch_us(ts) // 1000000 AS time, max(value) AS seen FROM events WHERE event_type = 'view' GROUP BY 1),
cb AS (SELECT p.time, c.time AS t, high FROM p ASOF LEFT JOIN c ON p.time >= c.time), cf AS (SELECT p.time, c.time AS t, high FROM p ASOF LEFT JOIN c ON p.time <= c.time), vb AS (SELECT p.time, v.time AS t, seen FROM p ASOF LEFT JOIN v ON p.time >= v.time), vf AS (SELECT p.time, v.time AS t, seen FROM p ASOF LEFT JOIN v ON p.time <= v.time)
SELECT p.time, CASE WHEN coalesce(p.time - cb.t, 1e18) <= coalesce(cf.t - p.time, 1e18) THEN CASE WHEN p.time - cb.t <= 1800 THEN cb.high END ELSE CASE WHEN cf.t - p.time <= 1800 THEN cf.high END END AS clicks__high,
CASE WHEN coalesce(p.time - vb.t, 1e18) <= coalesce(vf.t - p.time, 1e18) THEN CASE WHEN p.time - vb.t <= 1800 THEN vb.seen END ELSE CASE WHEN vf.t - p.time <= 1800 THEN vf.seen END END AS views__seen
FROM p JOIN cb USING (time) JOIN cf USING (time) JOIN vb USING (time) JOIN vf USING (time)""")
def fold_asof_joins(spark, d):
    e = read(spark, d, "events")
    part = lambda kind, name: e.where(f"event_type = '{kind}'").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time")).agg(F.max("value").alias(name))
    clicks, views = part("click", "high"), part("view", "seen").withColumn("high", F.col("seen"))
    out = joins.fold_joins(part("purchase", "paid"), {"clicks": clicks, "views": views}, "time", tolerance=1800, order="high")
    return out.select("time", "clicks__high", "views__seen")


def star(spark, d) -> search.Lake:
    """lineitem between orders and part."""
    names = ("lineitem", "orders", "part")
    return search.Lake({n: read(spark, d, n) for n in names}, graph.edges(spark, [e for e in LINKS if e[0] in names and e[1] in names]), {"orders": ["o_orderkey"], "part": ["p_partkey"]})


@query("""SELECT 'orders' AS tables, count(o_orderkey) AS orders_met, 0 AS parts_met, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'part', 0, count(p_partkey), count(*) FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'orders,part', count(o_orderkey), count(p_partkey), count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""")
def join_sets(spark, d):
    """Every set of neighbours joined."""
    out = None
    for names, df in search.join_sets(star(spark, d), "lineitem", search.Settings("l_extendedprice")).items():
        met = lambda c, df=df: F.count(c) if c in df.columns else F.lit(0).cast("long")
        one = df.agg(F.lit(",".join(names)).alias("tables"), met("orders__o_orderkey").alias("orders_met"), met("part__p_partkey").alias("parts_met"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES (0, 'orders'), (1, 'part')) AS t(batch, name)")
def budget_batches(spark, d):
    return spark.createDataFrame([(i, n) for i, b in enumerate(search.budget_batches(star(spark, d), "lineitem", 5)) for n in b], "batch int, name string")


@query()
def budget_join(spark, d):
    return spark.createDataFrame([(f,) for f in search.budget_join(star(spark, d), "lineitem", search.Settings("l_extendedprice"))], "feature string")


# ---- more statistics ----


def _triples(name: str, columns: list[str], other: str, source: str = "i") -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, {other}::DOUBLE AS y, y::DOUBLE AS z FROM {source}" for c in columns) + ")"


_CMI = lambda s: f"{_entropy(f'{s}xz', 'x, z', s)}, {_entropy(f'{s}yz', 'y, z', s)}, {_entropy(f'{s}xyz', 'x, y, z', s)}, {_entropy(f'{s}z', 'z', s)}, {s}cmi AS (SELECT feature, {s}xz.h + {s}yz.h - {s}xyz.h - {s}z.h AS cmi FROM {s}xz JOIN {s}yz USING (feature) JOIN {s}xyz USING (feature) JOIN {s}z USING (feature))"


@query(f"WITH {ITEM}, {BINNED}, {_pairs(ITEMS[1:], 'y', 'b', 't')}, {_pairs(ITEMS[1:], 'l_quantity', 'b', 's')}, {_MI('t')}, {_MI('s')}, {_triples('g', ITEMS[1:], 'l_quantity')}, {_CMI('g')} SELECT feature, round(tmi.mi - smi.mi + gcmi.cmi, 6) AS score FROM tmi JOIN smi USING (feature) JOIN gcmi USING (feature)")
def jmi_scores(spark, d):
    return rounded(stats.redundancy(items(spark, d), ["l_quantity"], ITEMS[1:], "y", joint=True, parity=False).select("feature", "score"), "score")


@query(f"WITH {ITEM}, {_pairs(ITEMS[1:], 'y', 'i', 't')}, {_pairs(ITEMS[1:], 'l_quantity', 'i', 's')}, {_MI('t')}, {_MI('s')}, {_triples('g', ITEMS[1:], 'l_quantity')}, {_CMI('g')} SELECT feature, round(tmi.mi - (smi.mi - gcmi.cmi), 6) AS score FROM tmi JOIN smi USING (feature) JOIN gcmi USING (feature)")
def cmim_scores(spark, d):
    return rounded(stats.conditional_redundancy(items(spark, d), ["l_quantity"], ITEMS[1:], "y", parity=False).select("feature", "score"), "score")


def _given(columns: list[str], other: str) -> str:
    return f"g{other} AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, y::DOUBLE AS y, {other}::DOUBLE AS z FROM i" for c in columns if c != other) + ")"


@query(f"WITH {ITEM}, {', '.join(_given(ITEMS[1:], o) for o in ITEMS[1:])}, {', '.join(_CMI(f'g{o}') for o in ITEMS[1:])}, u AS ({' UNION ALL '.join(f'SELECT * FROM g{o}cmi' for o in ITEMS[1:])}) SELECT feature, round(avg(cmi), 6) AS score FROM u GROUP BY 1 HAVING round(avg(cmi), 9) > 0")
def group_redundancy(spark, d):
    return rounded(stats.group_redundancy(items(spark, d), ITEMS[1:], "y"), "score")


@query(f"WITH {ORDER_CHAIN}, {UNPIVOT}, {RANKS}, {SCORED} SELECT round(avg(score), 4) AS score FROM s WHERE score > 0 AND score < 1")
def path_score(spark, d):
    found = [r.score for r in stats.relevance(chain(spark, d), CHAIN, "y").collect()]  # a row a feature
    return rounded(spark.createDataFrame([(stats.path_score(found, None),)], "score double"), "score", places=4)


@query(f"WITH {ITEM}, {BINNED}, {_pairs(ITEMS[1:], 'y', 'b', 't')}, {_pairs(ITEMS[1:], 'l_quantity', 'b', 's')}, {_MI('t')}, {_MI('s')}, m AS (SELECT feature, round(tmi.mi - smi.mi, 9) AS raw FROM tmi JOIN smi USING (feature)), n AS (SELECT feature, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS score FROM m) SELECT feature, round(score, 4) AS score FROM n WHERE score > 0")
def mrmr_normalised(spark, d):
    return rounded(stats.redundancy(items(spark, d), ["l_quantity"], ITEMS[1:], "y").select("feature", "score"), "score", places=4)


@query("SELECT c_custkey, c_nationkey FROM customer ORDER BY md5('0:' || c_custkey::VARCHAR), c_custkey LIMIT 100")
def base_sample(spark, d):
    """A seeded sample of the base table; the sampling is the operator."""
    return search.base_sample(read(spark, d, "customer").select("c_custkey", "c_nationkey"), 100, ["c_custkey"])


def _noise(part: float, seed: int) -> str:
    import random

    r = random.Random(seed)
    z = [r.gauss(0, 1) / (len(ITEMS) - 1) ** 0.5 for _ in ITEMS]
    mean = f"(({' + '.join(ITEMS)}) / {len(ITEMS)})"
    return f"{mean} + " + " + ".join(f"({c} - {mean}) * {w!r}::DOUBLE" for c, w in zip(ITEMS, z, strict=True))


@query(f"WITH {ITEM} SELECT round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(corr(x, l_quantity), 4) AS corr FROM (SELECT {_noise(0.2, 7)} AS x, l_quantity FROM i)")
def noise_columns(spark, d):
    """Random columns with the rows' mean and covariance."""
    out, names = selection.inject_noise(items(spark, d), ITEMS, 0.2, 7)
    return rounded(out.agg(F.avg(names[0]).alias("mean"), F.stddev(names[0]).alias("std"), F.corr(names[0], "l_quantity").alias("corr")), "mean", "std", "corr", places=4)


# ---- more time series and augmentation ----

UNIT = lambda seed, *parts: f"((('0x' || substr(md5('{seed}' || {' || '.join(chr(39) + ':' + chr(39) + ' || ' + p for p in parts)}), 1, 12))::BIGINT + 0.5) / {float(1 << 48)!r}::DOUBLE)"


@query(f"WITH t AS (SELECT *, value IS NOT NULL AND {UNIT(7, 'event_id::VARCHAR')} < 0.1 AS hide FROM events), w AS (SELECT *, CASE WHEN hide THEN NULL ELSE value END AS v, epoch_us(ts) / 1e6 AS s FROM t), p AS (SELECT *, CASE WHEN v IS NOT NULL THEN s END AS k FROM w), x AS (SELECT hide, value, s, v, last_value(v IGNORE NULLS) OVER b AS bv, last_value(k IGNORE NULLS) OVER b AS bt, first_value(v IGNORE NULLS) OVER f AS av, first_value(k IGNORE NULLS) OVER f AS aft FROM p WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), e AS (SELECT value, coalesce(bv + (av - bv) * (s - bt) / nullif(aft - bt, 0), bv, av) - value AS e FROM x WHERE hide) SELECT count(e) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e / nullif(value, 0))), 4) AS mape FROM e WHERE e IS NOT NULL")
def masked_imputation_error(spark, d):
    e = timeseries.mask_cells(read(spark, d, "events"), "value", "event_id", 0.1)
    return rounded(timeseries.imputation_error(timeseries.impute(e, ["value"], "ts", ["user_id"], "linear"), "value"), "mae", "rmse", "mape", places=4)


@query(f"WITH r AS (SELECT c_custkey, {UNIT(42, 'c_custkey::VARCHAR')} AS u FROM customer) SELECT c_custkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS part FROM r")
def seeded_split(spark, d):
    return timeseries.seeded_split(read(spark, d, "customer"), "c_custkey", {"train": 0.7, "validation": 0.15, "test": 0.15}).select("c_custkey", "part")


def _poisson(ratio: float, u: str) -> str:
    """By the inverse of the distribution function, with factorials instead of a running term."""
    import math

    below, out = 0.0, []
    for k in range(60):
        below += math.exp(-ratio) * ratio**k / math.factorial(k)
        out.append(f"({u} >= {below!r}::DOUBLE)::INT")
        if below >= 1.0 - 2.0**-52:
            break
    return " + ".join(out)


AUGMENTED = f"o AS (SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey, {_poisson(0.5, UNIT(42, 'o_orderkey::VARCHAR'))} AS n FROM orders), g AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM o), k AS (SELECT *, o_orderkey::VARCHAR || '#' || copy::VARCHAR AS key FROM g)"


def _augmented(spark, d, kind):
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return rounded(augment.augment_rows(rows, ["o_totalprice", "o_custkey"], "o_orderkey", kind, strength=0.3).where("is_synthetic").drop("is_synthetic"), "o_totalprice", "o_custkey", places=3)


@query(f"WITH {AUGMENTED}, s AS (SELECT stddev_samp(o_totalprice) AS a, stddev_samp(o_custkey) AS b FROM orders) SELECT o_orderkey, round(o_totalprice + sqrt(-2 * ln({UNIT(44, 'key')})) * cos(2 * 3.141592653589793 * {UNIT(45, 'key')}) * 0.3 * a, 3) AS o_totalprice, round(o_custkey + sqrt(-2 * ln({UNIT(51, 'key')})) * cos(2 * 3.141592653589793 * {UNIT(52, 'key')}) * 0.3 * b, 3) AS o_custkey FROM k, s")
def augmented_rows(spark, d):
    return _augmented(spark, d, "jitter")


@query(f"WITH {AUGMENTED} SELECT o_orderkey, round(o_totalprice * (1 + 0.3 * sqrt(-2 * ln({UNIT(44, 'key')})) * cos(2 * 3.141592653589793 * {UNIT(45, 'key')})), 3) AS o_totalprice, round(o_custkey * (1 + 0.3 * sqrt(-2 * ln({UNIT(51, 'key')})) * cos(2 * 3.141592653589793 * {UNIT(52, 'key')})), 3) AS o_custkey FROM k")
def augmented_scaling(spark, d):
    return _augmented(spark, d, "scaling")


@query(f"WITH {AUGMENTED}, f AS (SELECT *, floor({UNIT(45, 'key')} * 2) AS first FROM k) SELECT o_orderkey, CASE WHEN first <> 0 THEN round(o_totalprice, 3) END AS o_totalprice, CASE WHEN first <> 1 THEN o_custkey END AS o_custkey FROM f")
def augmented_time_mask(spark, d):
    return _augmented(spark, d, "time_mask")


@query(f"WITH {AUGMENTED} SELECT o_orderkey, CASE WHEN {UNIT(46, 'key')} >= 0.3 THEN round(o_totalprice, 3) END AS o_totalprice, CASE WHEN {UNIT(47, 'key')} >= 0.3 THEN o_custkey END AS o_custkey FROM k")
def augmented_magnitude_mask(spark, d):
    return _augmented(spark, d, "magnitude_mask")


@query(f"WITH {WINDOWS}, k AS (SELECT user_id, start, win, user_id::VARCHAR || '_' || start::VARCHAR AS key FROM w WHERE start % 4 = 0), f AS (SELECT *, floor({UNIT(42, 'key')} * 13) AS first FROM k) SELECT user_id, start, round(list_sum([CASE WHEN i - 1 < first OR i - 1 >= first + 4 THEN win[i] END FOR i IN range(1, 17)]), 4) AS total FROM f")
def augmented_windows(spark, d):
    """A run of a quarter of each window blanked."""
    rows = windows(spark, d).withColumn("key", F.concat_ws("_", F.col("user_id").cast("string"), F.col("start").cast("string")))
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return augment.augment_windows(rows, "window", "key", "time_mask", 0.25).select("user_id", F.col("start").cast("long").alias("start"), F.round(total, 4).alias("total"))


@query(f"WITH {WINDOWS}, k AS (SELECT user_id, start, win, user_id::VARCHAR || '_' || start::VARCHAR AS key FROM w WHERE start % 4 = 0) SELECT user_id, start, round(list_sum(win) * (1 + 0.05 * sqrt(-2 * ln({UNIT(42, 'key')})) * cos(2 * 3.141592653589793 * {UNIT(43, 'key')})), 3) AS total FROM k")
def scaled_windows(spark, d):
    rows = windows(spark, d).withColumn("key", F.concat_ws("_", F.col("user_id").cast("string"), F.col("start").cast("string")))
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x)
    return augment.augment_windows(rows, "window", "key", "scaling").select("user_id", F.col("start").cast("long").alias("start"), F.round(total, 3).alias("total"))


@query("WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8) AS is_train, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS x FROM orders), m AS (SELECT median(x) AS m FROM t WHERE is_train) SELECT o_orderkey, round(coalesce(x, m), 6) AS x FROM t, m")
def fill_train_median(spark, d):
    rows = timeseries.chronological_split(read(spark, d, "orders"), "o_orderdate", "o_orderkey").withColumn("x", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    return rounded(timeseries.fill_train_median(rows, ["x"], exact=True).select("o_orderkey", "x"), "x")


@query(f"WITH {DELTAS}, q AS (SELECT user_id, min({SEC}) AS time_start, max({SEC}) AS time_end, round(median(delta), 4) AS delta_median, quantile_cont(delta, 0.95) AS p FROM g GROUP BY 1) SELECT q.user_id, round(time_start, 4) AS time_start, round(time_end, 4) AS time_end, delta_median, round(p, 4) AS delta_p95, (SELECT count(*) FROM g WHERE g.user_id = q.user_id AND delta > p) AS large_gaps FROM q")
def time_profile(spark, d):
    out = timeseries.time_profile(read(spark, d, "events"), "ts", ["user_id"], exact=True)
    return rounded(out, "time_start", "time_end", "delta_median", "delta_p95", places=4)


@query("WITH g AS (SELECT event_id, ts, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY ts, event_id) AS delta FROM events) SELECT event_id, (1 + sum((coalesce(delta, 0) > 600)::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM g")
def gap_segments_of_table(spark, d):
    """One series of the whole table."""
    return timeseries.gap_segments(read(spark, d, "events"), "ts", [], 600, "event_id").select("event_id", "segment")


@query("SELECT p_brand, CASE p_brand WHEN 'Brand#2' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END AS place FROM (SELECT DISTINCT p_brand FROM part)")
def ordered_names(spark, d):
    return rollups.ordered(read(spark, d, "part").select("p_brand").distinct(), "p_brand", ["Brand#2", "Brand#1"]).select("p_brand", F.col("place").cast("int").alias("place"))


@query("SELECT user_id, list_sort(list(value)) [1] AS least, count(*) AS n FROM events GROUP BY 1")
def tensor_rows(spark, d):
    """Rows of a group as one array, in order."""
    return models.tensor(read(spark, d, "events"), ["user_id"], "value", ["value"]).select("user_id", F.get("tensor", F.lit(0)).alias("least"), F.size("tensor").cast("long").alias("n"))


# ---- more scalars ----


@query("SELECT * FROM (VALUES ('l_extendedprice', 'regression'), ('l_returnflag', 'multiclass'), ('l_linenumber', 'multiclass')) AS t(target, problem)")
def problem_types(spark, d):
    rows = read(spark, d, "lineitem").withColumn("l_returnflag", F.col("l_returnflag"))
    return spark.createDataFrame([(c, profile.problem_type(rows, c)) for c in ("l_extendedprice", "l_returnflag", "l_linenumber")], "target string, problem string")


@query("SELECT * FROM (VALUES ('events', 'ts'), ('nation', NULL)) AS t(name, key)")
def temporal_keys(spark, d):
    return spark.createDataFrame([(n, profile.temporal_key(read(spark, d, n))) for n in ("events", "nation")], "name string, key string")


@query("SELECT 0 AS errors, 0 AS warnings, 'regression' AS problem_type")
def diagnosis(spark, d):
    found = profile.diagnose(read(spark, d, "orders"), "o_totalprice")
    return spark.createDataFrame([(len(found["errors"]), len(found["warnings"]), found["problem_type"])], "errors int, warnings int, problem_type string")


# ---- learners and random draws: rows only ----


@query()
def random_injection(spark, d):
    rows = items(spark, d)
    kept = selection.random_injection(rows, ITEMS, "y", regression=False)
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query()
def forest_importance(spark, d):
    return spark.createDataFrame(list(models.forest_importances(chain(spark, d), CHAIN, "y").items()), "feature string, importance double")


@query()
def learned_forecast(spark, d):
    rows = windows(spark, d)
    model = models.lag_forecast(rows, 16)
    lags = [f"lag{i}" for i in range(16)]
    out = models.predict(model, rows.select(*[F.get("window", F.lit(i)).alias(c) for i, c in enumerate(lags)], "y"), lags, "y")
    return models.regression_metrics(out)


# ---- nearest rows, completion, composite matching, exact splits ----


@query("""WITH d AS (SELECT a.p_partkey AS q, b.p_partkey AS p, (a.p_size::DOUBLE - b.p_size::DOUBLE) * (a.p_size::DOUBLE - b.p_size::DOUBLE) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) AS d2 FROM part a JOIN part b ON a.p_partkey <> b.p_partkey)
SELECT q, row_number() OVER (PARTITION BY q ORDER BY d2, p)::INT AS rank, p, round(d2, 6) AS d2 FROM d QUALIFY rank <= 5""")
def nearest_parts(spark, d):
    """The five parts nearest to each part by size and price."""
    part = read(spark, d, "part")
    x = F.array(F.col("p_size").cast("double"), "p_retailprice")
    return rounded(neighbours.nearest(spark, part.select(F.col("p_partkey").alias("q"), x.alias("x")), part.select(F.col("p_partkey").alias("p"), x.alias("x")), 5, exclude_same=True), "d2")


SPLIT_CUSTOMERS = "(SELECT *, '0x' || substr(md5('42:' || c_custkey::VARCHAR), 1, 12) AS h, count(*) OVER () AS n FROM customer)"
HELD = f"x AS (SELECT *, row_number() OVER (ORDER BY h::BIGINT, c_custkey) AS r FROM {SPLIT_CUSTOMERS}), t AS (SELECT *, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' WHEN r <= greatest(1, round_even(n * 0.2, 0)) + greatest(1, round_even(n * 0.1, 0)) THEN 'validation' ELSE 'train' END AS part FROM x)"


@query(f"WITH {HELD} SELECT c_custkey, part FROM t")
def exact_size_split(spark, d):
    return timeseries.exact_split(read(spark, d, "customer"), "c_custkey", {"train": 0.7, "test": 0.2, "validation": 0.1}).select("c_custkey", "part")


@query(f"""WITH {HELD}, d AS (SELECT a.c_custkey AS q, b.c_custkey AS p, b.c_acctbal AS y, (a.c_nationkey::DOUBLE - b.c_nationkey::DOUBLE) * (a.c_nationkey::DOUBLE - b.c_nationkey::DOUBLE) + (a.c_custkey::DOUBLE - b.c_custkey::DOUBLE) * (a.c_custkey::DOUBLE - b.c_custkey::DOUBLE) AS d2 FROM t a JOIN t b ON a.part = 'test' AND b.part = 'train'),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, p) <= 5) SELECT q AS c_custkey, round(avg(y), 6) AS prediction FROM k GROUP BY q""")
def neighbour_predictions(spark, d):
    """The learner on customers: balances of held-out ones from those of the five nearest by nation and key."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["c_nationkey", "c_custkey"], outputCol="features").transform(timeseries.exact_split(read(spark, d, "customer"), "c_custkey", {"train": 0.7, "test": 0.2, "validation": 0.1}))
    model = neighbours.KNeighbors("features", "c_acctbal", 5, key="c_custkey").fit(rows.where("part = 'train'"))
    return rounded(model.transform(rows.where("part = 'test'")).select("c_custkey", "prediction"), "prediction")


_HOLES = ("c_acctbal", "c_nationkey", "size")


def _near(c: str) -> str:
    """Rows without column c filled from the five nearest that have it, over the columns that both have."""
    both = [f"(a.{x} IS NOT NULL AND b.{x} IS NOT NULL)::INT" for x in _HOLES]
    total = " + ".join(f"coalesce((a.{x} - b.{x}) * (a.{x} - b.{x}), 0)" for x in _HOLES)
    n = " + ".join(both)
    return f"""{c}_d AS (SELECT a.c_custkey AS q, b.c_custkey AS p, b.{c} AS v, CASE WHEN {n} = 3 THEN {total} ELSE ({total}) * (3 / ({n})) END AS d2 FROM h a JOIN h b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND {n} > 0),
    {c}_f AS (SELECT q, avg(v) AS v FROM (SELECT * FROM {c}_d QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, p) <= 5) GROUP BY q)"""


@query(f"""WITH h AS (SELECT c_custkey, {", ".join(f"CASE WHEN {UNIT(20 + i, 'c_custkey::VARCHAR')} >= 0.1 THEN {x} END AS {c}" for i, (c, x) in enumerate(zip(_HOLES, ("c_acctbal", "c_nationkey::DOUBLE", "length(c_name)::DOUBLE + c_custkey"), strict=True)))} FROM customer),
{", ".join(_near(c) for c in _HOLES)}, m AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in _HOLES)} FROM h)
SELECT h.c_custkey, {", ".join(f"round(coalesce(h.{c}, {c}_f.v, m.{c}), 6) AS {c}" for c in _HOLES)} FROM h CROSS JOIN m {" ".join(f"LEFT JOIN {c}_f ON {c}_f.q = h.c_custkey" for c in _HOLES)}""")
def neighbour_imputation(spark, d):
    """Holes in three columns of the customers, filled from the nearest rows over what both have."""
    whole = (F.col("c_acctbal"), F.col("c_nationkey").cast("double"), (F.length("c_name") + F.col("c_custkey")).cast("double"))
    rows = read(spark, d, "customer").select("c_custkey", *[F.when(augment.unit(20 + i, F.col("c_custkey")) >= 0.1, x).alias(c) for i, (c, x) in enumerate(zip(_HOLES, whole, strict=True))])
    return rounded(neighbours.neighbour_impute(rows, list(_HOLES), 5, "c_custkey"), *_HOLES)


@query()
def centroid_imputation_error(spark, d):
    """Hourly counts, users, sums and squares of events with a tenth of the cells hidden: error of the line between neighbours, the mean, and the centroid decomposition."""
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    wide = read(spark, d, "events").where("ts is not null").groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_distinct("user_id").cast("double").alias("users"), F.sum("value").alias("total"), F.sum(F.col("value") ** 2).alias("squares"))
    kinds = ["n", "users", "total", "squares"]
    hide = {k: F.col(k).isNotNull() & (augment.unit(30 + i, F.col("hour")) < 0.1) for i, k in enumerate(kinds)}
    holes = wide.select("hour", *[F.when(~hide[k], F.col(k)).alias(k) for k in kinds], *[F.when(hide[k], F.col(k)).alias(f"truth_{k}") for k in kinds])
    out = None
    for method in ("linear", "mean", "centroid"):
        filled = timeseries.impute(holes, kinds, "hour", [], method)
        for k in kinds:
            one = timeseries.imputation_error(filled.select(F.col(k).alias("v"), F.col(f"truth_{k}").alias("truth")), "v").select(F.lit(method).alias("method"), F.lit(k).alias("series"), "n", "mae", "rmse")
            out = one if out is None else out.unionByName(one)
    return out


def _traits() -> str:
    """What column_traits measures of VALUE_COLUMNS."""
    parts = []
    for t, c in VALUE_COLUMNS:
        number, text = c not in TEXTS, c in TEXTS
        v = f"{c}::VARCHAR"
        parts.append(f"""SELECT '{t}' AS t, '{c}' AS c, any_value(typeof({c})) AS kind, '{'number' if number else 'text'}' AS family, count({c}) / count(*) AS filled, count(DISTINCT {c}) / count({c}) AS dist,
        {f"avg({c}::DOUBLE)" if number else "NULL"} AS mean, {f"stddev_pop({c}::DOUBLE)" if number else "NULL"} AS spread, {f"avg(length({v}))" if text else "NULL"} AS len,
        {f"sum(length(regexp_replace({v}, '[^0-9]', '', 'g'))) / sum(length({v}))" if text else "NULL"} AS digits, {f"sum(length(regexp_replace({v}, '[^[:alpha:]]', '', 'g'))) / sum(length({v}))" if text else "NULL"} AS letters FROM {t}""")
    return " UNION ALL ".join(parts)


TEXTS = [c for _, c in VALUE_COLUMNS if c.endswith(("name", "segment", "status", "priority"))]
_LIKE = ", ".join(f"CASE WHEN abs(a.{m}) + abs(b.{m}) = 0 THEN 1 ELSE 1 - abs(a.{m} - b.{m}) / (abs(a.{m}) + abs(b.{m})) END" for m in ("filled", "dist", "mean", "spread", "len", "digits", "letters"))


@query(f"""WITH {OVERLAP}, tr AS ({_traits()}), g AS (SELECT *, list_distinct(list_transform(range(1, length(c) + 2), lambda i: substr('  ' || c || ' ', i::INT, 3))) AS gs, string_split(c, '_') AS ws FROM tr),
pr AS (SELECT a.t AS left_table, a.c AS left_column, b.t AS right_table, b.c AS right_column, 2 * len(list_intersect(a.gs, b.gs)) / (len(a.gs) + len(b.gs)) AS name, len(list_intersect(a.ws, b.ws)) / len(list_distinct(a.ws || b.ws)) AS words,
  CASE WHEN a.kind = b.kind THEN 1.0 WHEN a.family = b.family THEN 0.7 ELSE 0.0 END AS kind, CASE WHEN a.family = b.family THEN list_avg(list_filter([{_LIKE}], lambda x: x IS NOT NULL)) END AS stat,
  coalesce(greatest(o.common / p.n, o.common / q.n), 0) AS vals
  FROM g a JOIN g b ON a.t < b.t LEFT JOIN o ON o.left_table = a.t AND o.left_column = a.c AND o.right_table = b.t AND o.right_column = b.c LEFT JOIN z p ON p.t = a.t AND p.c = a.c LEFT JOIN z q ON q.t = b.t AND q.c = b.c),
s AS (SELECT *, round((0.35 * name + 0.15 * words + 0.1 * kind + coalesce(0.15 * stat, 0) + 0.25 * vals) / (0.85 + CASE WHEN stat IS NULL THEN 0 ELSE 0.15 END), 6) AS score FROM pr),
c AS (SELECT * FROM s WHERE score >= 0.5),
w AS (SELECT *, score >= max(score) OVER (PARTITION BY left_table, left_column, right_table) - 0.05 AND score >= max(score) OVER (PARTITION BY right_table, right_column, left_table) - 0.05 AS within,
  row_number() OVER (PARTITION BY left_table, left_column, right_table ORDER BY score DESC, right_column) = 1 AND row_number() OVER (PARTITION BY right_table, right_column, left_table ORDER BY score DESC, left_column) = 1 AS chosen FROM c)
SELECT left_table, left_column, right_table, right_column, round(score, 5) AS score, chosen FROM w WHERE within""")
def composite_matches(spark, d):
    tables = _columns(spark, d)
    out = matching.composite_matches(tables, discovery.value_jaccard(discovery.all_values(tables)), 0.5, approximate=False)
    return rounded(out.select(*matching.KEY, "score", "chosen"), "score", places=5)


# ---- the graph of what the given tables share ----

FOUND = f"{OVERLAP}, e AS (SELECT left_table AS from_id, right_table AS to_id, left_column AS from_column, right_column AS to_column, round(common / (p.n + q.n - common), 6) AS weight FROM o JOIN z p ON p.t = left_table AND p.c = left_column JOIN z q ON q.t = right_table AND q.c = right_column), u AS (SELECT * FROM e UNION ALL SELECT to_id, from_id, to_column, from_column, weight FROM e)"


def found_edges(spark, d) -> DataFrame:
    """Columns of the given tables that share values, with their Jaccard."""
    pairs = discovery.value_jaccard(discovery.all_values(_columns(spark, d)))
    return pairs.select(F.col("left_table").alias("from_id"), F.col("right_table").alias("to_id"), F.col("left_column").alias("from_column"), F.col("right_column").alias("to_column"), F.round("jaccard", 6).alias("weight"))


@query(f"WITH {FOUND} SELECT from_id, to_id, from_column, to_column, CASE WHEN weight < 0.3 THEN round(weight * 3, 6) ELSE weight END AS weight FROM e")
def edge_upsert_max(spark, d):
    e = found_edges(spark, d)
    return rounded(graph.upsert(e, e.withColumn("weight", F.when(F.col("weight") < 0.3, F.col("weight") * 3).otherwise(F.col("weight") / 2))), "weight")


@query(f"WITH {FOUND} SELECT to_id AS node, max(weight) AS weight FROM u WHERE from_id = 'nation' AND to_id <> 'nation' GROUP BY 1")
def adjacent_tables(spark, d):
    return graph.adjacent(found_edges(spark, d), "nation")


@query(f"WITH RECURSIVE {FOUND}, r AS (SELECT 'orders' AS node, 0 AS hops UNION ALL SELECT to_id, hops + 1 FROM r JOIN u ON u.from_id = r.node WHERE hops < 3) SELECT node, min(hops)::INT AS hops FROM r WHERE node <> 'orders' GROUP BY 1")
def reachable_tables(spark, d):
    return graph.reachable(found_edges(spark, d), "orders", 3)


@query(f"WITH {FOUND} SELECT from_id AS node, count(DISTINCT to_id) AS degree FROM u GROUP BY 1")
def graph_degrees(spark, d):
    return graph.degrees(found_edges(spark, d))


@query(f"WITH {FOUND} SELECT * FROM e WHERE from_id = 'customer' AND to_id = 'orders'")
def edges_between(spark, d):
    return graph.between(found_edges(spark, d), "customer", "orders")


@query(f"WITH {FOUND} SELECT DISTINCT to_id AS node, from_column, to_column FROM u WHERE from_id = 'nation' AND weight = 1")
def key_neighbours(spark, d):
    return graph.key_neighbours(found_edges(spark, d), "nation")


@query(f"WITH {FOUND} SELECT from_id, count(*) AS n FROM e GROUP BY 1")
def edges_per_source(spark, d):
    return graph.edge_counts(found_edges(spark, d))


@query(f"WITH {FOUND} SELECT * FROM e WHERE weight >= 0.2 AND (from_id LIKE '%nation%' OR to_id LIKE '%nation%')")
def filtered_edges(spark, d):
    return graph.filtered(found_edges(spark, d), 0.2, "nation")


@query(f"WITH {FOUND} SELECT * FROM e WHERE contains(from_id, 'o') AND contains(to_id, 'o')")
def exported_edges(spark, d):
    return graph.export(found_edges(spark, d), "o")


@query(f"WITH {FOUND} SELECT id, CASE WHEN id IN (SELECT to_id FROM e) THEN upper(id) ELSE id END AS label FROM (SELECT from_id AS id FROM e UNION SELECT to_id FROM e)")
def node_upsert(spark, d):
    e = found_edges(spark, d)
    old = e.select(F.col("from_id").alias("id"), F.col("from_id").alias("label")).distinct()
    return graph.upsert_nodes(old, e.select(F.col("to_id").alias("id"), F.upper("to_id").alias("label")).distinct())


@query(f"WITH {FOUND} SELECT from_id, to_id, weight, CASE WHEN weight >= 0.5 THEN 'overlap' ELSE 'given' END AS method FROM e")
def graph_overlay(spark, d):
    e = found_edges(spark, d)
    return graph.overlaid(e.where("weight < 0.7"), e.where("weight >= 0.5"), "overlap").select("from_id", "to_id", "weight", "method")


# ---- names and settings that come from rows ----

_NAMES = ("time", "user_id", "lat95", "timer", "n", "shipped")
_PART = lambda i: f"[{', '.join(repr(n) for n in _NAMES)}][1 + {i} % {len(_NAMES)}]"


@query(f"SELECT DISTINCT l_returnflag || '__' || {_PART('l_linenumber')} AS name, {_PART('l_linenumber')} IN ('time', 'user_id', 'lat95', 'shipped') AS sensitive FROM lineitem")
def sensitive_names(spark, d):
    patterns = [*policy.SENSITIVE, *policy.policy_patterns(["time-private", "target-proxy-private"])]
    part = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (1 + F.col("l_linenumber") % len(_NAMES)).cast("int"))
    return read(spark, d, "lineitem").select(F.concat("l_returnflag", F.lit("__"), part).alias("name")).distinct().withColumn("sensitive", policy.sensitive(F.col("name"), patterns))


@query("""WITH k AS (SELECT event_id, list_transform(json_keys(props), lambda k: lower(k)) AS ks, event_type AS t FROM events),
p AS (SELECT event_id, list_filter(['time-private', 'workload-private', 'target-proxy-private'], lambda x: CASE x WHEN 'time-private' THEN len(list_filter(ks, lambda k: k = 'time' OR contains(k, 'time_'))) > 0 WHEN 'workload-private' THEN list_contains(ks, 'n') OR list_contains(ks, 'c') ELSE starts_with(t, 'lat') END) AS ps FROM k)
SELECT event_id, CASE WHEN len(ps) = 0 THEN 'none' ELSE array_to_string(ps, ',') END AS policies FROM p WHERE ps IS NOT NULL""")
def inferred_policies(spark, d):
    """Policies that the keys of each event's properties call for."""
    e = read(spark, d, "events").where("props is not null")
    return e.select("event_id", F.array_join(policy.inferred(F.json_object_keys("props"), F.col("event_type")), ",").alias("policies"))


_UNITS = ("", "s", "min", "ms", "us", "ns", "h", "d", "weeks")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, (l_quantity::INT - 5)::VARCHAR || [{', '.join(repr(u) for u in _UNITS)}][1 + l_orderkey % {len(_UNITS)}] AS text, l_quantity::INT - 5 AS n, [1.0, 1.0, 60.0, 1e-3, 1e-6, 1e-9, 3600.0, 86400.0, NULL][1 + l_orderkey % {len(_UNITS)}]::DOUBLE AS unit FROM lineitem)
SELECT l_orderkey, l_linenumber, text, CASE WHEN n >= 0 THEN round(n * unit, 9) END AS seconds FROM t""")
def tolerances(spark, d):
    rows = read(spark, d, "lineitem")
    text = F.concat((F.col("l_quantity").cast("int") - 5).cast("string"), F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (1 + F.col("l_orderkey") % len(_UNITS)).cast("int")))
    return rounded(rows.select("l_orderkey", "l_linenumber", text.alias("text")).withColumn("seconds", scalars.tolerance(F.col("text"))), "seconds", places=9)


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'XGBoost' WHEN 1 THEN 'RandomForest' ELSE o_orderpriority END AS name FROM orders")
def algorithm_names(spark, d):
    short = F.when(F.col("o_orderkey") % 3 == 0, "XGB").when(F.col("o_orderkey") % 3 == 1, "RF").otherwise(F.col("o_orderpriority"))
    return read(spark, d, "orders").select("o_orderkey", scalars.algorithm_name(short).alias("name"))


@query("SELECT p_name AS label, 'regression' AS dataset_type, coalesce(nullif(p_size, 7), 60)::BIGINT AS temporal_tolerance FROM part WHERE p_size % 2 = 1")
def dataset_registry(spark, d):
    """A registry written from the parts, read and filtered."""
    place = session.work_dir(spark, "registry")
    part = read(spark, d, "part")
    kind = F.when(F.col("p_size") % 2 == 1, "regression").otherwise("binary")
    rows = part.select(F.col("p_name").alias("base_table_label"), F.concat("p_name", F.lit(".csv")).alias("base_table_path"), F.col("p_name").alias("base_table_name"), F.lit("y").alias("target_column"), kind.alias("dataset_type"), F.nullif("p_size", F.lit(7)).alias("temporal_tolerance"))
    rows.write.option("header", True).csv(place)
    return columns.datasets(registry.read_registry(spark, place), problem="regression").select("label", "dataset_type", "temporal_tolerance")


@query("SELECT o_orderpriority AS approach, unnest(['high', 'low']) AS feature, round(unnest([max(o_totalprice), min(o_totalprice)]), 6) AS importance FROM orders GROUP BY 1")
def result_sinks(spark, d):
    """A result for each priority, written and read back."""
    groups = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).collect()  # five rows
    rows = [{"approach": r.o_orderpriority, "algorithm": "mean", "score": r.m, "n_features": r.n, "total_time": 0.0, "features": ["low", "high"], "importance": {"low": r.lo, "high": r.hi}} for r in groups]
    place = sinks.write_results(spark, rows, session.work_dir(spark, "results"), "x")
    return rounded(spark.read.parquet(place["features"]).select("approach", "feature", "importance"), "importance")


@query()
def residual_forecast(spark, d):
    """Errors of the residual stack and of the moving average on held-out windows of the events."""
    rows = windows(spark, d).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), F.col("start").cast("string")))
    rows = written(spark, timeseries.exact_split(written(spark, rows, "windows"), "key", {"train": 0.8, "test": 0.2}), "split")
    model = residual.fit(rows.where("part = 'train'"), 16, epochs=3)
    out = timeseries.naive_forecasts(model.predict(rows.where("part = 'test'")))
    return models.regression_metrics(out).withColumn("method", F.lit("residual_stack")).unionByName(models.regression_metrics(out, prediction="naive_moving_average").withColumn("method", F.lit("moving_average")))


@query()
def fixed_split_evaluation(spark, d):
    """Scores of four learners on one split of exact size."""
    rows = written(spark, chain(spark, d).select(*CHAIN, "y").withColumn("key", F.xxhash64(*CHAIN, "y")), "chain")
    rows = timeseries.exact_split(rows, "key", {"train": 0.8, "test": 0.2}).withColumn("is_train", F.col("part") == "train").drop("part", "key")
    rows = written(spark, rows, "split")  # read by each step of four fits
    out = [api.evaluate_split(rows, api.AugmentationConfig("y", algorithm=name), "BASE", True) for name in ("ExtraTrees", "KNeighbors", "BoostedTrees", "Ridge")]
    return spark.createDataFrame([(r["approach"], r["algorithm"], float(r["score"]), r["n_features"]) for r in out], "approach string, algorithm string, score double, n_features long")


@query()
def importance_by_permutation(spark, d):
    """How much a forest's score falls for each feature that is permuted."""
    model = models.fit(chain(spark, d), CHAIN, "y", "RandomForest")
    return spark.createDataFrame(list(models.permutation_importance(model, chain(spark, d), CHAIN, "y").items()), "feature string, importance double")


@query("""WITH r AS (SELECT o_orderpriority AS approach, CASE WHEN o_orderstatus <> 'F' THEN count(*) END AS n_features, o_orderstatus AS status FROM orders GROUP BY 1, 3),
c AS (SELECT o_orderpriority AS approach, o_orderstatus AS status, count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL)
SELECT r.approach, r.status, coalesce(r.n_features, c.n, 0) AS n_features FROM r LEFT JOIN c ON r.approach = c.approach AND r.status = c.status""")
def backfilled_counts(spark, d):
    """Results of which some lack a count, filled from the rows behind them."""
    rows = read(spark, d, "orders").withColumnsRenamed({"o_orderpriority": "approach", "o_orderstatus": "status"})
    results = rows.groupBy("approach", "status").agg(F.count(F.lit(1)).alias("n")).select("approach", "status", F.when(F.col("status") != "F", F.col("n")).alias("n_features"))
    return rollups.with_feature_counts(results, rows.where("status <> 'O'"), ["approach", "status"], "o_custkey")


@query(f"WITH {WINDOWS} SELECT user_id, start, 'naive_mean' AS method, round(list_sum(win) / 16, 6) AS prediction FROM w WHERE start % 4 = 0 UNION ALL SELECT user_id, start, 'naive_drift', round(win[16] + (win[16] - win[1]) / 15, 6) FROM w WHERE start % 4 = 0")
def forecast_sink(spark, d):
    """Forecasts written by method and read back."""
    place = sinks.write_forecasts(timeseries.naive_forecasts(windows(spark, d)), session.work_dir(spark, "forecasts"), "events", ["user_id"])
    return rounded(spark.read.parquet(place).where("method in ('naive_mean', 'naive_drift')").select("user_id", "start", "method", "prediction"), "prediction")
