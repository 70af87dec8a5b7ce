import collections
import math

import pytest
from pyspark.sql import functions as F

import joinscout.queries as q
from joinscout.functions import policy, scalars
from joinscout.operators import profile, rollups, timeseries
from joinscout.plans import graph, paths, search
from joinscout.sources import lake, metadata, sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("value, want", [(60, 60.0), ("60", 60.0), ("5min", 300.0), ("200ms", 0.2), ("1h", 3600.0), ("1d", 86400.0), (-1, None), ("soon", None), (0, 0.0)])
def test_tolerance(value, want):
    got = scalars.tolerance_seconds(value)
    assert got == want or abs(got - want) < 1e-12


def test_policies():
    assert policy.is_sensitive("l_shipdate") and not policy.is_sensitive("load")  # ship holds ip
    assert policy.is_sensitive("t.time", ["column:time"]) and not policy.is_sensitive("timer", ["column:time"])
    with pytest.raises(KeyError):
        policy.policy_patterns(["nope"])
    assert policy.policy_patterns(["none", ""]) == [] and len(policy.policy_patterns(["all"])) == 12


def test_scalars(spark):
    df = spark.createDataFrame([("1.5m", "12 ms"), ("2gb", "x"), (None, None), ("", "1e3")], "a string, b string")
    out = df.select(scalars.unit_suffix_clean(F.col("a")).alias("a"), scalars.numeric_clean(F.col("b")).alias("b")).collect()
    assert [r.a for r in out] == [1.5e6, 2e9, None, None] and [r.b for r in out] == [12.0, None, None, 1000.0]


def test_paths():
    p = paths.extend("base", paths.Step("base", "k", "k", "t"))
    assert paths.parse(p) == ("base", [paths.Step("base", "k", "k", "t")]) and paths.length(p) == 1
    with pytest.raises(ValueError):
        paths.parse("base--a|b")
    steps = [paths.Step("a", "x", "x", "b"), paths.Step("b", "x", "x", "c"), paths.Step("a", "x", "x", "d")]
    assert paths.needed(steps, {"c"}) == steps[:2]
    assert paths.best_paths({"base": 5.0, p: 1.0}, 2) == [p]


def test_search_finds_the_useful_table(spark):
    base = spark.createDataFrame([(i, i % 5, float(i % 5) + 0.01 * (i % 3)) for i in range(100)], "id long, k long, y double")
    good = spark.createDataFrame([(i, float(i * i)) for i in range(5)], "k long, v double")
    bad = spark.createDataFrame([(99, 1.0)], "k long, w double")
    links = graph.edges(spark, [("base", "good", "k", "k", 1.0), ("base", "bad", "k", "k", 1.0)])
    lk = search.Lake({"base": base, "good": good, "bad": bad}, links)
    s = search.Settings("y", parity=False)
    found = search.search(lk, "base", s)
    best = search.top(found)[0]
    assert best.endswith("|good") and any(p.endswith("|bad") for p in found.refused)
    out = search.materialise(lk, best, ["good__v"], s)
    assert out.count() == 100 and out.columns == ["good__v", "y"]


def test_lake_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.csv").write_text('k,v\n1,"x"\n')
    (tmp_path / "in" / "b.csv").write_text("k,w\n1,2\n")
    (tmp_path / "connections.csv").write_text("pk_table,pk_column,fk_table,fk_column\nb.csv,k,a.csv,k\n")
    lk = lake.open_lake(spark, str(tmp_path), connections=str(tmp_path / "connections.csv"))
    assert sorted(lk.tables) == ["a", "b"]
    assert tuple(lk.graph.first()) == ("a", "b", "k", "k", 1.0)


def test_metadata():
    text = "Web servers\nfile(s): a.csv, b.csv\nThe information available is:\ntime: epoch seconds\n n: number of clients\n"
    assert metadata.parse_columns(text)["b.csv"] == {"time": "epoch seconds", "n": "number of clients"}
    assert metadata.parse_groups(text)["a.csv"]["group"] == "Web servers"


def test_append_replaces_runs(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "run_id string, time long, score double")
    sinks.append_upsert(spark, str(tmp_path / "runs"), rows(("a", 1, 0.1), ("b", 1, 0.2)))
    out = sinks.append_upsert(spark, str(tmp_path / "runs"), rows(("a", 1, 0.9), ("c", 2, 0.3)))
    assert sorted((r.run_id, r.score) for r in out.collect()) == [("a", 0.9), ("b", 0.2), ("c", 0.3)]


def test_gaps_and_windows(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in (0, 1, 2, 10, 11)], "e string, t long, v double")
    assert [r.segment for r in timeseries.gap_segments(df, "t", ["e"], 5).orderBy("t").collect()] == [1, 1, 1, 2, 2]
    assert [(r.t, r.missing) for r in timeseries.gap_report(df, "t", ["e"]).collect()] == [(10, 7)]
    w = timeseries.sliding_windows(df, "v", "t", ["e"], 2, 1, 1).orderBy("start").collect()
    assert [(list(r.window), r.y) for r in w] == [([0.0, 1.0], 2.0), ([1.0, 2.0], 10.0), ([2.0, 10.0], 11.0)]
    assert [r.t for r in timeseries.regular_grid(df, "t", ["e"], 5, ["v"]).orderBy("t").collect()] == [0, 1, 2, 5, 10, 11]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "e string, t long, v double")
    assert timeseries.gap_segments(e, "t", ["e"], 5).count() == 0
    assert timeseries.chronological_split(e, "t", "v").count() == 0
    assert profile.describe(e).where("n_rows = 0").count() == 3
    assert rollups.best_per_group(e, ["e"], "v", "t").count() == 0


def test_diagnose(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "time long, y long")
    out = profile.diagnose(df, "y")
    assert out["problem_type"] == "binary" and out["temporal_key"] == "time" and not out["errors"]
    assert profile.diagnose(df, "z")["errors"]


def test_api_runs(spark):
    from joinscout.api import AugmentationConfig, augment_features

    lk = q.lake(spark, SF)
    out = augment_features("orders", lk, AugmentationConfig("o_totalprice", approaches=("BASE", "Search"), split_key="orders__o_orderkey"))
    assert out.table.count() == lk.tables["orders"].count() and out.lift() is not None


def test_streaming_sessions(spark, tmp_path):
    from joinscout.streaming import events

    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = events.windowed(stream, "ts", ["event_type"], "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("w").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == rows.count()


def test_chronological_split_keeps_rows_without_a_time(spark):
    rows = [(i, i % 7 * 50_000) for i in range(50)] + [(100 + i, None) for i in range(30)]
    out = timeseries.chronological_split(spark.createDataFrame(rows, "id long, t long"), "t", "id").collect()
    want = {i for _, i in sorted((t, i) for i, t in rows if t is not None)[:40]}
    assert len(out) == 80 and {r.id for r in out if r.is_train} == want



def test_search_paths_ranks_on_all_rows(spark, tmp_path):
    n = 9000
    prices = [float(i * 7919 % n) + (500 if i % 10 > 6 else 0) for i in range(n)]
    frames = {
        "orders": ([(i, i % 10, prices[i]) for i in range(n)], "o_orderkey long, o_custkey long, o_totalprice double"),
        "customer": ([(k, f"c{k}", k * k + 0.5) for k in range(10)], "c_custkey long, c_name string, c_acctbal double"),
        "nation": ([(1, "n")], "n_nationkey int, n_name string"),
        "region": ([(1, "r")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.path: r.rank for r in q.QUERIES["search_paths"](spark, str(tmp_path)).collect()}

    def rho(x):
        place = []
        for v in (x, prices):
            low, high = {}, {}
            for k, a in enumerate(sorted(v)):
                low.setdefault(a, k)
                high[a] = k
            place.append([(low[a] + high[a] - n + 1) / 2 for a in v])
        a, b = place
        return abs(sum(s * t for s, t in zip(a, b, strict=True)) / (sum(s * s for s in a) * sum(t * t for t in b)) ** 0.5)

    def bins(x):
        lo, hi = min(x), max(x)
        return [min(int((v - lo) * 5 / (hi - lo)), 4) for v in x]

    def mutual(x, y):
        h = lambda v: -sum(c / n * math.log(c / n) for c in collections.Counter(v).values())
        return h(x) + h(y) - h(list(zip(x, y, strict=True)))

    balance = [(i % 10) ** 2 + 0.5 for i in range(n)]
    new, *own = (bins(x) for x in (balance, [float(i % 10) for i in range(n)], [float(i) for i in range(n)]))
    want = rho(balance) + mutual(new, prices) - sum(mutual(new, x) for x in own) / 2
    assert abs(next(r for p, r in got.items() if p.endswith("|customer")) - want) < 1e-6
