"""What SQL doesn't reach: draws, thresholds, files, streams, plans and the programmatic surface."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import joinscout.queries as q
from joinscout.api import AugmentationConfig, ablation, augment_features
from joinscout.functions import policy
from joinscout.operators import augment, discovery, joins, models, profile, selection, stats
from joinscout.plans import graph, ingest, search
from joinscout.sources import lake, metadata

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_policies_block_prefixed_names_in_any_case(spark):
    patterns = policy.policy_patterns(["target-proxy-private"])
    assert [policy.is_sensitive(n, patterns) for n in ("kpi__lat95", "kpi__LAT95", "lat95", "kpi__mean", "latency", "kpi__latest")] == [True, True, True, True, False, False]
    assert policy.is_sensitive("user", ["re:^User$"]) and not policy.is_sensitive("a__users", ["column:user"])
    rows = spark.createDataFrame([(float(i % 7), float(i % 5), float(i)) for i in range(50)], "kpi__lat95 double, kpi__load double, y double")
    assert selection.select_features(rows, "y", 5, patterns).features == ["kpi__load"]


def test_noise_has_mean_and_covariance_of_the_rows(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "i int, a double, b double, c double, d double")
    draws = []
    for seed in range(300):
        out, names = selection.inject_noise(df, ["a", "b", "c", "d"], 0.25, seed)
        if seed == 0:
            assert len(names) == 1 and "__mean" not in out.columns
        import random

        r = random.Random(seed)
        z = np.array([r.gauss(0, 1) for _ in range(4)]) / 3**0.5
        draws.append(a.mean(1) + (a - a.mean(1, keepdims=True)) @ z)
        if seed < 3:
            got = [x[names[0]] for x in out.orderBy("i").collect()]
            assert np.allclose(got, draws[-1])
    assert np.allclose(np.mean(draws, 0), a.mean(1), atol=0.25) and np.allclose(np.cov(np.array(draws).T), np.cov(a), atol=0.5)


def test_thresholds_stop_when_the_score_falls():
    rounds = [[1, 1, 0], [1, 0, 0], [1, 1, 0], [1, 0, 0]]
    score = {("a", "b"): 0.5, ("a",): 0.9}
    assert selection.by_threshold(rounds, ["a", "b", "c"], [0.9, 0.2], lambda f: score[tuple(f)]) == ["a"]
    score[("a",)] = 0.1
    assert selection.by_threshold(rounds, ["a", "b", "c"], [0.2, 0.9], lambda f: score[tuple(f)]) == ["a", "b"]
    assert selection.by_threshold([], ["a"], [0.1], lambda f: 1.0) == []


@pytest.mark.parametrize("kind", ["jitter", "scaling", "time_mask", "magnitude_mask"])
def test_augmented_rows_are_drawn_with_replacement_and_masked_with_null(spark, kind):
    df = spark.range(4000).select("id", F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"), F.lit(7.0).alias("y"))
    out = augment.augment_rows(df, ["a", "b"], "id", kind, 0.5, 0.5)
    made = out.where("is_synthetic")
    n, most = made.count(), made.groupBy("id").count().agg(F.max("count")).first()[0]
    assert abs(n - 2000) < 150 and most > 1 and made.where("y <> 7").count() == 0
    nulls = made.where("a is null or b is null").count()
    assert nulls > 0 if "mask" in kind else nulls == 0


def test_asof_keeps_the_order_of_rows_and_has_no_job_of_its_own(spark):
    left = spark.createDataFrame([(0, 5), (1, None), (2, 1), (3, 9)], f"{joins.ROW} long, t long")
    right = spark.createDataFrame([(1, "a"), (6, "b")], "u long, v string")
    out = joins.asof_join(left, right, "t", "u", direction="nearest")
    assert [(r[joins.ROW], r.v) for r in out.collect()] == [(0, "b"), (1, None), (2, "a"), (3, "b")]
    same = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z")], "u long, v string")
    got = {tuple(r.v for r in joins.asof_join(left, same.repartition(n), "t", "u", direction="backward").where("t = 5").collect()) for n in (1, 2, 3)}
    assert len(got) == 1  # equal keys without an order are told apart the same way on every run


def test_redundancy_is_one_pass_over_pairs(spark):
    rows = spark.createDataFrame([tuple(float(i * k % 7) for k in (1, 2, 3, 4, 5)) for i in range(60)], "a double, b double, c double, d double, y double")
    few, many = (plan_of(stats.redundancy(rows, some, ["d"], "y", parity=False)).count("Generate") for some in (["a"], ["a", "b", "c"]))
    assert few == many


def test_default_profiles_have_no_exact_distinct_count(spark):
    df = spark.createDataFrame([(i, i % 3, 1, None) for i in range(100)], "a int, b int, c int, d int")
    assert "Expand" not in plan_of(profile.describe(df)) and "Expand" not in plan_of(discovery.column_profiles(df, "t"))
    got = {r.column: (r.n_unique, r.is_constant) for r in profile.describe(df).collect()}
    assert got["b"] == (3, False) and got["c"] == (1, True) and got["d"] == (0, True) and abs(got["a"][0] - 100) <= 10


def test_text_that_reads_as_numbers_is_compared_as_numbers(spark):
    a = spark.createDataFrame([(str(i) + ".0",) for i in range(9)] + [("n/a",)], "k string")
    b = spark.createDataFrame([(i,) for i in range(9)], "k long")
    assert discovery.value_jaccard(discovery.all_values({"a": a, "b": b})).first().jaccard == 1.0


def test_minhash_counts_the_jaccard(spark):
    tables = {"a": spark.range(0, 300).selectExpr("id as k"), "b": spark.range(60, 360).selectExpr("id as k"), "c": spark.range(5000, 5100).selectExpr("id as k")}
    got = discovery.minhash_edges(discovery.all_values(tables), 0.5).collect()
    assert [(r.left_table, r.right_table) for r in got] == [("a", "b")] and got[0].jaccard == 240 / 360


def test_discovery_feeds_the_graph_and_the_search(spark):
    base = spark.createDataFrame([(i, i % 20, float((i % 20) ** 2 + i % 3)) for i in range(200)], "id long, key long, y double")
    other = spark.createDataFrame([(k, float(k * k)) for k in range(20)], "key long, size double")
    lk = search.Lake({"base": base, "other": other}, graph.empty(spark), {"other": ["key"]})
    for method in ("hybrid", "minhash", "schema"):
        edges = ingest.discover(lk, 0.5, method).graph.collect()
        assert any({e.from_id, e.to_id} == {"base", "other"} and e.from_column == e.to_column == "key" for e in edges)
    out = augment_features("base", lk, AugmentationConfig("y", approaches=("BASE", "ARDA", "Search"), split_key="base__id"))
    assert {r["approach"] for r in out.results} == {"BASE", "ARDA", "Search"} and out.table.count() == 200


def test_text_columns_reach_the_learner(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"u{i}", float(i % 2) + i * 1e-4) for i in range(200)], "id long, kind string, name string, y double")
    ready, names = models.prepare(rows, "y", ("id",))
    assert names == ["kind"] and ready.columns == ["kind", "y", "id"]
    lk = search.Lake({"t": rows}, graph.edges(spark, [("t", "t", "id", "id", 1.0)]))
    out = augment_features("t", lk, AugmentationConfig("y", approaches=("BASE",), split_key="t__id"))
    assert out.results[0]["score"] > 0.9 and "t__kind" in out.results[0]["features"]


def test_ablation_runs(spark):
    out = ablation("orders", q.lake(spark, SF), AugmentationConfig("o_totalprice", split_key="orders__o_orderkey"), {"pearson": {"relevance": "pearson"}})
    assert [r["approach"] for r in out] == ["pearson"]


def test_arff_with_quoted_commas(spark, tmp_path):
    (tmp_path / "x.arff").write_text("% note\n@relation r\n@attribute a numeric\n@attribute 'b' string\n@data\n1,'x, y'\n2, b'z'\n")
    assert [tuple(r) for r in lake.read_arff(spark, str(tmp_path / "x.arff")).collect()] == [("1", "x, y"), ("2", "z")]


def test_files_to_one_row_each(spark, tmp_path):
    (tmp_path / "u1_s2.txt").write_text("1.5\n2.5\n")
    (tmp_path / "u2_s1.txt").write_text("3\n")
    out = lake.wide_from_files(spark, str(tmp_path), r"u(\d+)_s(\d+)\.txt", ["user", "sample"], width=2).orderBy("user").collect()
    assert [tuple(r) for r in out] == [("1", "2", 1.5, 2.5), ("2", "1", 3.0, None)]
    (tmp_path / "u3_s1.txt").write_text("\n".join(str(i) for i in range(250)) + "\n")
    whole = lake.wide_from_files(spark, str(tmp_path), r"u(\d+)_s(\d+)\.txt", ["user", "sample"])
    assert len(whole.columns) == 252 and whole.where("user = 3").first()["subcarrier_249"] == 249.0  # the longest file, whole
    with pytest.raises(ValueError, match="250"):
        lake.wide_from_files(spark, str(tmp_path), r"u(\d+)_s(\d+)\.txt", ["user", "sample"], width=2)


def test_manifest():
    assert metadata.parse_manifest("- label: a\n  target: y\n- label: b\n") == [{"label": "a", "target": "y"}, {"label": "b"}]


def test_streams(spark, tmp_path):
    from joinscout.streaming import events

    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 60), (3, "a", 90_000), (3, "a", 90_000), (4, "b", 5)], "id long, k string, s long").select("id", "k", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name, mode):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        job = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
        job.processAllAvailable()
        job.stop()
        return spark.table(name)

    assert run(lambda s: events.deduplicated(s, "ts", ["id"]), "once", "append").count() == 4
    table = spark.createDataFrame([("a", 1)], "k string, size int")
    assert run(lambda s: events.augmented(s, table, ["k"]), "wide", "append").where("size = 1").count() == 4
    assert run(lambda s: events.gap_sessions(s, "ts", ["k"]), "sessions", "complete").count() == 3
