"""Every command, in this process, on small files."""

import json

import pytest

from joinscout import __main__ as cli
from joinscout.operators import discovery, rollups


@pytest.fixture
def lake(tmp_path):
    folder = tmp_path / "lake"
    folder.mkdir()
    (folder / "base.csv").write_text("id,key,y\n" + "".join(f"{i},{i % 20},{(i % 20) ** 2 + i % 3}\n" for i in range(200)))
    (folder / "other.csv").write_text("key,size\n" + "".join(f"{k},{k * k}\n" for k in range(20)))
    (folder / "connections.csv").write_text("fk_table,fk_column,pk_table,pk_column\nbase.csv,key,other.csv,key\n")
    return folder


def said(capsys, *args):
    capsys.readouterr()
    cli.main([str(a) for a in args])
    return capsys.readouterr().out


def test_commands_on_a_lake(spark, lake, tmp_path, capsys):
    assert json.loads(said(capsys, "diagnose", lake / "base.csv", "y"))
    text = said(capsys, "infer", lake, "--confidence", "0.5", "--out", tmp_path / "found")
    assert "base.key = other.key" in text and spark.read.option("header", True).csv(str(tmp_path / "found")).columns == ["fk_table", "fk_column", "pk_table", "pk_column"]
    assert json.loads(said(capsys, "plan", lake, "base", "--confidence", "0.5"))["tables"] == ["other"]
    assert "base.key = other.key" in said(capsys, "match", lake, "--threshold", "0.6")
    out = said(capsys, "augment", lake, "base", "y", "--connections", lake / "connections.csv", "--out", tmp_path / "wide", "--policy", "none")
    place = out.strip().splitlines()[-1]
    assert {"base__id", "y"} <= set(spark.read.parquet(place).columns) and spark.read.parquet(place).count() == 200
    swept = json.loads(said(capsys, "sweep", lake, "base", "y", "--connections", lake / "connections.csv", "--algorithm", "Ridge", "--most", "2", "--value-ratios", "0.9"))
    assert [r["approach"] for r in swept] == ["k=1", "k=2", "value_ratio=0.9"]
    assert len(json.loads(said(capsys, "ablate", lake, "base", "y", "--connections", lake / "connections.csv"))) == 4


def test_commands_on_tables(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("time,v\n" + "".join(f"{t},{'' if t == 20 else t}\n" for t in (0, 10, 20, 30, 500, 510)))
    cli.main(["segment", str(tmp_path / "t.csv"), str(tmp_path / "segments"), "--gap", "60"])
    assert sorted((r.time, r.segment) for r in spark.read.parquet(str(tmp_path / "segments")).collect()) == [(0, 1), (10, 1), (20, 1), (30, 1), (500, 2), (510, 2)]
    cli.main(["impute", str(tmp_path / "t.csv"), str(tmp_path / "filled")])
    assert {r.time: r.v for r in spark.read.parquet(str(tmp_path / "filled")).collect()}[20] == 20.0
    cli.main(["split", str(tmp_path / "t.csv"), "time", str(tmp_path / "parts"), "--part", "a=0.5", "--part", "b=0.5"])
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "parts")).groupBy("part").count().collect()) == [3, 3]
    (tmp_path / "registry.csv").write_text("base_table_label,base_table_path,base_table_name,target_column,dataset_type\na,x.csv,x,y,binary\nb,z.csv,z,y,regression\n")
    assert "z.csv" in said(capsys, "registry", tmp_path / "registry.csv", "--problem", "regression")


def test_report_and_backfill(spark):
    found = spark.createDataFrame([("a", "k", "b", "k", "exact", "exact_key", 0.9, None)], "left_table string, left_column string, right_table string, right_column string, relation_type string, join_role string, confidence double, recommended_tolerance_seconds int")
    assert discovery.report(found, discovery.recommend(found)).splitlines() == ["# Relationships", "", "- exact_key: 1", "", "# Recommended", "", "- a.k = b.k (exact_key, 0.90)"]
    results = spark.createDataFrame([("x", 3), ("y", None), (None, None), ("z", None)], "approach string, n_features int")
    features = spark.createDataFrame([("x", "f"), ("y", "f"), ("y", "g"), ("y", "g"), (None, "h")], "approach string, feature string")
    assert {(r.approach, r.n_features) for r in rollups.with_feature_counts(results, features, ["approach"], "feature").collect()} == {("x", 3), ("y", 2), (None, 1), ("z", 0)}
