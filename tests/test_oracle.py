"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

import joinscout.queries as core

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if v != v else round(float(v), 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query(spark, db, name):
    got = core.QUERIES[name](spark, SF)
    want = db.sql(core.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert core.QUERIES[name](spark, SF).columns
