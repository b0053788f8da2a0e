"""Every query with SQL agrees with it on the smallest tables; the contract's functions are in order."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if n in entry.queries()]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    r = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    key = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, type(None))) else str(v)
    mine = sorted((tuple(key(x[c]) for c in sorted(cols)) for x in df.collect()), key=repr)
    theirs = sorted((tuple(key(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall()), key=repr)
    assert mine == theirs


def test_every_day_and_capture_counts(spark, tmp_path):
    stamps = ["20120131235959", "20120131000000", "20120202120000", "20240301000000", "20129999000000", "2012", None]
    spark.createDataFrame([(t,) for t in stamps], "timestamp string").write.parquet(f"{tmp_path}/capture_rows.parquet")
    got = {r.day: (r.captures, r.state) for r in entry.queries()["captures_by_every_day"](spark, str(tmp_path)).collect()}
    assert got["2012-01-31"] == (2, "captured") and got["2012-02-01"] == (0, "no_capture") and got["2024-03-01"] == (1, "captured")
    assert len(got) == 4414 and sum(n for n, _ in got.values()) == 4
