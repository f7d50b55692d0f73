"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else str(x)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    columns = sorted(names)
    assert sorted(found.columns) == columns
    got = sorted(str([plain(r[c]) for c in columns]) for r in found.collect())
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())


def test_live_cursor_keeps_keys_out_of_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: got.append(rows := collect(df)) or rows)
    found = entry.queries()["live_cursor"](spark, SF)
    assert sum(map(len, got)) < 100 < found.count()


def test_live_cursor_that_finds_nothing(spark, duck, tmp_path):
    duck.execute(f"COPY (SELECT * FROM orders WHERE CAST(o_orderkey AS VARCHAR) >= '5') TO '{tmp_path}/orders.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.execute(entry.oracle_sql()["live_cursor"]).fetchall()
    assert entry.queries()["live_cursor"](spark, str(tmp_path)).count() == len(want) == 0
