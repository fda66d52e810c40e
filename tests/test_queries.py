"""Every query against its SQL on the smallest dataset."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for path in glob.glob(f"{smallest}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, records):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return Counter(str(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at)) for r in records)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in SQL if n in QUERIES))
def test_query_equals_sql(spark, duck, smallest, name):
    df = QUERIES[name](spark, smallest)
    got = rows(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cursor.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert {"page_id", "overall_score", "grade"} <= set(df.columns)
    assert df.count() > 0
