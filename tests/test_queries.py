import os

import duckdb
import pandas as pd
import pytest
import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def same(spark, name, sql):
    got = entry.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(sql).df()
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    cell = lambda v: None if pd.isna(v) else v if isinstance(v, (str, bool)) else round(float(v), 9)
    rows = lambda d: sorted(repr([cell(v) for v in r]) for r in d[names].astype(object).values.tolist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("q_")])
def test_against_sql(spark, name):
    same(spark, name, entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
