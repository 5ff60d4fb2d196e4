"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import KINDS, TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.execute(sql)
    types = {d[0]: str(d[1]) for d in rel.description}
    names = [d[0] for d in rel.description]
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == types
    assert got == rows_of(names, rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "num", "denom", "psa"]
    assert df.count() == 4
