"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tesserine.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def canonical(rows):
    return sorted(repr([None if x != x else round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in queries.SQL:
        assert got
        return
    want = duck.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    assert canonical(got) == canonical(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_contract(spark):
    assert __spark_entry__.entry(spark).columns
    every = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(every)
    if __spark_entry__._llm is not None:
        assert {n.split("_")[0] for n in every if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in every
