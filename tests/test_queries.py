"""Every query with SQL gives that SQL's rows."""

import math

import duckdb
import pytest

from seedloom import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_matches_sql(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    found = duck.execute(engine.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, SF).count() > 0
