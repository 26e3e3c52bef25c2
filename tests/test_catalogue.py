import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(int(v)) if isinstance(v, bool) else "None" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_those_of_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    result = tables.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(tuple(plain(v) for v in r) for r in result.fetchall())
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    numeric = lambda rows: sorted(tuple(f"{float(v):.6f}" if v.replace(".", "", 1).replace("-", "", 1).isdigit() else v for v in r) for r in rows)
    assert numeric(rows) == numeric(want)


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 20
    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
