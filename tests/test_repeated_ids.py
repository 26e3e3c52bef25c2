"""Ids that two symbols bear: parts whose keys reach the suppliers' ids, as they do in tables sixty times as large as sf0.1."""

import os
import random

import duckdb
import pytest

from loomgraph import queries
from loomgraph.operators import graph, inventory, store
from tests.test_catalogue import SF, plain

SHIFT = {"part": ["p_partkey"], "lineitem": ["l_partkey"]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """sf0.001 with every part and line a second time, a million keys further on."""
    out = str(tmp_path_factory.mktemp("repeated"))
    con = duckdb.connect()
    for name in os.listdir(SF):
        keys = SHIFT.get(name.removesuffix(".parquet"), [])
        moved = ", ".join(f"{k} + 1000000 AS {k}" for k in keys)
        again = f" UNION ALL SELECT * REPLACE ({moved}) FROM '{SF}/{name}'" if keys else ""
        con.execute(f"COPY (SELECT * FROM '{SF}/{name}'{again}) TO '{out}/{name}' (FORMAT parquet)")
    return out


def check(spark, folder, name):
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{table}'")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    want = sorted(tuple(plain(v) for v in r) for r in result.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["top_in_degree", "top_out_degree", "architecture_overview"])
def test_degrees(spark, folder, name):
    check(spark, folder, name)


@pytest.mark.parametrize("side", ["src", "dst"])
def test_places_of_repeated_ids(spark, side):
    other = "dst" if side == "src" else "src"
    edges = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (2, 7)], f"{side} long, {other} long")
    symbols = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 1), (3, "d", 1)], "id long, qualified_name string, start_line long")
    assert [tuple(r) for r in inventory.top_degree(edges, symbols, side, 3).collect()] == [(1, "a", 3), (1, "a", 3), (1, "b", 3)]
    assert sorted(tuple(r) for r in inventory.busiest(edges, symbols, side, 4).collect()) == [("a", 3), ("b", 3), ("c", 1), ("d", 0)]


def test_impact_of_files(spark, folder):
    check(spark, folder, "impact_of_files")


def test_symbol_members(spark, folder):
    check(spark, folder, "symbol_members")


def test_members_by_pairs(spark):
    """Random spans in which ids come again within a file and across files, against all pairs."""
    draw = random.Random(3)
    rows = [(draw.randrange(120), draw.randrange(4), a, a + draw.randrange(1, 40)) for a in (draw.randrange(60) for _ in range(400))]
    want = {}
    for i, f, a, b in rows:
        for j, g, c, d in rows:
            if f == g and i != j and c <= a and b <= d and (c, d) != (a, b):
                want[i] = min(want.get(i, (1000, 0)), (d - c, j))
    symbols = spark.createDataFrame(rows, "id long, file_id long, start_line long, end_line long")
    assert sorted(tuple(r) for r in graph.members(symbols, symbols).collect()) == sorted((i, j) for i, (_, j) in want.items())


def test_unbound_after_change(spark, folder):
    check(spark, folder, "unbound_after_change")


def test_calls_are_unbound_once(spark):
    calls = spark.createDataFrame([(1, 5, "x", "high"), (2, 6, "x", "high")], "src long, dst long, strategy string, confidence string")
    gone = spark.createDataFrame([(5,), (5,)], "id long")
    assert sorted(tuple(r) for r in store.unbind(calls, gone).collect()) == [(1, None, None, None), (2, 6, "x", "high")]
    links = spark.createDataFrame([(1, 2, 5, 3)], "test_file_id long, test_symbol_id long, target_symbol_id long, target_file_id long")
    assert [tuple(r) for r in store.unbind_tests(links, gone, spark.createDataFrame([(9,)], "file_id long")).collect()] == [(1, 2, None, 3)]
