"""Neighbours by ranks that are sent out, by joins, by a plain loop and by the SQL are the same."""

import os
import random

import duckdb
import pytest

from loomgraph.operators import graph
from tests.test_catalogue import SF
from tests.test_repeated_ids import check, folder  # noqa: F401

SYMBOLS = "id long, qualified_name string, start_line long"


def plain(edges, symbols, seeds, fanout):
    out = set()
    for side, a, b in (("caller", 1, 0), ("callee", 0, 1)):
        for seed in {e[a] for e in edges}:
            if seeds is None or seed in seeds:
                near = {e[b] for e in edges if e[a] == seed}
                ranked = sorted((s for s in symbols if s[0] in near), key=lambda s: (s[1] is None, s[1] or "", s[2] is None, s[2] or 0, s[0]))
                out |= {(seed, side, s[0], k + 1) for k, s in enumerate(ranked[:fanout])}
    return out


def rows(df):
    found = [tuple(r) for r in df.select("seed", "side", "id", "place").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("spread", [1, 10**12])
@pytest.mark.parametrize("local", [0, 10**6])
def test_neighbours_by_a_loop(spark, monkeypatch, local, spread):
    """Ids close together and far apart; of nulls, of several symbols, of none."""
    monkeypatch.setattr(graph, "HELD", 50)  # every batch is cut
    monkeypatch.setattr(graph, "SEED_BITS", 4)
    monkeypatch.setattr(graph, "SEEDS", 3)
    draw = random.Random(3)
    symbols = [(k * spread, draw.choice(["a", "b", "c", None]), draw.choice([1, 2, None])) for k in [*range(-20, 60), *range(10, 15), 10]]
    edges = [(draw.randrange(-25, 70) * spread, draw.choice([None, 7 * spread, 200 * spread, *(k * spread for k in range(-25, 70))])) for _ in range(2500)]
    edges += [(None, 5 * spread), (None, None)] + [(k * spread, d) for k in range(40) for d in (None, 200 * spread)]
    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([*symbols, (None, "a", 1)], SYMBOLS)
    assert rows(graph.seed_neighbours(e, None, s, 4, local)) == plain(edges, symbols, None, 4)
    for some in ([7], [*range(0, 90, 2)]):
        seeds = {k * spread for k in some}
        assert rows(graph.seed_neighbours(e, spark.createDataFrame([(k,) for k in seeds], "id long"), s, 4, local)) == plain(edges, symbols, seeds, 4)


def test_nothing(spark):
    none, some = spark.createDataFrame([], SYMBOLS), spark.createDataFrame([(1, "a", 1)], SYMBOLS)
    for edges, symbols in (([], some), ([(1, 2)], none)):
        assert graph.seed_neighbours(spark.createDataFrame(edges, "src long, dst long"), None, symbols).count() == 0


def test_edges_are_read_once_and_not_joined(spark):
    """At 290 million edges joining and sorting all pairs is beyond the time."""
    edges, symbols = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SYMBOLS)
    plan = graph.seed_neighbours(edges, None, symbols)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_sql_of_repeated_ids(spark, folder):  # noqa: F811
    check(spark, folder, "seed_neighbours")


def test_sql_of_odd_rows(spark, tmp_path):
    """Parts without a name, lines whose part is not there or null."""
    con = duckdb.connect()
    change = {
        "part": "SELECT * REPLACE (CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS p_name) FROM t WHERE p_partkey % 5 <> 0",
        "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_partkey END AS l_partkey, CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey) FROM t",
    }
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        con.execute(f"COPY (WITH t AS (SELECT * FROM '{SF}/{name}') {change.get(table, 'SELECT * FROM t')}) TO '{tmp_path}/{name}' (FORMAT parquet)")
    check(spark, str(tmp_path), "seed_neighbours")
