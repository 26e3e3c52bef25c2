"""Ranks by sums that are sent out, by joins, and by a plain loop, are the same."""

import random

import pytest

from loomgraph.operators import graph


@pytest.mark.parametrize("local", [0, 10, 1000])
def test_ranks_by_a_loop(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "CHUNK", 7)  # targets in many chunks
    draw = random.Random(5)
    rows = [(draw.randrange(0, 90, 3), draw.randrange(0, 120, 2)) for _ in range(300)] + [(3, 4)] * 5
    nodes = {x for r in rows for x in r}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        sums = dict.fromkeys(nodes, 0.0)
        for a, b in rows:
            sums[b] += rank[a] / sum(x == a for x, _ in rows)
        rank = {x: 0.15 / len(nodes) + 0.85 * s for x, s in sums.items()}
    edges = spark.createDataFrame([*rows, (None, 4), (3, None)], "src long, dst long")
    got = {r.id: r["rank"] for r in graph.pagerank(edges, local=local).collect()}
    assert got.keys() == nodes and all(abs(got[x] - rank[x]) < 1e-6 for x in nodes)


def test_a_round_takes_no_join(spark, monkeypatch):
    """At 290 million edges twenty joins and sums of all pairs are beyond the time."""
    monkeypatch.setattr(graph, "stash_by", lambda *a: pytest.fail("pairs were joined"))
    assert graph.pagerank(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 2
