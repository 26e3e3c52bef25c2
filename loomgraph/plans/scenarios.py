"""Twelve timed scenarios over a stored graph, with warm-up, percentiles and a budget; timed index runs against a baseline."""

from __future__ import annotations

import math
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import context, graph, inventory, resolve, search
from loomgraph.plans import fixture, ingest
from loomgraph.storage import stash

#: Runs, warm-up runs and the budget in milliseconds at the 95th percentile. Fixed values.
RUNS, WARM_UP, BUDGET_MS = 20, 3, 50


def stored(g: fixture.Graph) -> fixture.Graph:
    """The graph with every table written once, symbols in order of their ids and edges in order of either end, so that lookups read few row groups."""
    symbols = stash(g.symbols.repartitionByRange("id").sortWithinPartitions("id"), "symbols")
    edges = stash(g.edges.repartitionByRange("src").sortWithinPartitions("src"), "edges")
    rest = {name: stash(getattr(g, name), name) for name in ("files", "calls", "tests", "test_files", "test_links", "test_calls", "imports")}
    return fixture.Graph(symbols=symbols, edges=edges, **rest)


def targets(g: fixture.Graph) -> dict:
    """What the scenarios ask for, taken from the graph itself: the symbols with most edges into and out of them, and the test file with most links."""
    hub, source = (inventory.extreme_degree(g.edges, g.symbols, side).first() for side in ("dst", "src"))
    file = inventory.most_linked_test_file(g.test_links).first()
    return {"hub": hub["id"], "hub_name": hub["qualified_name"], "source": source["id"], "test_file": file["test_file_id"] if file else -1}


def scenarios(g: fixture.Graph) -> dict[str, Callable[[], DataFrame]]:
    """Name -> what gives its result; everything but the question itself is ready."""
    at = targets(g)
    adjacent = graph.Adjacency(ingest.in_order(g.edges, "src"), ingest.in_order(g.edges, "dst"))
    one = lambda which: g.symbols.where(F.col("id") == which)
    bound = stash(resolve.bind_test_links(g.test_links, g.symbols, g.files, g.test_files), "bound-links")
    order = ["qualified_name", "start_line", "id"]

    def task() -> DataFrame:
        direct = context.direct_hits(search.semantic(g.symbols, g.files, "red_widget brand1", 30), g.symbols, g.files)
        related = resolve.related_tests(bound, g.test_calls, g.tests, g.test_files, direct.select("id"))
        return search.rank_context(context.candidates(direct, g.symbols, g.files, adjacent, related), 10)

    return {
        "graph_stats": lambda: inventory.stats(g.files, g.symbols, g.edges),
        "list_files": lambda: inventory.list_files(g.files, "lib/", 20),
        "symbol_lookup": lambda: inventory.find_exact(g.symbols, at["hub_name"]),
        "symbol_search": lambda: inventory.page(search.search_symbols(g.symbols, "red_wid"), order, 20),
        "find_callers": lambda: inventory.page(graph.callers(adjacent, one(at["hub"]), g.symbols), order, 20),
        "find_callees": lambda: inventory.page(graph.callees(adjacent, one(at["source"]), g.symbols), order, 20),
        "related_tests": lambda: resolve.related_tests(bound, g.test_calls, g.tests, g.test_files, one(at["hub"])),
        "impact_radius": lambda: graph.impact(adjacent, g.symbols, one(at["hub"]), 2),
        "trace_dependencies": lambda: graph.trace(adjacent, one(at["source"]), "downstream", 3),
        "dead_code": lambda: inventory.dead_code(g.symbols, g.edges, g.files),
        "context_for_task": task,
        "architecture_overview": lambda: inventory.overview(g.files, g.symbols, g.edges),
        "search_semantic": lambda: search.semantic(g.symbols, g.files, "red_widget brand1", 20),
    }


def measure(run: Callable[[], DataFrame], runs: int = RUNS, warm_up: int = WARM_UP) -> dict:
    """Nearest-rank p50 and p95 and the slowest of ``runs`` in milliseconds, after ``warm_up`` that do not count; rows of the last."""
    taken, rows = [], 0
    for k in range(warm_up + runs):
        began = time.perf_counter()
        rows = len(run().collect()) if k == warm_up + runs - 1 else run().write.format("noop").mode("overwrite").save()
        if k >= warm_up:
            taken.append(1000 * (time.perf_counter() - began))
    taken.sort()
    at = lambda share: round(taken[max(0, math.ceil(share * len(taken)) - 1)], 1)
    return {"p50_ms": at(0.5), "p95_ms": at(0.95), "max_ms": round(taken[-1], 1), "rows": rows, "within_budget": at(0.95) <= BUDGET_MS}


def bench_queries(g: fixture.Graph, runs: int = RUNS, warm_up: int = WARM_UP) -> dict[str, dict]:
    return {name: measure(run, runs, warm_up) for name, run in scenarios(g).items()}


def index_smoke(spark: SparkSession, files: int = 200, baseline: dict[str, float] | None = None) -> dict:
    """Seconds of a full index of a made-up tree, of an update without changes and of one with a changed file; with a baseline also the differences in per cent."""
    with tempfile.TemporaryDirectory() as root:
        for k in range(files):
            with open(os.path.join(root, f"m{k}.py"), "w") as f:
                f.write(f"def f{k}():\n    f{(k + 1) % files}()\n")
        taken, found = {}, None
        for name in ("full", "unchanged", "one_changed"):
            if name == "one_changed":
                with open(os.path.join(root, "m0.py"), "a") as f:
                    f.write("\ndef added():\n    f0()\n")
            began = time.perf_counter()
            found = ingest.index(spark, root) if name == "full" else ingest.update(spark, found, root)
            found.calls.count()
            taken[name] = round(time.perf_counter() - began, 3)
    out: dict = {"seconds": taken}
    if baseline:
        out["change_percent"] = {k: round(100 * (v / baseline[k] - 1), 1) for k, v in taken.items() if baseline.get(k)}
    return out
