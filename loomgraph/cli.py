"""Commands over a source tree whose index is kept in a folder: python -m loomgraph COMMAND ROOT [--name value ...]."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph import tools
from loomgraph.operators import graph, inventory
from loomgraph.plans import ingest, maintenance, scenarios
from loomgraph.service import Service
from loomgraph.sources import sinks
from loomgraph.streaming import watch

VERSION = "0.2"
#: Commands that are a tool by another name.
SAME = {"stats": "graph_stats", "affected_tests": "find_related_tests", "benchmark": "benchmark_tokens"}


def parse(argv: list[str]) -> tuple[str, str | None, dict]:
    """(command, root, arguments): values are JSON where they can be, else text; a name that comes again makes a list."""
    words, given, at = [], {}, 0
    while at < len(argv):
        if argv[at].startswith("--"):
            name, equals, value = argv[at][2:].partition("=")
            if not equals:
                at += 1
                if at >= len(argv):
                    raise ValueError(f"no value for --{name}")
                value = argv[at]
            try:
                value = json.loads(value)
            except ValueError:
                pass
            name = name.replace("-", "_")
            given[name] = value if name not in given else [*(given[name] if isinstance(given[name], list) else [given[name]]), value]
        else:
            words.append(argv[at])
        at += 1
    return (words[0].replace("-", "_") if words else "help"), (words[1] if len(words) > 1 else None), given


def _focus(found: ingest.Index, given: dict):
    """The nodes of a focus symbol's closure, or none for the whole graph."""
    if "symbol" not in given:
        return None
    seeds = inventory.lookup(found.symbols, given["symbol"]).select("id")
    return graph.closure(found.adjacent, seeds, int(given.get("depth", 2))).select("id").unionByName(seeds)


def run(spark: SparkSession, argv: list[str], show: Callable[[str], None] = print) -> int:
    """Run a command; 0, or 1 for an error or an audit that fails. --index names the folder of kept indexes, by default .loomgraph in the tree."""
    command, root, given = parse(argv)
    if command in ("help", "version"):
        show(VERSION if command == "version" else "\n".join(["commands: help version index update_graph index_smoke bench_queries doctor clean graph visualize watch serve config stats affected_tests benchmark", "tools: " + " ".join(sorted(n for n in tools.TOOLS if n not in tools.HIDDEN))]))
        return 0
    if command == "index_smoke":
        show(json.dumps(scenarios.index_smoke(spark, int(given.get("files", 200)), given.get("baseline"))))
        return 0
    if root is None:
        show("no tree given")
        return 1
    folder = given.pop("index", os.path.join(root, ".loomgraph"))
    try:
        if command == "clean":
            show(json.dumps({"removed": ingest.clean(spark, folder, int(given.get("keep", 1)))}))
            return 0
        if command == "index":
            found = ingest.index(spark, root)
            show(json.dumps({"saved": ingest.save(found, folder), **ingest.summary(found), "phases": found.phases}))
            return 0
        found = ingest.load(spark, folder)
        if command == "update_graph":
            paths = given.get("paths")
            found = ingest.update(spark, found, root, [paths] if isinstance(paths, str) else paths, bool(given.get("force", False)))
            show(json.dumps({"saved": ingest.save(found, folder), **ingest.summary(found), "phases": found.phases}))
            return 0
        if command == "doctor":
            told = [r.asDict() for r in maintenance.doctor(found).collect()]
            show(json.dumps(told))
            return int(any(r["status"] == "error" for r in told))
        if command in ("graph", "visualize"):
            symbols, edges = sinks.graph_rows(found.symbols, found.edges.select("src", "dst").distinct(), _focus(found, given))
            if command == "visualize":
                show(sinks.html(symbols, edges, int(given.get("limit", 500))))
            elif given.get("format") == "dot":
                show("\n".join(["digraph graph {", *[r["line"] for r in sinks.dot(symbols, edges).orderBy("part", "line").toLocalIterator()], "}"]))
            else:
                for r in sinks.json_lines(symbols, edges).toLocalIterator():
                    show(r["value"])
            return 0
        if command == "watch":
            query = watch.watch(spark, root, os.path.join(folder, "queue"), os.path.join(folder, "checkpoint"), once=bool(given.get("once", False)))
            query.awaitTermination()
            show(json.dumps({"queued": watch.queued(spark, os.path.join(folder, "queue")).select(F.countDistinct("path")).first()[0]}))
            return 0
        service = Service(found, os.path.join(folder, "events"), root)
        if command == "bench_queries":
            g = found.symbols
            show(json.dumps({name: scenarios.measure(lambda tool=tool, arguments=arguments: g.sparkSession.createDataFrame([(json.dumps(service.call(tool, **arguments), default=str),)], "out string"), int(given.get("runs", 3)), 1) for name, (tool, arguments) in {"graph_stats": ("graph_stats", {}), "list_files": ("list_files", {}), "dead_code": ("find_dead_code", {}), "architecture_overview": ("architecture_overview", {})}.items()}))
            return 0
        out = service.call(SAME.get(command, command), **given)
    except ValueError as e:
        show(json.dumps({"ok": False, "error": str(e)}))
        return 1
    show(json.dumps(out, default=str))
    return int(not out["ok"] or bool(out.get("failed")))
