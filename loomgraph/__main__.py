"""python -m loomgraph COMMAND ROOT ...: a command of ``cli``; serve ROOT, or ROOT alone, indexes a tree and answers JSON-RPC requests from standard input, one a line or framed by Content-Length."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from typing import IO

from pyspark.sql import SparkSession

from loomgraph import cli, tools
from loomgraph.plans import ingest
from loomgraph.service import Service


def requests(stream: IO[bytes]) -> Iterator[str]:
    """Messages of a stream: a line each, or a head with Content-Length and so many bytes."""
    while line := stream.readline():
        text = line.decode("utf-8", "replace")
        if not text.lower().startswith("content-length:"):
            yield text
            continue
        size = text.split(":", 1)[1].strip()
        while (line := stream.readline()).strip():
            pass
        yield stream.read(int(size)).decode("utf-8", "replace") if size.isdigit() else "rubbish"


def answers(service: Service, lines: Iterable[str]) -> Iterator[str]:
    """A response per request of tools/list, tools/call and tools/search; notifications get none, and no request ends the loop."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            method, parameters = request["method"], request.get("params") or {}
        except (ValueError, KeyError, TypeError):
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
            continue
        out: dict = {"jsonrpc": "2.0", "id": request.get("id")}
        arguments = parameters.get("arguments") or {} if isinstance(parameters, dict) else None
        if not isinstance(arguments, dict):
            out["error"] = {"code": -32602, "message": "parameters have to be objects"}
        elif method == "tools/list":
            out["result"] = {"tools": [{"name": n, "description": d, "arguments": tools.ARGUMENTS[n]} for n, (_, d) in sorted(tools.TOOLS.items()) if n not in tools.HIDDEN]}
        elif method == "tools/search":
            out["result"] = [{"name": n, "score": s} for n, s in tools.search(str(parameters.get("query", "")), parameters.get("limit", 5))]
        elif method == "tools/call":
            out["result"] = service.call(str(parameters.get("name", "")), **{str(k): v for k, v in arguments.items()})
        else:
            out["error"] = {"code": -32601, "message": "no such method"}
        if "id" in request:
            yield json.dumps(out, default=str)


def main() -> int:
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    given = sys.argv[1:]
    if len(given) != 1 and given[:1] != ["serve"]:
        return cli.run(spark, given)
    root = given[-1]
    for line in answers(Service(ingest.index(spark, root), root=root), requests(sys.stdin.buffer)):
        print(line, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
