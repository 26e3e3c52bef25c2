import json

import pytest
from pyspark.sql import functions as F

from loomgraph import agent, cli
from loomgraph.__main__ import answers, requests
from loomgraph.operators import inventory, quality, search, store
from loomgraph.plans import ingest, maintenance, scenarios
from loomgraph.service import Service
from loomgraph.sources import embed, sinks
from loomgraph.streaming import watch
from loomgraph.tools import TOOLS

TREE = {"pay/service.py": "def process():\n    charge()\n    refund()\n\ndef charge():\n    \"\"\"Takes money.\"\"\"\n    pass\n", "web/handler.py": "def checkout():\n    process()\n    ghost()\n", "tests/test_service.py": "def test_process():\n    process()\n", "two/a.py": "def refund():\n    pass\n", "three/a.py": "def refund():\n    checkout()\n"}


def tree(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    tree(root, TREE)
    indexed = ingest.index(spark, str(root))
    texts = indexed.symbols.select("id", F.concat_ws(" ", "name", "qualified_name", "doc_summary").alias("text"))
    vectors = embed.embed(texts, embed.hashing(32)).select("id", "embedding")
    return Service(indexed, str(tmp_path_factory.mktemp("log") / "events"), str(root), vectors, embed.hashing(32), lambda q: json.dumps({"tool": "graph_stats"} if not json.loads(q)["steps"] else {"answer": "done"})), root


def names(out, key="qualified_name"):
    assert out["ok"], out
    return [r[key] for r in out["data"]]


def test_every_tool_can_be_called(served):
    service, _ = served
    given = {
        "find_symbol": {"query": "process"}, "search_symbols": {"query": "process"}, "search_semantic": {"query": "process"}, "find_callers": {"symbol": "process"}, "find_callees": {"symbol": "process"}, "get_impact_radius": {"symbols": ["process"]}, "trace_dependencies": {"symbol": "checkout"}, "graph_analytics": {"analysis": "cycles"},
        "find_related_tests": {"symbol": "process"}, "context_for_task": {"task": "process"}, "session_log": {"event_type": "edit", "key": "a.py"}, "agentic_query": {"query": "?"}, "tool_search": {"query": "callers", "include_schema": True}, "tool_call": {"name": "graph_stats", "arguments": {}}, "update_graph": {}, "index_repo": {},
    }
    order = ["session_log", *[n for n in TOOLS if n not in ("session_log", "usage_stats")], "usage_stats"]
    assert len(order) == 32
    for name in order:
        out = service.call(name, **given.get(name, {}))
        assert out["ok"], (name, out)
    used = {r["tool"]: r for r in service.call("usage_stats")["data"]}
    assert used["graph_stats"]["calls"] >= 1 and {r["via"] for r in service.call("usage_stats")["data"]} == {"direct", "gateway"}
    assert [r["status"] for r in service.call("list_scans")["data"]] == ["completed"] * 3
    assert service.call("usage_stats", reset=True)["ok"] and len(service.calls) == 1


def test_evidence_of_unbound_names(served):
    service, _ = served
    # refund is declared twice, so no call is bound; its callers are known by the name
    assert names(service.call("find_callers", symbol="a.refund")) == ["service.process"]
    assert names(service.call("find_callees", symbol="process")) == ["a.refund", "a.refund", "service.charge"]
    out = service.call("get_impact_radius", files=["web/handler.py"], depth=1)
    assert names(out) == ["a.refund", "handler.checkout", "service.process"] and out["total"] == 3 and not out["truncated"]


def test_pages_tell_whether_there_is_more(served):
    service, _ = served
    first, rest = service.call("find_symbol", query="a", limit=1), service.call("find_symbol", query="a", limit=500, offset=1)
    whole = service.call("find_symbol", query="a", limit=500)
    assert first["truncated"] and not rest["truncated"] and first["data"] + rest["data"] == whole["data"]
    assert service.call("list_files", limit=2)["truncated"]
    lines = service.call("list_files", limit=2, format="compact")["data"]
    assert lines[0].startswith("@id\tpath") and len(lines) == 3
    assert not service.call("find_symbol", query="a", limit=51, detail="full")["ok"] and not service.call("find_symbol", query="a", detail="nothing")["ok"]
    got = service.call("find_symbol", query="charge", detail="excerpt")["data"]
    assert got[0]["text"].startswith("    charge()") and "Takes money." in got[0]["text"]


def test_a_cursor_goes_on_and_goes_stale(served):
    service, root = served
    whole = service.call("context_for_task", task="process refund charge", max_tokens=100_000)
    assert whole["total"] == len(whole["data"]) and "next_cursor" not in whole
    seen, cursor = [], None
    for _ in range(20):
        page = service.call("context_for_task", task="process refund charge", max_tokens=450, **({"cursor": cursor} if cursor else {}))
        assert page["ok"], page
        seen += [r["qualified_name"] for r in page["data"]]
        cursor, last = page.get("next_cursor"), cursor
        if not cursor:
            break
    assert seen == names(whole)
    if last:
        assert service.call("context_for_task", task="another", max_tokens=450, cursor=last)["error"] == "stale cursor"
    assert "nothing fits" in service.call("context_for_task", task="process", max_tokens=5)["error"]


def test_semantic_search_is_hybrid_with_vectors(served, spark):
    service, _ = served
    hit = service.call("search_semantic", query="charge", limit=3)["data"][0]
    assert hit["qualified_name"] == "service.charge" and sorted(hit["why"]) == ["text", "vector"]
    plain = Service(service.g)
    assert plain.call("search_semantic", query="charge")["data"][0]["why"] == ["token_overlap"]
    assert not plain.call("agentic_query", query="x")["ok"]


def test_a_scan_that_fails_is_told(served):
    service, root = served
    assert not service.call("index_repo", repo_root=str(root / "nowhere"))["ok"]
    assert "nowhere" in service.call("latest_scan_errors")["data"][0]["error_text"]
    service.root = str(root)
    assert len(service.call("list_repos")["data"]) == 2
    (root / "new.py").write_text("def fresh():\n    process()\n")
    told = service.call("update_graph")["data"][0]
    assert told["files_changed"] == 1 and "new.fresh" in names(service.call("find_callers", symbol="process"))
    (root / "new.py").unlink()
    assert service.call("update_graph", paths=["new.py"])["data"][0]["files_deleted"] == 1


def test_requests_of_any_shape(served):
    import io

    service, _ = served
    body = b'{"id": 7, "method": "tools/call", "params": {"name": "graph_stats"}}'
    stream = io.BytesIO(b"Content-Length: %d\r\n\r\n" % len(body) + body + b'\n{"id": 8, "method": "tools/call", "params": [1]}\n{"id": 9, "method": "tools/call", "params": {"name": "find_symbol", "arguments": {"name": 1, "query": "x"}}}\n{"id": 10, "method": "tools/call", "params": {"name": "find_symbol", "arguments": 5}}\n[]\n')
    got = [json.loads(x) for x in answers(service, requests(stream))]
    assert [g["id"] for g in got] == [7, 8, 9, 10, None] and got[0]["result"]["ok"] and got[1]["error"]["code"] == -32602 and not got[2]["result"]["ok"]


def test_agent_stops():
    assert agent.run(lambda q: "plain words", lambda n, **a: {}, "x") == {"answer": "plain words", "steps": []}
    out = agent.run(lambda q: '{"tool": "t", "arguments": 3}', lambda n, **a: {"ok": True, "data": "y" * 9000}, "x", 50)
    assert out["answer"] is None and len(out["steps"]) == agent.STEPS and all(len(s["observation"]) == agent.OBSERVATION for s in out["steps"])


def test_exports_of_a_focus_and_of_pages(spark):
    symbols = spark.createDataFrame([(k, f"q{k}", "class") for k in range(7)], "id long, qualified_name string, kind string")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (2, 1)], "src long, dst long")
    focus = json.loads(sinks.graph_json(symbols, edges, spark.createDataFrame([(1,)], "id long")).first().value)
    assert [s["id"] for s in focus["symbols"]] == [1] and [(e["src"], e["dst"]) for e in focus["edges"]] == [(0, 1), (1, 2), (2, 1)]
    seen, after = [], None
    while True:
        page = json.loads(sinks.graph_json(symbols, edges, after=after, limit=3).first().value)
        seen += [s["id"] for s in page["symbols"]]
        after = page.get("next")
        if after is None:
            break
    assert seen == list(range(7))
    page = sinks.html(symbols, edges)
    assert "canvas" in page and "requestAnimationFrame" in page


def test_watch_queues_changed_files(spark, tmp_path):
    tree(tmp_path / "src", {"a.py": "x", "node_modules/b.py": "x", "c.png": "x", "d/e.go": "x"})
    folders = [str(tmp_path / x) for x in ("queue", "check")]
    watch.watch(spark, str(tmp_path / "src"), *folders, once=True).awaitTermination(60)
    (tmp_path / "src" / "f.py").write_text("y")
    watch.watch(spark, str(tmp_path / "src"), *folders, once=True).awaitTermination(60)
    requests_ = watch.queued(spark, folders[0])
    assert sorted(r.path for r in requests_.collect()) == ["a.py", "d/e.go", "f.py"]
    none = spark.createDataFrame([], "path string, reason string, stamp long, claim long")
    queue = store.claim(store.enqueue(none, requests_.select("path", "reason", "stamp")), 5, 2)
    taken = queue.where("claim = 5").select("path", "stamp")
    assert taken.count() == 2 and store.finish(queue, taken).count() == 1
    # a path that changes while it is claimed waits again
    again = store.enqueue(queue, taken.limit(1).selectExpr("path", "'changed' as reason", "stamp + 1 as stamp"))
    assert store.finish(again, taken).where("claim is null").count() == 2


def test_compaction_and_doctor(spark, tmp_path, served):
    service, _ = served
    path = str(tmp_path / "table")
    spark.range(1000).repartition(20).write.parquet(path)
    made, told = maintenance.compact(spark, path, order=["id"])
    assert spark.read.parquet(made).count() == 1000 and told["files"] > told["files_after"]
    assert {r.status for r in maintenance.doctor(service.g).collect()} == {"ok"}


def test_smoke_of_index_and_config(spark):
    told = scenarios.index_smoke(spark, 5, {"full": 1.0, "unchanged": 1.0})
    assert set(told["seconds"]) == {"full", "unchanged", "one_changed"} and set(told["change_percent"]) == {"full", "unchanged"}
    assert store.Config.read(None) == store.Config() and store.Config.read('{"debounce_ms": 5}').debounce_ms == 5
    for bad in ('{"nothing": 1}', '{"languages": "go"}'):
        with pytest.raises(ValueError):
            store.Config.read(bad)
    assert store.Config.read(store.Config(languages=["go"]).text()).languages == ["go"]


def test_languages_and_patterns_of_a_config(spark, tmp_path):
    tree(tmp_path, {"a.py": "def f():\n    pass\n", "b.go": "package b\n", "gen/c.py": "x = 1\n", "big.py": "x" * 2000})
    config = store.Config(languages=["python"], exclude=["gen/**"], max_file_size_bytes=1000)
    assert [r.path for r in ingest.index(spark, str(tmp_path), config=config).files.collect()] == ["a.py"]


def test_costs_below_one_are_refused(spark):
    rows = spark.createDataFrame([(k, 0) for k in range(30)], "id long, cost long")
    with pytest.raises(Exception, match="at least 1"):
        search.within_budget(rows, ["id"], "cost", 5).collect()


def test_statuses_that_fail():
    assert quality.fails("warning", "warning") and not quality.fails("warning") and quality.fails("error") and not quality.fails("error", "none")
    with pytest.raises(ValueError):
        quality.fails("ok", "sometimes")


def test_usage_beyond_the_keys_is_one_row(spark):
    calls = spark.createDataFrame([(f"t{k}", k) for k in range(1, 21)], "tool string, size long")
    got = {r.tool: r.bytes for r in inventory.usage(calls, ["tool"], "size", keys=18).collect()}
    assert len(got) == 19 and got["overflow"] == 3


def test_commands_over_a_kept_index(spark, tmp_path):
    tree(tmp_path, {"a.py": "def one():\n    two()\n\ndef two():\n    pass\n", "tests/test_a.py": "def test_two():\n    two()\n"})
    root, said = str(tmp_path), []
    go = lambda *argv: (cli.run(spark, list(argv), said.append), said[-1])
    assert go("version") == (0, cli.VERSION) and go("help")[0] == 0
    assert go("find_callers", root, "--symbol", "two")[0] == 1 and json.loads(said[-1])["error"] == "repo not indexed"
    assert go("index", root)[0] == 0 and json.loads(said[-1])["files_seen"] == 2
    code, out = go("find_callers", root, "--symbol=two", "--limit", "5")
    assert code == 0 and [r["qualified_name"] for r in json.loads(out)["data"]] == ["a.one", "test_a.test_two"]
    (tmp_path / "a.py").write_text("def two():\n    pass\n")
    assert go("update-graph", root)[0] == 0 and json.loads(said[-1])["files_changed"] == 1
    assert [r["qualified_name"] for r in json.loads(go("find_callers", root, "--symbol", "two")[1])["data"]] == ["test_a.test_two"]
    assert json.loads(go("affected_tests", root, "--files", "a.py", "--files", "b.py")[1])["data"][0]["symbol"] == "test_a.test_two"
    assert go("audit", root, "--fail-on", "warning")[0] in (0, 1) and go("doctor", root)[0] == 0 and go("stats", root)[0] == 0
    assert "digraph" in go("graph", root, "--format", "dot")[1] and go("graph", root, "--symbol", "two")[0] == 0 and "canvas" in go("visualize", root)[1]
    assert json.loads(go("clean", root)[1]) == {"removed": 1} and go("stats", root)[0] == 0
    assert go("stats", root, "--nothing", "1")[0] == 1
    with pytest.raises(ValueError):
        cli.parse(["x", "--y"])
