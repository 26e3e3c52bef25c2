import json

import pytest

from loomgraph.__main__ import answers
from loomgraph.plans import ingest
from loomgraph.service import Service
from loomgraph.streaming import sessions

TREE = {
    "pay/service.py": "import django.http\n\ndef process():\n    charge()\n    log()\n\ndef charge():\n    log()\n",
    "util/hub.py": "def log():\n    pass\n",
    "web/handler.py": "def checkout():\n    process()\n    missing()\n\ndef unused():\n    pass\n",
    "tests/test_service.py": "def test_process():\n    process()\n",
    "native/log.go": "package native\nfunc Log() {\n}\n",
    ".git/config": "x",
}


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    events = str(tmp_path_factory.mktemp("log") / "events")
    for key in ("a.py", "b.py", "a.py"):
        sessions.log(spark, events, "edit", key, session_id="s")
    sessions.log(spark, events, "decision", "use joins")
    return Service(ingest.index(spark, str(root)), events)


def names(result, key="qualified_name"):
    assert result["ok"], result
    return [r[key] for r in result["data"]]


def test_index_binds_calls(service):
    stats = {r["metric"]: r["value"] for r in service.call("graph_stats")["data"]}
    assert stats == {"files": 5, "symbols": 7, "edges": 5, "language:go": 1, "language:python": 4}
    assert names(service.call("find_callers", symbol="log")) == ["service.charge", "service.process"]
    assert names(service.call("find_callees", symbol="checkout")) == ["service.process"]
    assert names(service.call("get_impact_radius", symbols=["log"], depth=3)) == ["handler.checkout", "hub.log", "service.charge", "service.process", "test_service.test_process"]
    assert names(service.call("trace_dependencies", symbol="checkout", depth=3)) == ["service.process", "hub.log", "service.charge"]


def test_other_tools(service):
    assert "handler.unused" in names(service.call("find_dead_code"))
    assert names(service.call("graph_analytics", analysis="pagerank", limit=1)) == ["hub.log"]
    assert names(service.call("graph_analytics", analysis="cycles"), "path") == []
    assert names(service.call("detect_frameworks"), "framework") == ["django"]
    assert names(service.call("list_files", path_filter="PAY/"), "path") == ["pay/service.py"]
    assert names(service.call("find_symbol", query="proc")) == ["service.process", "test_service.test_process"]
    assert names(service.call("search_semantic", query="charge"))[0] == "service.charge"
    assert service.call("audit")["data"] == []


def test_errors(service):
    assert service.call("nope")["error"] == "unknown tool: nope"
    assert service.call("find_callers", symbol="absent")["error"] == "symbol not found"
    for name, arguments in (("get_impact_radius", {"symbols": ["log"], "depth": 11}), ("find_symbol", {"query": "x", "limit": 501}), ("graph_analytics", {"analysis": "magic"}), ("find_symbol", {"wrong": 1})):
        assert not service.call(name, **arguments)["ok"]


def test_related_tests_and_context(service):
    got = service.call("find_related_tests", symbol="service.process")["data"]
    assert [(r["symbol"], r["reason"], r["score"]) for r in got] == [("test_service.test_process", "test_calls", 0.9)]
    assert service.call("find_related_tests", file="./pay/service.py")["data"] == got
    rows = service.call("context_for_task", task="charge process")["data"]
    assert [r["class"] for r in rows[:2]] == ["direct", "direct"] and {"hub.log", "handler.checkout"} <= {r["qualified_name"] for r in rows}
    few = service.call("context_for_task", task="charge process", max_tokens=60)["data"]
    assert few == rows[: len(few)] and sum(r["cost"] for r in few) <= 60 and len(few) < len(rows)
    assert not service.call("context_for_task", task="x", max_tokens=0)["ok"]
    assert service.call("cross_language_links")["data"] == []


def test_sessions(service):
    assert [(r["key"], r["n"]) for r in service.call("session_hot_files", session_id="s")["data"]] == [("a.py", 2), ("b.py", 1)]
    assert [r["key"] for r in service.call("session_history", event_type="decision")["data"]] == ["use joins"]
    assert [(r["event_type"], r["key"]) for r in service.call("session_context")["data"]] == [("decision", "use joins"), ("hot_file", "a.py"), ("hot_file", "b.py")]


def test_requests(service):
    lines = ['{"id": 1, "method": "tools/list"}', "", "rubbish", '{"id": 2, "method": "tools/call", "params": {"name": "find_callees", "arguments": {"symbol": "checkout"}}}', '{"method": "tools/list"}', '{"id": 3, "method": "x"}', '{"id": 4, "method": "tools/search", "params": {"query": "callers"}}']
    got = [json.loads(x) for x in answers(service, lines)]
    assert [g["id"] for g in got] == [1, None, 2, 3, 4]
    assert got[2]["result"]["data"][0]["qualified_name"] == "service.process" and "error" in got[3] and got[4]["result"][0]["name"] == "find_callers"
