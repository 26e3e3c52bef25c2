import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph import tools
from loomgraph.sources import embed, parsers, sinks, walk
from loomgraph.streaming import sessions


def test_walk_filters_and_hashes(spark, tmp_path):
    for name, body in {"a.py": "x = 1\n", "pkg/b.go": "package b\n", ".git/c": "no", "node_modules/d.js": "no", "img.PNG": "no", "gen/e.py": "no", "gen/keep.py": "y"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.path: r for r in walk.walk(spark, str(tmp_path), ["gen/*", "!keep.py"]).collect()}
    assert sorted(got) == ["a.py", "gen/keep.py", "img.PNG", "pkg/b.go"]
    assert got["img.PNG"].skip and not got["a.py"].skip
    import hashlib

    assert got["a.py"].sha256 == hashlib.sha256(b"x = 1\n").hexdigest()


SOURCE = """import os
from a.b import c

class K(Base):
    def one(self):
        helper(1)  # other(2)
        return os.path.join("x")

def top():
    def inner():
        pass
    inner()
top()
"""


def test_python_facts(spark):
    files = spark.createDataFrame([("m/x.py", bytearray(SOURCE.encode())), ("y.go", bytearray(b'import "fmt"\nfunc (s *S) Run() {\n}\nfunc Main() {\n')), ("bad.py", bytearray(b"\xff\xfe")), ("z.unknown", None)], "path string, content binary")
    rows = parsers.parse(files).collect()
    symbols = {(r.qualified_name, r.kind, r.line, r.end_line) for r in rows if r.fact == "symbol" and r.path == "m/x.py"}
    assert symbols == {("x.K", "class", 4, 7), ("x.K.one", "method", 5, 7), ("x.top", "function", 9, 12), ("x.top.inner", "function", 10, 11)}
    assert {(r.name, r.qualified_name) for r in rows if r.fact == "call"} == {("helper", "x.K.one"), ("os.path.join", "x.K.one"), ("inner", "x.top"), ("top", "")}
    assert {r.name for r in rows if r.fact == "import"} == {"os", "a.b", "fmt"}
    assert {(r.name, r.kind) for r in rows if r.path == "y.go" and r.fact == "symbol"} == {("Run", "function"), ("Main", "function")}


@pytest.mark.parametrize(("path", "line", "want"), [("a.java", "public class Foo {", ("Foo", "type")), ("a.kt", "fun go(x: Int) {", ("go", "function")), ("a.rs", "pub fn run() {", ("run", "function")), ("a.rb", "  def hi?", ("hi?", "function")), ("a.ts", "export const go = async (x) => {", ("go", "function")), ("a.swift", "protocol P {", ("P", "protocol")), ("a.php", "function f($x) {", ("f", "function")), ("a.cc", "int ns::run(int x) {", ("run", "function")), ("a.cs", "  public interface I {", ("I", "type"))])
def test_heuristic_parsers(path, line, want):
    assert [(r[3], r[2]) for r in parsers.parse_heuristic(path, line)] == [want]


def test_compact_round_trip(spark):
    cells = [("a\tb", "@x"), ("line\nend\r", "back\\slash\\n"), ("", "\\@")]
    df = spark.createDataFrame(cells, "a string, b string")
    lines = sinks.compact(df)
    assert all(r.line.count("\t") == 1 and "\n" not in r.line for r in lines.collect())
    assert sorted(tuple(r) for r in sinks.from_compact(lines, ["a", "b"]).collect()) == sorted(cells)


def test_exports(spark):
    symbols = spark.createDataFrame([(1, 'a"q', "function"), (2, "b", "function")], "id long, qualified_name string, kind string")
    edges = spark.createDataFrame([(1, 2, "b"), (2, None, "ext"), (2, None, "")], "src long, dst long, dst_name string")
    assert sorted(r.line for r in sinks.dot(symbols, edges).collect()) == ['  "a\\"q" -> "b";', '  "a\\"q";', '  "b" -> "ext" [style=dashed];', '  "b";']
    assert sorted(json.loads(r.value)["type"] for r in sinks.json_lines(symbols, edges).collect()) == ["edge"] * 3 + ["graph_done", "graph_meta", "symbol", "symbol"]
    page = sinks.html(symbols, edges)
    assert '"links": [{"src": 1, "dst": 2}]' in page


def test_tools():
    assert tools.search("find_callers")[0] == ("find_callers", 130)  # the exact name, and its first segment as a prefix
    assert tools.search("tests")[0] == ("find_related_tests", 70)
    assert tools.score("find_symbol", "search", "find symbols by name", "symbols") == 40 and len(tools.search("graph", 0)) == 1
    assert tools.check("depth", 10) == 10 and tools.envelope([1]) == {"ok": True, "data": [1]}
    with pytest.raises(ValueError):
        tools.check("depth", 11)
    state = {"repo": 1, "scan": 7, "task": "x", "offset": 30}
    text = tools.cursor(state)
    assert tools.read_cursor(text, {"scan": 7}) == 30
    for bad in (("nonsense", {}), (text, {"scan": 8})):
        with pytest.raises(ValueError):
            tools.read_cursor(*bad)


def test_changes_stream_into_snapshots(spark, tmp_path):
    schema = "path string, value long, stamp long"
    feed, table, check = (str(tmp_path / x) for x in ("feed", "table", "check"))
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], schema).write.parquet(feed)
    sessions.apply_changes(spark, feed, schema, check, table).awaitTermination(60)
    spark.createDataFrame([("b", 5, 3), ("c", 6, 3)], schema).write.mode("append").parquet(feed)
    sessions.apply_changes(spark, feed, schema, check, table).awaitTermination(60)
    assert sorted(tuple(r) for r in sessions.newest(spark, table, schema).collect()) == [("a", 2, 2), ("b", 5, 3), ("c", 6, 3)]
    assert sessions.newest(spark, str(tmp_path / "none"), schema).count() == 0


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    sessions.count_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "check"), str(tmp_path / "out")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0]
    total = events.count()
    assert 0.9 * total <= got <= total


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "red widget"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in embed.embed(rows, embed.hashing(8)).collect()}
    assert len(got[1]) == 8 and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] == got[3] == [0.0] * 8
    assert embed.embed(rows, None).count() == 0

    def broken(texts):
        raise OSError("no server")

    failed = embed.embed(rows, broken).collect()
    assert len(failed) == 3 and all(r.embedding is None and r.error == "OSError: no server" for r in failed)
    assert embed.refresh(embed.embed(rows, embed.hashing(8)), rows, broken).where("size(embedding) = 8").count() == 3
    stored = embed.embed(rows, embed.hashing(8))
    assert embed.refresh(stored, rows.where("id = 1"), embed.hashing(4)).where("size(embedding) = 4").count() == 1
