import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import graph, inventory, quality, search

#: A hub with eight callers, and a ring of three.
EDGES = [(k, 100) for k in range(8)] + [(200, 201), (201, 202), (202, 200)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src long, dst long")


@pytest.mark.parametrize("turn", range(3))
def test_pagerank_of_hub_and_ring(spark, turn):
    rows = EDGES[::-1] if turn == 1 else EDGES[5:] + EDGES[:5] if turn == 2 else EDGES
    got = {r.id: r["rank"] for r in graph.pagerank(edges(spark, rows)).collect()}
    assert got[100] == 0.0975 and got[0] == 0.0125 and got[200] == 0.083333
    assert round(sum(got.values()), 3) == 0.447


def test_cycles(spark):
    assert graph.cycles([("b", "c"), ("a", "b"), ("c", "a"), ("x", "a")], 10) == [["a", "b", "c", "a"]]
    assert graph.cycles([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], 1) == [["a", "b", "a"]]
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 1), (8, 8), (9, 10)]
    got = graph.files_on_cycles(spark.createDataFrame(rows, "a long, b long"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 5, 6]
    assert graph.files_on_cycles(spark.createDataFrame([(1, 2)], "a long, b long")).count() == 0


def test_closure_depths_and_bounds(spark):
    e = edges(spark)
    seeds = spark.createDataFrame([(200,)], "id long")
    assert {r.id: r.depth for r in graph.closure(e, seeds, 5, both=False).collect()} == {201: 1, 202: 2, 200: 3}
    assert graph.trace(e, seeds, "downstream", 5).count() == 2
    assert graph.closure(e, seeds, 0).count() == 0
    with pytest.raises(ValueError):
        graph.closure(e, seeds, 11)


def test_attribution_abstains_on_ties(spark):
    spans = spark.createDataFrame([(1, 10, 1, 100), (1, 11, 5, 20), (1, 12, 5, 20), (1, 13, 30, 40)], "file_id long, id long, start_line int, end_line int")
    points = spark.createDataFrame([(1, 7), (1, 35), (1, 90), (1, 500)], "file_id long, line int")
    assert {r.line: r.owner for r in graph.attribute(points, spans).collect()} == {7: None, 35: 13, 90: 10, 500: None}


def test_pages_tile_the_result(spark):
    df = spark.range(57)
    pages = [[r.id for r in inventory.page(df, ["id"], 10, k).collect()] for k in range(0, 60, 10)]
    assert sum(pages, []) == list(range(57))
    assert inventory.page(df, ["id"], 0, -5).count() == 20


def test_names(spark):
    rows = ["a/b.c.d", "x.y.z", "ns::Cls::fn", "plain", "end.", "a.b.c.d.e", "", "p/"]
    q = F.col("q")
    got = spark.createDataFrame([(r,) for r in rows], "q string").select("q", text.qualified_suffix(q), text.dot_tail2(q), text.dot_tail3(q), text.short_name(q), text.proper_suffixes(q)).collect()
    assert [tuple(r)[1:5] for r in got] == [("b.c.d", "c.d", "", "d"), ("", "y.z", "", "z"), ("", "", "", "fn"), ("", "", "", "plain"), ("", "", "", "end."), ("", "d.e", "c.d.e", "e"), ("", "", "", ""), ("", "", "", "p/")]
    assert got[1][5] == ["y.z", "z"] and got[3][5] == []


def test_test_files(spark):
    rows = {"a/x_test.go": True, "a/test_x.py": True, "x.spec.ts": True, "FooTest.java": True, "footest.java": False, "spec/a.rb": False, "a_spec.rb": True, "tests/a.txt": True, "latest/a.py": False, "a/TestData/x": True, "x_test.rs": True, "testing.go": False}
    got = spark.createDataFrame([(k,) for k in rows], "p string").select("p", text.is_test_file(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in got} == rows


def test_classification(spark):
    symbols = spark.createDataFrame([("open", "python")], "name string, language string")
    imports = spark.createDataFrame([(1, "os.path"), (1, "fmt"), (1, "net/http"), (1, "github.com/x/os")], "file_id long, import_path string")
    calls = [("python", "len", None, ""), ("python", "open", None, ""), ("python", "len", None, "a.len()"), ("python", "os.path.join", None, ""), ("go", "fmt.Println", None, ""), ("go", "net/http.Get", None, ""), ("go", "github.com/x/os.Y", None, ""), ("go", "x", 5, ""), ("", "x", None, "")]
    df = spark.createDataFrame([(k, 1, *c) for k, c in enumerate(calls)], "src long, file_id long, language string, dst_name string, dst long, evidence string")
    got = {r.src: r.target for r in quality.classify(df, symbols, imports).collect()}
    assert [got[k] for k in range(9)] == ["builtin", "unknown", "unknown", "stdlib", "stdlib", "stdlib", "unknown", "project", "unknown"]
    kinds = spark.createDataFrame([("node:fs",), ("fs/promises",), ("./a",), ("@/b",), ("@scope/c",), ("react",)], "s string").select(quality.typescript_target(F.col("s")).alias("t")).collect()
    assert [r.t for r in kinds] == ["stdlib", "stdlib", "unknown", "unknown", "external", "external"]
    imports = [(1, "java.util.List"), (1, "org.x.Util"), (2, "std::io::Read"), (2, "serde::Serialize"), (3, "node:fs"), (3, "react"), (3, "./lib/api.js"), (3, "lodash/fp"), (4, "java.a.Both"), (4, "org.Both")]
    calls = [(1, "java", "List.of"), (1, "java", "Util.go"), (1, "java", "javax.crypto.X"), (1, "java", "javax.inject.X"), (2, "rust", "Read::x"), (2, "rust", "Serialize::x"), (2, "rust", "std::mem::swap"), (3, "typescript", "fs.readFile"), (3, "typescript", "react.use"), (3, "typescript", "api.get"), (3, "typescript", "fp.map"), (4, "java", "Both.x")]
    df = spark.createDataFrame([(k, *c, None, "") for k, c in enumerate(calls)], "src long, file_id long, language string, dst_name string, dst long, evidence string")
    got = {r.src: r.target for r in quality.classify(df, symbols, spark.createDataFrame(imports, "file_id long, import_path string")).collect()}
    assert [got[k] for k in range(12)] == ["stdlib", "unknown", "stdlib", "unknown", "stdlib", "unknown", "stdlib", "stdlib", "external", "unknown", "unknown", "unknown"]


def test_normalized_imports(spark):
    rows = [("python", "a.b as c"), ("python", ".rel"), ("java", "static a.B.c"), ("rust", "a::{b, c::d as e, self}"), ("rust", "x::y"), ("go", "fmt")]
    got = spark.createDataFrame(rows, "l string, s string").select(text.normalize_imports(F.col("l"), F.col("s")).alias("n")).collect()
    assert [r.n for r in got] == [["a.b"], [], ["a.B.c"], ["a::b", "a::c::d", "a"], ["x::y"], ["fmt"]]
    assert text.join_relative(F.lit("a"), F.lit("b")) is not None
    paths = [("a/b/c.ts", "./d", "a/b/d"), ("a/b/c.ts", "../../x/y", "x/y"), ("a/c.ts", "../../x", None), ("a/c.ts", "pkg/x", None), ("c.ts", "./x", "x")]
    joined = spark.createDataFrame(paths, "p string, s string, w string").select(text.join_relative(F.col("p"), F.col("s")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in joined)


SOUND = {"id": 1, "src": 1, "dst": 2, "kind": "calls", "strategy": "exact_qualified", "confidence": "high"}


@pytest.mark.parametrize(
    ("broken", "codes"),
    [
        ({}, []), ({"dst": 99}, ["dangling_edge_target"]), ({"src": 99}, ["dangling_edge_source"]), ({"dst": None}, ["invalid_resolution_metadata"]), ({"strategy": "bogus"}, ["invalid_resolution_metadata"]), ({"confidence": "low"}, ["invalid_resolution_metadata", "low_confidence_resolution"]),
        ({"dst": 3}, ["implicit_cross_language_binding"]), ({"dst": 4}, ["resolved_target_deleted_file"]), ({"strategy": "", "confidence": ""}, ["resolved_missing_metadata"]), ({"kind": "cross_language_ref"}, ["cross_language_edge_implicit_strategy"]), ({"strategy": "dot_suffix", "confidence": "low"}, ["low_confidence_resolution"]),
    ],
)
def test_one_broken_field_one_finding(spark, broken, codes):
    files = spark.createDataFrame([(1, False), (2, True)], "id long, is_deleted boolean")
    symbols = spark.createDataFrame([(1, 1, "go"), (2, 1, "go"), (3, 1, "python"), (4, 2, "go")], "id long, file_id long, language string")
    df = spark.createDataFrame([tuple((SOUND | broken).values())], "id long, src long, dst long, kind string, strategy string, confidence string")
    found = quality.audit(df, symbols, files)
    assert sorted(r.code for r in found.collect()) == sorted(codes)
    assert all(r.examples == [1] for r in found.collect())
    errors = {"dangling_edge_target", "dangling_edge_source", "invalid_resolution_metadata", "implicit_cross_language_binding", "resolved_target_deleted_file"}
    assert quality.worst(found).first().status == ("ok" if not codes else "error" if errors & set(codes) else "warning")


def test_dangling_test_links(spark):
    ids = spark.createDataFrame([(1,)], "id long")
    links = spark.createDataFrame([(5, 1, 1, 1), (5, 9, 1, 1), (5, 1, 9, 1), (5, 1, None, 9)], "test_file_id long, test_symbol_id long, target_symbol_id long, target_file_id long")
    assert sorted(r.missing for r in quality.dangling_test_links(links, ids, ids, ids).collect()) == ["target_file", "target_symbol", "test_symbol"]


def test_search_terms_and_budget(spark):
    s = spark.createDataFrame([(1, "foo_bar", "m.foo_bar", "", "Makes it"), (2, "foobar", "m.foobar", "", ""), (3, "barfoo", "x.Y", "foo bars", "")], "id long, name string, qualified_name string, signature string, doc_summary string")
    ids = lambda q: sorted(r.id for r in search.search_symbols(s, q).collect())
    assert ids("foo_ba") == [1, 3] and ids("foo") == [1, 2, 3] and ids('"makes" foo') == [1] and ids("oob") == [] and ids("_") == [1]
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "id long, cost long")
    assert [r.id for r in search.within_budget(rows, ["id"], "cost", 10).collect()] == [1]
