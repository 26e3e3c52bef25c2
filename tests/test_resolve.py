import itertools

from pyspark.sql import functions as F

from loomgraph.operators import resolve

SYMBOL = "id long, file_id long, language string, kind string, name string, qualified_name string, container_name string"


def graph(spark, files, symbols):
    """files {id: path}; symbols (id, file, language, kind, qualified, container)."""
    f = spark.createDataFrame(list(files.items()), "id long, path string")
    s = spark.createDataFrame([(i, file, lang, kind, q.replace("/", ".").rsplit(".", 1)[-1], q, box) for i, file, lang, kind, q, box in symbols], SYMBOL)
    return f, s


def bind(spark, files, symbols, calls, **more):
    f, s = graph(spark, files, symbols)
    c = spark.createDataFrame([(0 if len(x) < 4 else x[3], x[0], n, x[1], x[2]) for n, x in enumerate(calls)], "src long, file_id long, line long, language string, dst_name string")
    return {r.line: (r.dst, r.strategy, r.confidence, r.blocked) for r in resolve.resolve(c, s, f, **more).collect()}


def test_adversarial_set(spark):
    """Names that coincide across languages stay unbound; the declared targets bind."""
    files = {1: "src/py/caller.py", 2: "src/swift/SortKitA.swift", 3: "src/py/helpers_b.py", 4: "src/C.java", 5: "src/C.kt", 6: "src/c.rs", 7: "src/ShapesD.java", 8: "src/py/config_e.py", 9: "tests/test_config_e.py", 10: "src/go/caller_d.go"}
    symbols = [
        (20, 2, "swift", "function", "SortKitA.sorted", ""), (30, 3, "python", "function", "helpers_b.normalize_b", ""), (40, 4, "java", "method", "C.serialize_c", "C"), (50, 5, "kotlin", "function", "C.serialize_c", ""),
        (60, 6, "rust", "function", "c.serialize_c", ""), (70, 7, "java", "method", "ShapesD.Sorter.parse_d", "Sorter"), (80, 8, "python", "function", "config_e.load_config_e", ""), (90, 9, "python", "function", "test_config_e.load_config_e", ""),
    ]
    calls = [(1, "python", "sorted"), (1, "python", "normalize_b"), (1, "python", "serialize_c"), (10, "go", "Sorter.parse_d"), (1, "python", "load_config_e"), (1, "python", "no_such_symbol_f"), (9, "python", "load_config_e")]
    want = {0: (None, None, None, "language"), 1: (30, "exact_name", "high", None), 2: (None, None, None, "language"), 3: (None, None, None, None), 4: (80, "exact_name", "high", None), 5: (None, None, None, None), 6: (None, None, None, "ambiguity")}
    assert bind(spark, files, symbols, calls) == want
    for order in itertools.islice(itertools.permutations(symbols), 0, 5000, 1700):
        assert bind(spark, files, list(order), calls) == want


def test_strategies_in_turn(spark):
    files = {1: "a/x.py", 2: "b/y.py"}
    symbols = [
        (1, 1, "python", "function", "pkg/mod.alpha", ""), (2, 1, "python", "function", "m.n.beta", ""), (3, 1, "python", "function", "top.m.n.gamma", ""), (4, 1, "python", "function", "q.r.s.t.Delta", ""), (5, 1, "python", "declaration", "k.epsilon", "K"),
        (6, 2, "python", "class", "y.Zeta", ""), (7, 1, "python", "function", "x.twice", ""), (8, 2, "python", "function", "y.twice", ""),
    ]
    calls = [(2, "python", "pkg/mod.alpha"), (2, "python", "mod.alpha"), (2, "python", "n.beta"), (2, "python", "m.n.gamma"), (2, "python", "R.s.t.delta"), (2, "python", "epsilon"), (1, "python", "Zeta"), (2, "python", "Zeta"), (1, "python", "twice"), (1, "python", "y.twice")]
    got = bind(spark, files, symbols, calls)
    assert [got[k][:2] for k in range(10)] == [
        (1, "exact_qualified"), (1, "slash_suffix"), (2, "dot_tail2"), (3, "dot_tail3"), (4, "dot_suffix"), (5, "receiver_method"), (None, None), (6, "exact_name"), (None, None), (8, "exact_qualified"),
    ]
    assert got[8][3] == "ambiguity"


def test_go_package_scope_and_imports(spark):
    files = {1: "a/one.go", 2: "a/two.go", 3: "b/three.go", 4: "a/two_test.go"}
    symbols = [(1, 1, "go", "function", "a.Caller", ""), (2, 2, "go", "function", "a.Help", ""), (3, 3, "go", "function", "b.Help", ""), (4, 3, "go", "function", "b.Only", ""), (5, 4, "go", "function", "a.Help", "")]
    imports = spark.createDataFrame([(1, "ex.org/m/b"), (1, "other.org/x")], "file_id long, import_path string")
    modules = spark.createDataFrame([("ex.org/m", "")], "module string, folder string")
    calls = [(1, "go", "Help", 1), (1, "go", "Only", 1), (1, "go", "ex.org/m/b.Only", 1), (1, "go", "ex.org/m/b.None", 1), (1, "go", "other.org/x.Only", 1)]
    got = bind(spark, files, symbols, calls, imports=imports, modules=modules)
    assert [got[k][:2] for k in range(5)] == [(2, "go_package_scope"), (None, None), (4, "module_import"), (None, None), (None, None)]


def test_cpp_names_need_evidence(spark):
    symbols = [(1, 1, "cpp", "function", "ns.run", ""), (2, 1, "cpp", "function", "ns::go", "")]
    got = bind(spark, {1: "a.cpp"}, symbols, [(1, "cpp", "run"), (1, "cpp", "ns::go"), (1, "cpp", "ns.run")])
    assert [got[k][0] for k in range(3)] == [None, None, 1]


def test_incremental_equals_full(spark):
    files = {1: "a/x.py", 2: "b/y.py"}
    before = [(1, 1, "python", "function", "x.alpha", ""), (2, 2, "python", "function", "y.beta", "")]
    after = [*before, (3, 2, "python", "function", "y.alpha", ""), (4, 2, "python", "function", "y.gamma", "")]
    calls = [(1, 1, 0, "python", "alpha"), (1, 1, 1, "python", "beta"), (1, 1, 2, "python", "gamma")]
    c = spark.createDataFrame(calls, "src long, file_id long, line long, language string, dst_name string")
    f, s0 = graph(spark, files, before)
    _, s1 = graph(spark, files, after)
    old = resolve.resolve(c, s0, f)
    names = spark.createDataFrame([("y.alpha",), ("alpha",), ("y.gamma",), ("gamma",)], "name string")
    changed = spark.createDataFrame([(2,)], "file_id long")
    got = resolve.re_resolve(old, s1, f, names, changed)
    assert sorted(map(str, got.collect())) == sorted(map(str, resolve.resolve(c, s1, f).collect()))
    assert {r.line: r.dst for r in got.collect()} == {0: None, 1: 2, 2: 4}


def test_test_links_fall_back_to_the_sibling_file(spark):
    f, s = graph(spark, {1: "m/x.py", 2: "lib/p.go"}, [(1, 1, "python", "function", "x.go", ""), (2, 2, "go", "function", "p.Two", ""), (3, 2, "go", "function", "p.Two", "")])
    tests = spark.createDataFrame([(8, "lib/p_test.go"), (9, "m/test_x.py"), (7, "m/plain.py")], "id long, path string")
    links = spark.createDataFrame([(8, 80, "p.Two"), (9, 90, "x.go"), (7, 70, "x.go")], "test_file_id long, test_symbol_id long, target_key string").select("*", F.lit("name").alias("reason"), F.lit(0.7).alias("score"))
    got = {r.test_file_id: (r.target_symbol_id, r.target_file_id, r.reason) for r in resolve.bind_test_links(links, s, f, tests).collect()}
    assert got == {8: (None, 2, "test_file_name_match"), 9: (1, 1, "name")}


def test_rebuild_is_idempotent(spark):
    wanted = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    stored = spark.createDataFrame([(3, 4), (5, 6)], "src long, dst long")
    add, drop = resolve.rebuild(wanted, stored, ["src", "dst"])
    assert [tuple(r) for r in add.collect()] == [(1, 2)] and [tuple(r) for r in drop.collect()] == [(5, 6)]
    assert resolve.rebuild(wanted, wanted, ["src", "dst"])[0].isEmpty()
