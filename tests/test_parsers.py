from loomgraph.operators import graph
from loomgraph.plans import ingest
from loomgraph.sources import parsers

JAVA = '''package a;
import java.util.List; // import no.such;
/* class Old {} */
public class Real extends Base {
  String s = "class Fake {";
  /** Runs it. */
  public void go(int x) throws E {
    if (x > 0) { helper(x); }
    this.other(List.of(1));
  }
  abstract int decl(String a);
}
'''
TYPESCRIPT = '''import { a } from './lib/a';
const x = require("y");
// function no() {}
export class K {
  run(a: number): void { go(a); if (a) { b.c(); } }
  private async two<T>(x: T): Promise<void> { await fetch(`class Q {`); }
}
export const f = async (q) => { g(q); };
interface I { m(): void }
'''
CPP = '''#include "util.h"
namespace ns {
struct S { int f(int a); };
int add(int a, int b);
int run(int x) { return add(x, 1) + ::glob(2) + s->f(3); }
}
int ns::S::f(int a) { return helper(a); }
'''
RUST = '''use std::io::{Read, Write};
pub struct P<'a> { x: &'a str }
impl<'a> P<'a> { pub fn new(x: &'a str) -> Self { helper(x); println!("fn no() {{"); Self::make(x) } }
fn main() { let c = '{'; P::new("a"); }
'''
RUBY = '''require 'json'
class A
  # def no
  def run(x)
    helper(x)
    s = <<~EOS
      def fake
    EOS
  end
end
'''
PYTHON = '''"""helper(x)
def g():
"""
s = "a#b"; real(s)
def top(a,
    b):
    """Doc here."""
    x = call(a,
b)
    return y.z(1)
class K:
    def m(self): pass
import os as o, sys
'''


def facts(path, source, parser=parsers.parse_heuristic):
    rows = list(parser(path, source))
    symbols = {r.qualified_name: (r.kind, r.container_name, r.line, r.end_line) for r in rows if r.fact == "symbol"}
    return symbols, [(r.name, r.qualified_name, r.line) for r in rows if r.fact == "call"], [r.name for r in rows if r.fact == "import"]


def test_java_skips_comments_and_strings_and_nests():
    symbols, calls, imports = facts("p/Real.java", JAVA)
    assert symbols == {"Real.Real": ("type", "Real", 4, 12), "Real.go": ("function", "Real", 7, 10), "Real.decl": ("function", "Real", 11, 11)}
    assert calls == [("helper", "Real.go", 8), ("this.other", "Real.go", 9), ("List.of", "Real.go", 9)]
    assert imports == ["java.util.List"]
    go = next(r for r in parsers.parse_heuristic("p/Real.java", JAVA) if r.name == "go")
    assert (go.doc, go.visibility, go.stable_key) == ("Runs it.", "public", "func:java:Real:go")


def test_typescript_methods_arrows_and_templates():
    symbols, calls, imports = facts("p/k.ts", TYPESCRIPT)
    assert symbols == {"k.K": ("class", "k", 4, 7), "k.K.run": ("method", "K", 5, 5), "k.K.two": ("method", "K", 6, 6), "k.f": ("function", "k", 8, 8), "k.I": ("interface", "k", 9, 9)}
    assert [c[:2] for c in calls] == [("go", "k.K.run"), ("b.c", "k.K.run"), ("fetch", "k.K.two"), ("g", "k.f")]
    assert imports == ["./lib/a", "y"]


def test_cpp_namespaces_declarations_and_members():
    symbols, calls, imports = facts("p/k.cpp", CPP)
    assert {q: s[0] for q, s in symbols.items()} == {"ns::S": "struct", "ns::add": "declaration", "ns::run": "function", "ns::S::f": "function"}
    assert [c[:2] for c in calls] == [("add", "ns::run"), ("::glob", "ns::run"), ("s.f", "ns::run"), ("helper", "ns::S::f")] and imports == ["util.h"]


def test_rust_and_ruby():
    symbols, calls, _ = facts("p/k.rs", RUST)
    assert {q: s[:2] for q, s in symbols.items()} == {"k.P": ("struct", "k"), "k.P.new": ("function", "P"), "k.main": ("function", "k")}
    assert [c[:2] for c in calls] == [("helper", "k.P.new"), ("Self::make", "k.P.new"), ("P::new", "k.main")]
    symbols, calls, imports = facts("p/k.rb", RUBY)
    assert symbols == {"k.A": ("class", "k", 2, 10), "k.A.run": ("function", "A", 4, 9)} and calls == [("helper", "k.A.run", 5)] and imports == ["json"]


def test_python_skips_docstrings_and_goes_on_over_lines():
    symbols, calls, imports = facts("p/m.py", PYTHON, parsers.parse_python)
    assert symbols == {"m.top": ("function", "m", 5, 10), "m.K": ("class", "m", 11, 12), "m.K.m": ("method", "K", 12, 12)}
    assert calls == [("real", "", 4), ("call", "m.top", 8), ("y.z", "m.top", 10)] and imports == ["os as o", "sys"]
    assert next(r for r in parsers.parse_python("p/m.py", PYTHON) if r.name == "top").doc == "Doc here."


def test_go_groups_and_ranges():
    symbols, calls, _ = facts("s.go", "package s\ntype (\n\tA struct{ x int }\n\tB interface {\n\t\tM(int) error\n\t}\n)\nconst (\n\tOne, Two = 1, 2\n)\nfunc (d *DB) Run(f func() interface{}) (int, error) { return d.x(f()), nil }\n", parsers.parse_go)
    assert {q: (s[0], s[2], s[3]) for q, s in symbols.items()} == {"s.A": ("type", 3, 3), "s.B": ("type", 4, 6), "s.One": ("value", 9, 9), "s.Two": ("value", 9, 9), "s.*DB.Run": ("function", 11, 11)}
    assert [c[0] for c in calls] == ["d.x", "f"]


def tree(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def bound(found):
    names = {r.id: r.qualified_name for r in found.symbols.collect()}
    return sorted((names[r.src], r.dst_name, names.get(r.dst), r.strategy) for r in found.calls.collect())


def test_a_go_tree_binds_by_package_and_by_import(spark, tmp_path):
    tree(tmp_path, {
        "go.mod": "module ex.org/m\n\ngo 1.22\n", "main.go": 'package main\n\nimport "ex.org/m/lib"\n\nfunc main() {\n\thelp()\n\tlib.Do(1)\n\tlib.Missing()\n}\n', "help.go": "package main\n\nfunc help() {}\n",
        "lib/do.go": "package lib\n\nfunc Do(n int) { inner() }\nfunc inner() {}\n", "other/do.go": "package other\n\nfunc Do(n int) {}\nfunc help() {}\n",
    })
    assert bound(ingest.index(spark, str(tmp_path))) == [
        ("lib.Do", "inner", "lib.inner", "go_package_scope"), ("main.main", "ex.org/m/lib.Do", "lib.Do", "module_import"), ("main.main", "ex.org/m/lib.Missing", None, None), ("main.main", "help", "main.help", "go_package_scope"),
    ]


def test_cpp_calls_bind_by_evidence(spark, tmp_path):
    tree(tmp_path, {
        "util.h": "namespace ns { int add(int a, int b); }\n", "util.cpp": '#include "util.h"\nnamespace ns { int add(int x, int y) { return x; } }\n', "far.cpp": "int far(int a) { return a; }\n",
        "main.cpp": '#include "util.h"\nnamespace ns {\nint local(int a) { return a; }\nint run(int x) { return add(x, 1) + local(2) + far(3); }\n}\nint out(int x) { return ns::add(1, 2) + add(1, 2); }\n',
    })
    assert bound(ingest.index(spark, str(tmp_path))) == [
        ("ns::run", "add", "ns::add", "exact_name"), ("ns::run", "far", None, None), ("ns::run", "local", "ns::local", "exact_name"), ("out", "add", None, None), ("out", "ns::add", "ns::add", "exact_qualified"),
    ]


def test_an_update_equals_a_new_index(spark, tmp_path):
    tree(tmp_path, {"a.py": "def alpha():\n    beta()\n    gamma()\n", "b.py": "def beta():\n    pass\n", "c.py": "def gamma():\n    alpha()\n", "tests/test_b.py": "def test_beta():\n    beta()\n"})
    first = ingest.index(spark, str(tmp_path))
    (tmp_path / "b.py").write_text("def beta2():\n    alpha()\n\ndef delta():\n    pass\n")
    (tmp_path / "c.py").unlink()
    tree(tmp_path, {"d.py": "def gamma():\n    delta()\n"})
    after, whole = ingest.update(spark, first, str(tmp_path)), ingest.index(spark, str(tmp_path))
    assert bound(after) == bound(whole)
    assert sorted(r.path for r in after.files.where("not is_deleted").collect()) == sorted(r.path for r in whole.files.collect())
    assert ingest.summary(after) == {"files_seen": 4, "files_changed": 2, "files_deleted": 1, "parse_failed": 0}
    assert sorted(map(tuple, after.test_links.select("test_symbol_id", "target_symbol_id", "target_file_id").collect())) == sorted(map(tuple, whole.test_links.select("test_symbol_id", "target_symbol_id", "target_file_id").collect()))
    # only these paths: one that is gone is deleted, all others stay
    (tmp_path / "a.py").unlink()
    (tmp_path / "d.py").write_text("def gamma2():\n    pass\n")
    scoped = ingest.update(spark, after, str(tmp_path), paths=["./a.py"])
    assert sorted(r.path for r in scoped.files.where("not is_deleted").collect()) == ["b.py", "d.py", "tests/test_b.py"]
    assert not any(name.startswith("d.gamma2") for name, *_ in bound(scoped))
    assert set(scoped.phases) == {"walk", "classify", "parse", "resolve", "tests"}


def test_containment_of_one_large_file_and_of_overlaps(spark):
    rows = [(k, 1, 1 + 3 * (k % 700), 1 + 3 * (k % 700) + (k * 7919) % 90) for k in range(2500)] + [(9000 + k, 2, k, 2 * 50_000 - k) for k in range(50_000)]
    s = spark.createDataFrame(rows, "id long, file_id long, start_line long, end_line long")
    got = {r.id: r.container for r in graph.members(s, s).collect()}
    small = [r for r in rows if r[1] == 1]
    for which, _, a, b in small:
        boxes = [(y - x, i) for i, _, x, y in small if i != which and x <= a and b <= y and (x < a or b < y)]
        assert got.get(which) == (min(boxes)[1] if boxes else None)
    assert all(got[9000 + k] == 9000 + k - 1 for k in range(1, 50_000))
    points = spark.createDataFrame([(1, x) for x in range(0, 2300, 7)], "file_id long, line long")
    for r in graph.attribute(points, s).collect():
        inside = [(x, -y) for _, _, x, y in small if x <= r.line <= y]
        best = [i for i, _, x, y in small if inside and (x, -y) == max(inside)]
        assert r.owner == (best[0] if len(best) == 1 else None)


def test_a_long_chain_and_two_rings(spark):
    chain = [(k, k + 1) for k in range(2000)]
    rings = [(5000, 5001), (5001, 5000), (2000, 6000), (6000, 6001), (6001, 6002), (6002, 6000), (6002, 7000)]
    pairs = spark.createDataFrame(chain + rings, "a long, b long")
    assert sorted(r.id for r in graph.files_on_cycles(pairs).collect()) == [5000, 5001, 6000, 6001, 6002]
    short = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 1), (6, 9), (9, 8), (8, 9)], "a long, b long")
    assert sorted(r.id for r in graph.files_on_cycles(short, local=1).collect()) == [1, 2, 3, 5, 6, 8, 9]
