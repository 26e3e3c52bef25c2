from loomgraph.operators import graph
from loomgraph.plans import ingest
from loomgraph.sources import parsers

SOURCE = '''package store

import (
	"fmt" // printing
	q "example.com/x/query"
)

// Skip(this)
type DB struct{ n int }

func helper(a interface{}, f func(int) error) int {
	s := "not(a) call" + `raw(
)`
	return len(s)
}

func (d *DB) Run(
	n int,
) error {
	if (n > 0) {
		fmt.Println(helper(n, nil))
		q.New(d).With(n).Done()
	}
	return d.close()
}

func (d *DB) close() error { return nil }
var x = outside()
'''


def test_go_calls_with_their_functions():
    rows = list(parsers.parse_go("a/db.go", SOURCE))
    assert [(r[2], r[4], r[5], r[6], r[7]) for r in rows if r[1] == "symbol"] == [
        ("type", "store.DB", "store", 9, 9), ("function", "store.helper", "store", 11, 15), ("function", "store.*DB.Run", "*DB", 17, 25), ("function", "store.*DB.close", "*DB", 27, 27), ("value", "store.x", "store", 28, 28)
    ]
    assert [r[3] for r in rows if r[1] == "import"] == ["fmt", "example.com/x/query"]
    assert [(r[3], r[4], r[6]) for r in rows if r[1] == "call"] == [
        ("len", "store.helper", 14), ("fmt.Println", "store.*DB.Run", 21), ("helper", "store.*DB.Run", 21),
        ("example.com/x/query.New", "store.*DB.Run", 22), ("q.New(d).With", "store.*DB.Run", 22), ("q.New(d).With(n).Done", "store.*DB.Run", 22), ("d.close", "store.*DB.Run", 24),
    ]


def test_an_indexed_go_tree_has_call_edges(spark, tmp_path):
    (tmp_path / "a.go").write_text("package app\n\nfunc Main() {\n\tload()\n}\n")
    (tmp_path / "b.go").write_text("package app\n\nfunc load() {\n}\n")
    found = ingest.index(spark, str(tmp_path))
    target = found.symbols.where("qualified_name = 'app.load'")
    assert found.edges.count() == 1
    assert [r.qualified_name for r in graph.callers(found.edges, target, found.symbols).collect()] == ["app.Main"]
