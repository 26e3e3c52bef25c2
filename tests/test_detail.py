import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import accuracy, detail, identity, scans


def symbols(spark):
    rows = [
        (1, "python", "function", "load", "app.config.load"), (2, "python", "class", "Config", "app.Config"), (3, "python", "method", "close", "io.rows.Close"),
        (4, "kotlin", "class", "A", "m.A"), (5, "cpp", "function", "run", "ns::Job::run"), (6, "python", "function", "other", "config.load"), (7, "python", "function", "x", "x"),
    ]
    return spark.createDataFrame(rows, "id long, language string, kind string, name string, qualified_name string")


def test_identity_cascade(spark):
    asked = [("app.config.load", "python"), ("config.load", "python"), ("Config", "python"), ("x.Config", "python"), ("A", "kotlin"), ("zz.A", "kotlin"), ("Job::run", "cpp"), ("far.app.config.load", "python"), ("rows.close", "python"), ("none.Close", "python"), ("p/load", "python"), ("load", ""), ("", "python"), ("X", "python"), ("p/a.Config", "python")]
    got = {(r.name, r.language): set() for r in spark.createDataFrame(asked, "name string, language string").collect()}
    for r in identity.identity_cascade(spark.createDataFrame(asked + asked[:3], "name string, language string"), symbols(spark)).collect():
        got[r.name, r.language].add((r.stage, r.id))
    assert got == {
        ("app.config.load", "python"): {(1, 1)}, ("config.load", "python"): {(1, 6)}, ("Config", "python"): set(), ("x.Config", "python"): set(), ("A", "kotlin"): {(2, 4)}, ("zz.A", "kotlin"): set(),
        ("Job::run", "cpp"): {(3, 5)}, ("far.app.config.load", "python"): {(3, 1), (3, 6)}, ("rows.close", "python"): {(3, 3)}, ("none.Close", "python"): set(), ("p/load", "python"): set(), ("load", ""): set(), ("", "python"): set(),
        ("X", "python"): set(), ("p/a.Config", "python"): set(),
    }


def test_boundaries(spark):
    rows = [("a.b::c.d", "c.d"), ("xc.d", "c.d"), ("v/C.D", "c.d"), ("c.d", "c.d"), ("c.d", "")]
    got = spark.createDataFrame(rows, "n string, q string").select(text.extends_at_boundary(F.col("n"), F.col("q")).alias("e"), text.boundary_suffixes(F.col("n")).alias("s"), text.boundary_suffixes(F.col("n"), True).alias("t")).collect()
    assert [r.e for r in got] == [True, False, True, False, False]
    assert got[0].s == ["b::c.d", "c.d", "d"] and got[2].s == ["D"] and got[2].t == ["C.D", "D"]


def test_extending_callers(spark):
    calls = spark.createDataFrame([(1, "vendor/app.config.LOAD", "python"), (1, "vendor/app.config.LOAD", "python"), (2, "app.config.load", "go"), (3, None, "python")], "src long, dst_name string, language string")
    assert sorted(tuple(r) for r in identity.extending_callers(calls, symbols(spark)).collect()) == [(1, "vendor/app.config.LOAD", 1), (1, "vendor/app.config.LOAD", 6)]


def test_windows(spark):
    files = spark.createDataFrame([(1, "\n".join(f"l{k}" for k in range(1, 2001)) + "\n"), (2, "a\r\nb\r\n"), (3, ""), (4, None)], "file_id long, content string")
    spans = spark.createDataFrame([(10, 1, 5, 6), (11, 1, 1, 100), (12, 2, 2, 9), (13, 3, 1, 1), (14, 4, 1, 1), (15, 2, 3, 3), (16, 9, 1, 1), (17, 1, 2000, 0), (18, 1, 1, 1500)], "id long, file_id long, start_line int, end_line int")
    got = {r.id: r for r in detail.source_windows(spans, files).collect()}
    assert got[10].text == "\n".join(f"l{k}" for k in range(2, 10)) and not got[10].truncated
    assert (got[11].from_line, got[11].to_line, got[11].truncated) == (1, 60, True)
    assert (got[12].text, got[12].truncated) == ("a\nb", True)
    assert all(got[k].text is None and got[k].truncated is None for k in (13, 14, 15, 16))
    assert (got[17].from_line, got[17].to_line, got[17].truncated) == (1997, 2000, False)
    full = {r.id: r for r in detail.source_windows(spans, files, "full").collect()}
    assert (full[11].to_line, full[11].truncated, full[18].to_line, full[18].truncated) == (103, False, 1200, True)
    with pytest.raises(ValueError):
        detail.level("everything")


def test_skeletons_and_drift(spark):
    rows = [(1, 1, "class", "C", 1, 100)] + [(k, 1, "method", f"m{k}", k, k) for k in range(2, 52)] + [(60, 2, "class", "D", 1, 9), (61, 1, "function", "f", 99, 101)]
    s = spark.createDataFrame(rows, "id long, file_id long, kind string, name string, start_line int, end_line int")
    got = {r.id: r for r in detail.skeletons(s, s).collect()}
    assert got[1].member_count == 50 and got[1].members == [f"method m{k}" for k in range(2, 42)] and (got[60].member_count, got[60].members) == (0, [])
    state = "path string, size long, mtime long, sha256 string"
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x"), ("d", 1, 1, ""), ("e", 1, 1, "x")], state)
    new = spark.createDataFrame([("a", 1, 1, "y"), ("b", 2, 1, "x"), ("c", 1, 2, "y"), ("d", 1, 2, "y"), ("e", 1, 2, "x")], state)
    assert {r.path: r.drifted for r in detail.drifted(old, new).collect()} == {"a": False, "b": True, "c": True, "d": False, "e": False}


def test_scans(spark):
    table = spark.createDataFrame([(1, "running", ""), (2, "running", "boom"), (3, "completed", ""), (4, "running", "")], "id long, status string, error_text string")
    files = spark.createDataFrame([(1, "go", "indexed"), (1, "go", "deleted"), (1, "python", "parse_failed"), (2, "go", "skipped"), (3, "go", "indexed")], "scan_id long, language string, outcome string")
    done = scans.complete(table, scans.summaries(files), F.lit("2020-01-01").cast("timestamp"))
    assert {r.id: (r.status, r.files_seen, r.files_changed, r.files_deleted, r.finished_at is not None) for r in done.collect()} == {1: ("completed", 2, 2, 1, True), 2: ("failed", 1, 0, 0, True), 3: ("completed", 1, 1, 0, False), 4: ("running", None, None, None, False)}
    assert [r.id for r in scans.latest_errors(done).collect()] == [2]
    assert sorted(tuple(r) for r in scans.language_coverage(files).collect()) == [(1, "go", 1, 1, 0, 0), (1, "python", 1, 0, 0, 1), (2, "go", 1, 0, 1, 0), (3, "go", 1, 1, 0, 0)]
    assert scans.needs_full_scan(None, "a") and not scans.needs_full_scan("a", "a")


def test_accuracy(spark):
    cases = spark.createDataFrame([(k, e, ["t"]) for k, e in enumerate(["valid", "valid", "valid", "invalid", "unresolved", "ambiguous", "valid", "valid", "invalid"])], "case_id long, expect string, valid_targets array<string>")
    seen = spark.createDataFrame([(0, 0, "t"), (0, 1, "u"), (0, 2, None), (0, 3, None), (0, 4, None), (0, 5, "t"), (0, 7, "t"), (1, 7, None), (0, 8, "t")], "run int, case_id long, target string")
    got = {r.case_id: r.outcome for r in accuracy.case_outcomes(cases, seen).collect()}
    assert got == dict(enumerate(["expected_valid", "miswired", "missing_edge", "correctly_unresolved", "expected_unresolved", "miswired", "no_edge", "nondeterministic", "miswired"]))
    assert [tuple(r) for r in accuracy.unstable_edges(seen).collect()] == [(7, ["t", "unbound"])]
    assert accuracy.parity(seen, seen, ["case_id", "target"]).count() == 0
    assert [r.side for r in accuracy.parity(seen, seen.where("case_id <> 1"), ["case_id", "target"]).collect()] == ["full"]
