"""Where call targets come from, which frameworks a repository uses, and whether its graph is sound."""

from __future__ import annotations

import builtins
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators.resolve import CONFIDENCE

#: Predeclared names of Go. Fixed values.
GO_BUILTINS = "append cap clear close complex copy delete imag len make max min new panic print println real recover any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr".split()
#: Roots of Go's standard library. Fixed values.
GO_STDLIB = "archive bufio bytes cmp compress container context crypto database debug embed encoding errors expvar flag fmt go hash html image index io iter log maps math mime net os path plugin reflect regexp runtime slices sort strconv strings structs sync syscall testing text time unicode unique unsafe weak".split()
PYTHON_BUILTINS = sorted(n for n in dir(builtins) if callable(getattr(builtins, n)) and (n == "__import__" or not n.startswith("_")) and n not in ("copyright", "credits", "license", "exit", "quit"))
PYTHON_STDLIB = sorted(n for n in sys.stdlib_module_names if not n.startswith("_"))

#: Name and import signature. Fixed values, in the order of the report.
FRAMEWORKS = [
    ("gin", "github.com/gin-gonic/gin"), ("echo", "github.com/labstack/echo"), ("fiber", "github.com/gofiber/fiber"), ("chi", "github.com/go-chi/chi"), ("django", "django"), ("flask", "flask"), ("fastapi", "fastapi"),
    ("express", "express"), ("react", "react"), ("next", "next"), ("vue", "vue"), ("angular", "@angular"), ("svelte", "svelte"), ("spring", "org.springframework"), ("rails", "rails"), ("laravel", "Illuminate"), ("symfony", "Symfony"), ("actix", "actix"), ("axum", "axum"),
]
SHADOWS = [("rails", "config/routes.rb"), ("laravel", "artisan")]


def classify(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """calls(src, file_id, language, dst_name, dst, evidence) with target: project, builtin, stdlib, external or unknown.

    Bound calls are project. A bare builtin name is builtin unless the project declares it
    in that language or the call site shows a receiver. Else the longest import of
    the file that is the name or a dotted prefix of it decides by its root (Go, Python), or
    the imports that end in its first part (Java, Rust, TypeScript).
    """
    own = symbols.select("name", "language").distinct().withColumn("declared", F.lit(True))
    c = calls.join(own, (calls.dst_name == own["name"]) & (calls.language == own["language"]), "left").select(calls["*"], "declared")
    name, evidence = F.col("dst_name"), F.coalesce("evidence", F.lit(""))
    candidate = text.bare(name) & (((F.col("language") == "go") & name.isin(*GO_BUILTINS)) | ((F.col("language") == "python") & name.isin(*PYTHON_BUILTINS)))
    received = evidence.contains(F.concat(F.lit("."), name)) | evidence.contains(F.concat(F.lit("->"), name)) | evidence.contains(F.concat(F.lit("::"), name))
    paths = imports.groupBy("file_id").agg(F.sort_array(F.collect_set("import_path")).alias("paths"))  # the imports of one file
    c = c.join(paths, "file_id", "left")
    fit = F.filter(F.coalesce("paths", F.array().cast("array<string>")), lambda p: (name == p) | name.startswith(F.concat(p, F.lit("."))))
    longest = F.aggregate(fit, F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    root = F.when(F.col("language") == "go", F.substring_index(longest, "/", 1)).otherwise(F.substring_index(longest, ".", 1))
    stdlib = ((F.col("language") == "go") & ~root.contains(".") & root.isin(*GO_STDLIB)) | ((F.col("language") == "python") & root.isin(*PYTHON_STDLIB))
    target = (
        F.when(F.col("dst").isNotNull(), "project")
        .when((name == "") | (F.col("language") == ""), "unknown")
        .when(candidate, F.when(F.col("declared").isNotNull() | received, "unknown").otherwise("builtin"))
        .when(stdlib, "stdlib")
        .otherwise(import_target(F.col("language"), name, F.coalesce("paths", F.array().cast("array<string>"))))
    )
    return c.withColumn("target", target).drop("declared", "paths")


#: Subtrees of javax that come with the JDK, crates of Rust's standard library, modules of Node's core. Fixed values.
JAVAX = "accessibility crypto imageio management naming net print script security sound sql swing tools xml".split()
RUST_STDLIB = ["std", "core", "alloc"]
NODE_CORE = (
    "assert assert/strict async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns dns/promises domain events fs fs/promises http http2 https inspector inspector/promises module net os path path/posix path/win32 "
    "perf_hooks process punycode querystring readline readline/promises repl stream stream/consumers stream/promises stream/web string_decoder timers timers/promises tls trace_events tty url util util/types v8 vm wasi worker_threads zlib"
).split()


def typescript_target(specifier: Column) -> Column:
    """Origin of a TypeScript import: core modules are stdlib, local forms and deep paths unknown, packages external."""
    package = specifier.rlike(r"^@[^/]+/[^/]+$") | (~specifier.contains("/") & ~specifier.startswith("@") & (specifier != ""))
    return F.when(specifier.startswith("node:"), "stdlib").when(specifier.rlike(r"^([./#~]|@/)"), "unknown").when(specifier.isin(*NODE_CORE), "stdlib").when(package, "external").otherwise("unknown")


def _in_jdk(path: Column) -> Column:
    return path.rlike(r"^(java|javax\.(" + "|".join(JAVAX) + r"))\.")


def import_target(language: Column, name: Column, paths: Column) -> Column:
    """Origin of a name by the imports whose last part is its first, for Java, Rust and TypeScript; unknown if they disagree or there are none."""
    local = F.substring_index(name, ".", 1)

    def verdicts(last, head, verdict):
        kinds = F.array_distinct(F.transform(F.filter(paths, lambda p: (last(p) == head) & (head != "")), verdict))
        return F.when(F.size(kinds) == 1, F.get(kinds, 0)).otherwise("unknown")

    java = F.when(_in_jdk(name), "stdlib").otherwise(verdicts(lambda p: F.substring_index(p, ".", -1), local, lambda p: F.when(_in_jdk(p), "stdlib").otherwise("unknown")))
    crate = F.substring_index(name, "::", 1)
    rust = F.when(crate.isin(*RUST_STDLIB), "stdlib").otherwise(verdicts(lambda p: F.substring_index(p, "::", -1), crate, lambda p: F.when(F.substring_index(p, "::", 1).isin(*RUST_STDLIB), "stdlib").otherwise("unknown")))
    binding = lambda p: F.regexp_replace(F.substring_index(F.regexp_replace(p, "^node:", ""), "/", -1), r"(.)\.[^.]*$", "$1")
    typescript = verdicts(binding, local, typescript_target)
    return F.when(language == "java", java).when(language == "rust", rust).when(language == "typescript", typescript).otherwise("unknown")


def frameworks(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(framework, evidence, confidence): files with an import that contains the signature, over the files with imports, within 0.1 and 1."""
    spark = files.sparkSession
    specs = F.broadcast(spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(FRAMEWORKS)], "place int, framework string, signature string"))
    ends = F.broadcast(spark.createDataFrame(SHADOWS, "framework string, ending string"))
    hits = imports.select("file_id", "import_path").distinct().join(specs, F.col("import_path").contains(F.col("signature"))).select("framework", "file_id")
    by_file = files.join(ends, (F.col("path") == F.col("ending")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("ending")))).select("framework", F.col("id").alias("file_id"))
    total = imports.agg(F.greatest(F.countDistinct("file_id"), F.lit(1)).alias("total"))
    found = hits.unionByName(by_file).distinct().groupBy("framework").agg(F.count("*").alias("evidence"))
    share = F.col("evidence") / F.col("total")
    return found.join(F.broadcast(total)).select("framework", "evidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), share)), 6).alias("confidence"))


#: Code and severity of the rules on edges, errors first.
RULES = [
    ("dangling_edge_target", "error"), ("dangling_edge_source", "error"), ("invalid_resolution_metadata", "error"), ("implicit_cross_language_binding", "error"), ("resolved_target_deleted_file", "error"),
    ("resolved_missing_metadata", "warning"), ("low_confidence_resolution", "warning"), ("cross_language_edge_implicit_strategy", "warning"),
]


def edge_findings(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """edges(id, src, dst, kind, strategy, confidence) with an array ``codes`` of the rules each breaks."""
    live = files.select(F.col("id").alias("file_id"), F.coalesce("is_deleted", F.lit(False)).alias("deleted"))
    s = symbols.join(live, "file_id", "left").select("id", F.col("language"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    e = edges.join(s.select(F.col("id").alias("src"), F.col("language").alias("src_language"), F.lit(True).alias("src_known")), "src", "left")
    e = e.join(s.select(F.col("id").alias("dst"), F.col("language").alias("dst_language"), F.col("deleted").alias("dst_deleted"), F.lit(True).alias("dst_known")), "dst", "left")
    strategy, confidence = F.coalesce("strategy", F.lit("")), F.coalesce("confidence", F.lit(""))
    bound = F.col("dst").isNotNull()
    cross = strategy.startswith("cross_language_")
    expected = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[strategy]
    wrong = F.when(~bound & ((strategy != "") | (confidence != "")), True).when((strategy != "") & expected.isNull(), True).when((strategy == "") != (confidence == ""), True).when((strategy != "") & (confidence != expected), True).otherwise(False)
    differ = (F.col("src_language") != F.col("dst_language")) & (F.col("src_language") != "") & (F.col("dst_language") != "")
    tests = [
        bound & F.col("dst_known").isNull(), F.col("src_known").isNull(), wrong, bound & (strategy != "") & ~cross & differ, bound & F.col("dst_deleted"),
        bound & (strategy == "") & (confidence == ""), bound & (confidence == "low"), (F.col("kind") == "cross_language_ref") & ~cross & (strategy != ""),
    ]
    codes = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), code) for (code, _), t in zip(RULES, tests, strict=True)]), lambda x: x.isNotNull())
    return e.select(*edges.columns, codes.alias("codes"))


def audit(edges: DataFrame, symbols: DataFrame, files: DataFrame, examples: int = 5) -> DataFrame:
    """(code, severity, n, examples): findings that occur, with the first ids of each."""
    severity = F.create_map(*[F.lit(x) for kv in RULES for x in kv])
    found = edge_findings(edges, symbols, files).where(F.size("codes") > 0).select("id", F.explode("codes").alias("code"))
    counts = found.groupBy("code").agg(F.count("*").alias("n"))
    first = found.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("place") <= examples).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("examples"))
    return counts.join(first, "code", "left").select("code", severity[F.col("code")].alias("severity"), "n", F.coalesce("examples", F.array().cast("array<long>")).alias("examples"))


def summary(files: DataFrame, symbols: DataFrame, calls: DataFrame, test_links: DataFrame) -> DataFrame:
    """(metric, n): files, deleted ones, symbols, edges, bound and unbound ones, test links, and unbound calls by a name that some symbol bears."""
    deleted = F.count_if(F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in files.columns else F.lit(0).cast("long")
    named = symbols.select(F.col("name").alias("dst_name")).distinct().withColumn("known", F.lit(True))
    parts = [
        files.agg(F.count("*").alias("files"), F.coalesce(deleted, F.lit(0)).cast("long").alias("deleted")), symbols.agg(F.count("*").alias("symbols")), test_links.agg(F.count("*").alias("test_links")),
        calls.join(named, "dst_name", "left").agg(F.count("*").alias("edges"), F.count_if(F.col("dst").isNotNull()).alias("resolved"), F.count_if(F.col("dst").isNull()).alias("unresolved"), F.count_if(F.col("dst").isNull() & F.col("known")).alias("unresolved_named")),
    ]
    out = None
    for one in parts:
        long = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*[F.col(c).cast("long") for c in one.columns]))).alias("metric", "n"))
        out = long if out is None else out.unionByName(long)
    return out


def unresolved_classes(classified: DataFrame) -> DataFrame:
    """(target, n) of unbound calls, with a zero for each of builtin, stdlib, external and unknown that does not occur."""
    zero = classified.sparkSession.createDataFrame([(t, 0) for t in ("builtin", "stdlib", "external", "unknown")], "target string, n long")
    counted = classified.where("dst is null").groupBy("target").agg(F.count("*").alias("n"))
    return counted.unionByName(zero).groupBy("target").agg(F.sum("n").alias("n"))


def fails(status: str, fail_on: str = "error") -> bool:
    """Whether a status is bad enough: ``fail_on`` is none, warning or error."""
    rank = {"ok": 0, "warning": 1, "error": 2}
    if fail_on not in ("none", "warning", "error"):
        raise ValueError("fail_on must be none, warning or error")
    return fail_on != "none" and rank[status] >= rank[fail_on]


def worst(findings: DataFrame) -> DataFrame:
    """One row: error, warning or ok."""
    return findings.agg(F.when(F.count_if(F.col("severity") == "error") > 0, "error").when(F.count("*") > 0, "warning").otherwise("ok").alias("status"))


def dangling_test_links(links: DataFrame, symbols: DataFrame, tests: DataFrame, files: DataFrame) -> DataFrame:
    """Links with the reference that is missing: test_symbol, target_symbol or target_file."""
    ids = symbols.select("id").unionByName(tests.select("id")).distinct()
    out = links.join(ids.select(F.col("id").alias("test_symbol_id"), F.lit(1).alias("a")), "test_symbol_id", "left").join(ids.select(F.col("id").alias("target_symbol_id"), F.lit(1).alias("b")), "target_symbol_id", "left").join(files.select(F.col("id").alias("target_file_id"), F.lit(1).alias("c")), "target_file_id", "left")
    missing = F.when(F.col("test_symbol_id").isNotNull() & F.col("a").isNull(), "test_symbol").when(F.col("target_symbol_id").isNotNull() & F.col("b").isNull(), "target_symbol").when(F.col("target_file_id").isNotNull() & F.col("c").isNull(), "target_file")
    return out.withColumn("missing", missing).where("missing is not null").select("test_file_id", "test_symbol_id", "missing")


def distribution(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(value, n) with all values that are not registered in one bucket."""
    return df.groupBy(F.when(F.col(column).isin(*allowed), F.col(column)).otherwise("<unregistered>").alias("value")).agg(F.count("*").alias("n"))
