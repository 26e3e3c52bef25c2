"""From a source tree to a bound graph, whole or by what has changed: walk, classify, parse, attribute, resolve."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import graph, resolve, store
from loomgraph.sources import parsers, walk
from loomgraph.storage import stash

#: Extension to language. Fixed values.
LANGUAGES = {
    "go": "go", "py": "python", "pyi": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "mts": "typescript", "cts": "typescript",
    "rs": "rust", "rb": "ruby", "swift": "swift", "php": "php", "c": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "ipp": "cpp",
}
CALL = ["src", "file_id", "line", "language", "dst_name"]


@dataclass
class Index:
    """A repository's graph as written tables; ``phases`` tells the seconds that each part of the scan took."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    test_links: DataFrame
    modules: DataFrame | None = None
    scan_id: int = 1
    changes: DataFrame | None = None
    phases: dict[str, float] = field(default_factory=dict)
    by_src: DataFrame | None = None
    by_dst: DataFrame | None = None

    @property
    def edges(self) -> DataFrame:
        return self.calls.where("dst is not null").select("src", "dst", "file_id", "line")

    @property
    def unbound(self) -> DataFrame:
        return self.calls.where("dst is null").select(*CALL)

    @property
    def adjacent(self) -> graph.Adjacency:
        """The bound edges in order of either end, written when first asked for."""
        if self.by_src is None:
            self.by_src, self.by_dst = in_order(self.edges, "src"), in_order(self.edges, "dst")
        return graph.Adjacency(self.by_src, self.by_dst)


#: The tables of an index that are kept.
TABLES = ("files", "symbols", "imports", "calls", "test_links", "modules")


def _filesystem(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder, and its Path class."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def save(found: Index, folder: str) -> str:
    """Keep an index as tables below ``folder``/scan=number, which is whole once its last file, DONE, is there; the place."""
    spark = found.files.sparkSession
    place = f"{folder.rstrip('/')}/scan={found.scan_id:010d}"
    for name in TABLES:
        table = getattr(found, name)
        (spark.createDataFrame([], "module string, folder string") if table is None else table).write.mode("overwrite").option("compression", "zstd").parquet(f"{place}/{name}")
    files, path = _filesystem(spark, place)
    files.create(path(f"{place}/DONE"), True).close()
    return place


def load(spark: SparkSession, folder: str) -> Index:
    """The newest whole index below ``folder``; ValueError if there is none."""
    files, path = _filesystem(spark, folder)
    found = []
    if files.exists(path(folder)):
        for status in files.listStatus(path(folder)):
            name = status.getPath().getName()
            if name.startswith("scan=") and files.exists(path(status.getPath(), "DONE")):
                found.append(int(name.removeprefix("scan=")))
    if not found:
        raise ValueError("repo not indexed")
    place = f"{folder.rstrip('/')}/scan={max(found):010d}"
    return Index(**{name: spark.read.parquet(f"{place}/{name}") for name in TABLES}, scan_id=max(found))


def clean(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` whole indexes below ``folder``, and those that never got whole; how many went."""
    files, path = _filesystem(spark, folder)
    if not files.exists(path(folder)):
        return 0
    every = sorted((s.getPath() for s in files.listStatus(path(folder)) if s.getPath().getName().startswith("scan=")), key=lambda p: p.getName())
    whole = [p for p in every if files.exists(path(p, "DONE"))]
    stay = {p.toString() for p in whole[max(0, len(whole) - keep) :]} if keep else set()
    gone = [p for p in every if p.toString() not in stay]
    for p in gone:
        files.delete(p, True)
    return len(gone)


def in_order(edges: DataFrame, column: str) -> DataFrame:
    """Edges written in ranges of ``column``, sorted by it, so that a lookup reads the row groups that can hold its ids."""
    return stash(edges.select("src", "dst").repartitionByRange(column).sortWithinPartitions(column), f"by-{column}")


def test_targets(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Links of test functions by their names: Go TestX to pkg.X (0.8), Python test_x to the module without its affix, others by the prefix test_, Test or test (0.7); from test files only."""
    tested = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").where(text.is_test_file(F.col("path")) & F.col("kind").isin("function", "method"))
    scope, name = F.substring_index("qualified_name", ".", 1), F.col("name")
    go = F.when(name.rlike("^Test.") & (name != "TestMain"), F.concat(scope, F.lit("."), F.substring(name, 5, 1000)))
    bare_module = F.regexp_replace(F.regexp_replace(scope, "^test_", ""), "_test$", "")
    python = F.when(name.rlike("^test_."), F.concat(F.when(bare_module == "", scope).otherwise(bare_module), F.lit("."), F.substring(name, 6, 1000)))
    other = F.when(name.rlike("^(test_|Test|test)."), F.concat(scope, F.lit("."), F.regexp_replace(name, "^(test_|Test|test)", "")))
    key = F.when(F.col("language") == "go", go).when(F.col("language") == "python", python).otherwise(other)
    named = tested.withColumn("target_key", key).where("target_key is not null")
    return named.select(F.col("file_id").alias("test_file_id"), F.col("id").alias("test_symbol_id"), "target_key", F.lit("test_name_match").alias("reason"), F.when(F.col("language") == "go", 0.8).otherwise(0.7).alias("score"))


@contextmanager
def _phase(phases: dict[str, float], name: str) -> Iterator[None]:
    began = time.monotonic()
    yield
    phases[name] = round(phases.get(name, 0.0) + time.monotonic() - began, 3)


def _language():
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[text.extension(F.col("path"))]


def found_files(spark: SparkSession, root: str, config: store.Config, patterns: list[str] | None) -> DataFrame:
    """The tree's files with language and skip: files without a language, of one that is not wanted, binary or too large ones are skipped."""
    rows = walk.walk(spark, root, (patterns or []) + config.exclude, config.max_file_size_bytes).withColumn("language", _language())
    wanted = F.col("language").isin(*config.languages) if config.languages else F.lit(True)
    return rows.withColumn("skip", F.col("skip") | F.col("language").isNull() | ~F.coalesce(wanted, F.lit(False)))


def go_modules(found: DataFrame) -> DataFrame:
    """(module, folder) of the go.mod files."""
    named = found.where(F.col("path").rlike(r"(^|/)go\.mod$")).select(F.regexp_extract(F.col("content").cast("string"), r"(?m)^\s*module\s+\"?([^\s\"]+)", 1).alias("module"), text.dir_prefix(F.col("path")).alias("folder"))
    return named.where("module <> ''")


def _symbols(facts: DataFrame) -> DataFrame:
    """All sixteen columns of a symbol; ids are hashes of path, key and place, so they do not depend on order."""
    return facts.where("fact = 'symbol'").select(
        F.xxhash64("path", "stable_key", "line", "start_col").alias("id"), F.lit(1).cast("long").alias("repo_id"), "file_id", "language", "kind", "name", "qualified_name", "container_name", "signature", "visibility",
        F.col("line").cast("long").alias("start_line"), F.col("start_col").cast("long").alias("start_col"), F.col("end_line").cast("long").alias("end_line"), F.col("end_col").cast("long").alias("end_col"), F.col("doc").alias("doc_summary"), "stable_key",
    ).dropDuplicates(["id"])


def _calls(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with the symbol they stand in: the one of the owner's qualified name, or, where several bear it, the one around the line; calls outside of any are dropped."""
    by_name = symbols.groupBy("file_id", F.col("qualified_name").alias("owner")).agg(F.count("*").alias("n"), F.min(F.struct("start_line", "id")).alias("o")).select("file_id", "owner", "n", F.col("o.id").alias("first"))
    calls = facts.where("fact = 'call'").select("file_id", "language", F.col("name").alias("dst_name"), F.col("qualified_name").alias("owner"), F.col("line").cast("long").alias("line"), "evidence").join(by_name, ["file_id", "owner"])
    spans = symbols.where(F.col("kind").isin("function", "method"))
    around = graph.attribute(calls.where("n > 1").select("file_id", "line").distinct(), spans).select("file_id", "line", F.col("owner").alias("around"))
    sole = calls.where("n = 1").select(F.col("first").alias("src"), "file_id", "line", "language", "dst_name", "evidence")
    several = calls.where("n > 1").join(around, ["file_id", "line"], "left").select(F.coalesce("around", "first").alias("src"), "file_id", "line", "language", "dst_name", "evidence")
    return sole.unionByName(several)


def _parsed(found: DataFrame, files: DataFrame):
    """(symbols, calls, imports, failed paths) of files(path, content) that have an id in ``files``."""
    ids = files.select("path", F.col("id").alias("file_id"), "language")
    facts = stash(parsers.parse(found.join(ids.select("path"), "path", "left_semi")), "facts").join(ids, "path")
    symbols = stash(_symbols(facts), "symbols")
    imports = facts.where("fact = 'import'").select("file_id", F.explode(text.normalize_imports(F.col("language"), F.col("name"))).alias("import_path")).distinct()
    return symbols, stash(_calls(facts, symbols), "found-calls"), stash(imports, "imports"), facts.where("fact = 'error'").select("path")


def _links(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return stash(resolve.bind_test_links(test_targets(symbols, files), symbols, files, files.limit(0).select("id", "path", "language")), "test-links")


def _bound(calls: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    return resolve.resolve(calls.select(*CALL), symbols, files, imports, modules)


def index(spark: SparkSession, root: str, patterns: list[str] | None = None, config: store.Config | None = None, scan_id: int = 1) -> Index:
    """The tree's files, symbols, imports and calls with their bindings."""
    config, phases = config or store.Config(), {}
    with _phase(phases, "walk"):
        found = stash(found_files(spark, root, config, patterns), "tree")
    seen = found.where("not skip")
    files = seen.select(F.xxhash64("path").alias("id"), "path", "language", "size", F.col("size").alias("size_bytes"), "modified", "sha256", F.lit("indexed").alias("parse_state"), F.lit(scan_id).cast("long").alias("last_scan_id"), F.lit(False).alias("is_deleted"))
    modules = stash(go_modules(found), "modules")
    with _phase(phases, "parse"):
        symbols, calls, imports, failed = _parsed(seen, files)
    bad = failed.select("path", F.lit("parse_failed").alias("__state")).distinct()
    files = stash(files.join(bad, "path", "left").withColumn("parse_state", F.coalesce("__state", "parse_state")).drop("__state"), "files")
    if config.fail_on_parse_error and not failed.isEmpty():
        raise ValueError(f"could not parse {failed.first()[0]}")
    with _phase(phases, "resolve"):
        bound = stash(_bound(calls, symbols, files, imports, modules), "calls")
    with _phase(phases, "tests"):
        links = _links(symbols, files)
    return Index(files, symbols, imports, bound, links, modules, scan_id, None, phases)


def update(spark: SparkSession, before: Index, root: str, paths: list[str] | None = None, force: bool = False, patterns: list[str] | None = None, config: store.Config | None = None) -> Index:
    """The index after the tree has changed; what did not change is neither read again nor parsed.

    With ``paths`` only these are looked at, and those of them that are no longer there are
    deleted. ``force`` parses every file again. The result equals a new index, but for
    deleted files, which stay as rows until they are purged.
    """
    config, phases, scan_id = config or store.Config(), {}, before.scan_id + 1
    with _phase(phases, "walk"):
        found = found_files(spark, root, config, patterns)
        stored = store.existing(before.files)
        if paths is not None:
            scope = spark.createDataFrame([(p,) for p in paths], "path string").select(text.canonical_path(F.col("path")).alias("path")).distinct()
            found, stored = walk.scoped(found, scope), store.existing(before.files, scope)
        found = stash(found, "tree")
    with _phase(phases, "classify"):
        changes = walk.classify_changes(stored, found)
        changes = changes.join(stored.select("path", F.lit(1).alias("__old")), "path", "left").where("action <> 'skip_only' or __old = 1").drop("__old")
        if force:
            changes = changes.withColumn("action", F.when(F.col("action").isin("touch", "mark_seen"), "replace").otherwise(F.col("action")))
        changes = stash(changes, "changes")
    files = before.files.withColumn("size", F.col("size_bytes"))
    marked = store.mark(files.drop("size_bytes"), changes, found, scan_id).withColumn("size_bytes", F.col("size"))
    with _phase(phases, "parse"):
        renewed = found.join(changes.where("action = 'replace'").select("path"), "path", "left_semi")
        symbols, calls, imports, failed = _parsed(renewed, marked)
        changes = stash(store.with_failures(changes, failed), "changes")
        marked = stash(store.mark(files.drop("size_bytes"), changes, found, scan_id).withColumn("size_bytes", F.col("size")), "files")
    now = store.live(marked)
    changed = stash(marked.join(changes.where(F.col("action").isin("replace", "delete", "skip_only", "parse_failed")).select("path"), "path", "left_semi").select(F.col("id").alias("file_id")), "changed")
    old = before.symbols.join(changed, "file_id", "left_semi")
    names = stash(resolve.changed_names(old, symbols), "names")
    gone = stash(store.gone_symbols(before.symbols, changed, symbols), "gone")
    all_symbols = stash(store.replace_rows(before.symbols, changed, symbols), "symbols")
    all_imports = stash(store.replace_rows(before.imports, changed, imports), "imports")
    modules = before.modules if before.modules is not None else spark.createDataFrame([], "module string, folder string")
    modules = stash(go_modules(found).unionByName(modules).dropDuplicates(["folder"]), "modules")
    with _phase(phases, "resolve"):
        kept = store.unbind(store.replace_rows(before.calls, changed), gone)
        new = calls.select(*CALL, *[F.lit(None).cast(t).alias(c) for c, t in (("dst", "long"), ("strategy", "string"), ("confidence", "string"), ("blocked", "string"))])
        bound = stash(resolve.re_resolve(kept.unionByName(new), all_symbols, now, names, changed, all_imports, modules), "calls")
    with _phase(phases, "tests"):
        links = _links(all_symbols, now)
    return Index(marked, all_symbols, all_imports, bound, links, modules, scan_id, changes, phases)


def summary(after: Index) -> dict[str, int]:
    """Files seen, changed, deleted and not parsed by the scan that made an index."""
    if after.changes is None:
        n, failed = after.files.count(), after.files.where("parse_state = 'parse_failed'").count()
        return {"files_seen": n, "files_changed": n, "files_deleted": 0, "parse_failed": failed}
    counts = {r[0]: r[1] for r in after.changes.groupBy("action").count().collect()}  # a row per action
    changed = counts.get("replace", 0) + counts.get("parse_failed", 0)
    return {"files_seen": changed + counts.get("touch", 0) + counts.get("mark_seen", 0), "files_changed": changed, "files_deleted": counts.get("delete", 0) + counts.get("skip_only", 0), "parse_failed": counts.get("parse_failed", 0)}
