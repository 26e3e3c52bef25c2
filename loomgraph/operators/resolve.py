"""Binding call names to definitions by a chain of strategies.

All strategies match distinct (name, language, kind of caller, scope) against groups of
symbols, so the work is in names, not in calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.skew import HOT, join_on
from loomgraph.storage import stash

#: Strategies in their order and the confidence of each. Fixed values.
CONFIDENCE = {
    "module_import": "high", "go_package_scope": "high", "exact_qualified": "high", "exact_name": "high", "slash_suffix": "medium", "dot_tail2": "medium", "dot_tail3": "medium",
    "dot_suffix": "low", "receiver_method": "medium", "cross_language_shared_name": "low", "cross_language_import_path": "low",
}
BINDABLE = ("function", "method", "class", "type", "struct", "interface")
TYPES = ("class", "type", "struct", "interface", "enum", "object", "protocol", "actor", "trait")


def _groups(symbols: DataFrame, key: Column) -> DataFrame:
    """(key, language): the sole candidate for a caller in a test, and for one in production code."""
    production = ~F.col("in_test")
    return (
        symbols.select(key.alias("key"), "language", "id", "in_test")
        .where((F.col("key") != "") & (F.col("language") != ""))
        .groupBy("key", "language")
        .agg(F.count("*").alias("n"), F.count_if(production).alias("n_production"), F.min("id").alias("any_id"), F.min(F.when(production, F.col("id"))).alias("production_id"))
        .select("key", "language", "n", "n_production", F.when(F.col("n") == 1, F.col("any_id")).alias("any_id"), F.when(F.col("n_production") == 1, F.col("production_id")).alias("production_id"))
    )


def _paths(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_id, via, import_folder): a file's imports that lie in a module(module, folder), and the folder each stands for; of nested modules the longest."""
    parts = F.split("import_path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    tried = imports.select("file_id", "import_path").distinct().withColumn("module", F.explode(heads)).join(modules.select("module", "folder"), "module")
    rest = F.substring(F.col("import_path"), F.length("module") + 2, 1 << 20)
    place = F.concat("folder", rest, F.when(rest != "", "/").otherwise(""))
    return tried.groupBy("file_id", F.col("import_path").alias("via")).agg(F.max_by(place, F.length("module")).alias("import_folder"))


def resolve(calls: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """calls(src, file_id, line, language, dst_name) with dst, strategy, confidence and blocked (ambiguity, test_shadow, language, unknown_language or null).

    Gates: same language only; production callers bind only what no test file declares;
    names that any broad level finds ambiguous are vetoed for all but exact qualified
    names; bare Go calls bind package-level names of their own folder and package; a bare
    call binds a type only in its own file; bare and :: names of C++ bind by evidence alone
    (``cpp_evidence``). With ``imports`` and ``modules`` (module, folder) Go calls through an
    import bind the sole package-level symbol of that folder and nothing weaker than their
    exact qualified name.

    A call is joined twice: with what is known of its file, and with the binding of its name
    in its scope. Everything else is decided for distinct (name, language, kind of
    caller, scope); names of very many calls find their binding in a broadcast.
    """
    tested = files.select(F.col("id").alias("file_id"), "path", text.is_test_file(F.col("path")).alias("in_test"))
    s = symbols.join(tested, "file_id", "left").withColumn("in_test", F.coalesce("in_test", F.lit(False)))
    q, dst = F.col("qualified_name"), F.col("dst_name")
    packages = s.where((F.col("language") == "go") & q.contains(".")).groupBy("file_id").agg(F.min(F.substring_index(q, ".", 1)).alias("package"))
    place = tested.join(packages, "file_id", "left").select("file_id", F.col("in_test").alias("from_test"), text.dir_prefix(F.col("path")).alias("folder"), "package")
    plain, go = text.bare(dst), F.col("language") == "go"
    scope = F.when(go & plain, F.concat_ws("\x1f", "folder", F.coalesce("package", F.lit(""))))
    with_imports = imports is not None and modules is not None
    if with_imports:
        scope = scope.when(go & dst.contains("/"), F.col("file_id").cast("string"))
    key = F.struct(F.coalesce(dst, F.lit("")).alias("name"), F.coalesce("language", F.lit("")).alias("language"), F.col("from_test"), F.coalesce(scope, F.lit("")).alias("scope"))
    every = calls.join(place, "file_id", "left").withColumn("from_test", F.coalesce("from_test", F.lit(False))).withColumn("key", key)
    names = stash(every.groupBy("key").agg(F.count("*").alias("calls")), "names")
    hot = stash(names.where(F.col("calls") > HOT).select("key"), "hot-names")
    names = names.where("key.name <> ''").select("key", F.col("key.name").alias("dst_name"), F.col("key.language").alias("language"), F.col("key.from_test").alias("from_test"), F.col("key.scope").alias("scope"))

    dots = F.length(dst) - F.length(F.replace(dst, F.lit("."), F.lit("")))
    no_slash = ~dst.contains("/")
    suffixes = s.select("id", "in_test", "language", F.explode(text.proper_suffixes(text.ascii_lower(q))).alias("suffix")).where("suffix like '%.%.%'")
    levels = [
        ("exact_qualified", _groups(s, q), dst, F.lit(True)),
        ("exact_name", _groups(s.where(F.col("kind").isin(*BINDABLE)), F.col("name")), dst, F.lit(True)),
        ("slash_suffix", _groups(s, text.qualified_suffix(q)), dst, no_slash),
        ("dot_tail2", _groups(s, text.dot_tail2(q)), dst, dots == 1),
        ("dot_tail3", _groups(s, text.dot_tail3(q)), dst, (dots == 2) & no_slash),
        ("dot_suffix", _groups(suffixes, F.col("suffix")), text.ascii_lower(dst), (dots >= 2) & no_slash),
        ("receiver_method", _groups(s.where("container_name <> ''"), F.col("name")), dst, F.lit(True)),
    ]
    broad = _groups(s.where(F.col("kind").isin(*BINDABLE) | (F.col("container_name") != "")), F.col("name"))
    undecided = lambda n, p: F.when(F.col("from_test"), F.col(n) != 1).otherwise(F.col(p) != 1)
    tagged = names
    for k, (groups, own) in enumerate(((levels[0][1], "q"), (broad, "b"))):
        g = groups.select(F.col("key").alias("dst_name"), "language", F.col("n").alias(f"n{k}"), F.col("n_production").alias(f"p{k}"))
        tagged = tagged.join(g, ["dst_name", "language"], "left").withColumn(f"veto_{own}", F.coalesce(undecided(f"n{k}", f"p{k}"), F.lit(False)))
        tagged = tagged.withColumn(f"shadow_{own}", F.coalesce(~F.col("from_test") & (F.col(f"n{k}") > 0) & (F.col(f"p{k}") == 0), F.lit(False))).drop(f"n{k}", f"p{k}")
    tagged = tagged.withColumn("veto", F.col("veto_q") | F.col("veto_b")).withColumn("shadow", F.col("shadow_q") | F.col("shadow_b"))
    found = []
    for k, (name, groups, spelled, when) in enumerate(levels):
        g = groups.select(F.col("key").alias(f"key{k}"), F.col("language").alias(f"lang{k}"), F.col("any_id").alias(f"any{k}"), F.col("production_id").alias(f"production{k}"))
        tagged = tagged.join(g, (spelled == F.col(f"key{k}")) & (F.col("language") == F.col(f"lang{k}")), "left")
        pick = F.when(F.col("from_test"), F.col(f"any{k}")).otherwise(F.col(f"production{k}"))
        allowed = when if k == 0 else when & ~F.col("veto")
        found.append(F.when(allowed & pick.isNotNull(), F.struct(pick.alias("dst"), F.lit(name).alias("strategy"))))
    elsewhere = s.select(F.explode(F.array("name", "qualified_name")).alias("dst_name")).distinct().withColumn("known", F.lit(True))
    bound = tagged.select("key", "dst_name", "language", "from_test", "scope", "veto", "shadow", F.coalesce(*found).alias("b")).join(elsewhere, "dst_name", "left")
    cpp = (F.col("language") == "cpp") & (~dst.contains(".") | dst.contains("::"))
    chosen = F.when(~((go & plain) | cpp), F.col("b"))

    # bare Go calls: the sole package-level declaration of the same folder and package as the caller
    package_level = s.where((F.col("language") == "go") & (q == F.concat(F.substring_index(q, ".", 1), F.lit("."), F.col("name"))))
    package = _groups(package_level, F.concat_ws("\x1f", text.dir_prefix(F.col("path")), F.substring_index(q, ".", 1), "name"))
    bound = bound.withColumn("scope_key", F.when(go & plain, F.concat_ws("\x1f", "scope", "dst_name")))
    bound = bound.join(package.select(F.col("key").alias("scope_key"), F.col("any_id").alias("go_any"), F.col("production_id").alias("go_production")), "scope_key", "left")
    go_pick = F.when(F.col("from_test"), F.col("go_any")).otherwise(F.col("go_production"))
    chosen = F.coalesce(F.when(go_pick.isNotNull(), F.struct(go_pick.alias("dst"), F.lit("go_package_scope").alias("strategy"))), chosen)

    if with_imports:
        target = _groups(package_level.where(~F.col("in_test")), F.concat_ws("\x1f", text.dir_prefix(F.col("path")), "name")).select(F.col("key").alias("import_key"), F.col("production_id").alias("import_id"))
        through = go & dst.contains("/")
        bound = bound.withColumn("via", F.when(through, F.regexp_extract("dst_name", r"^(.*)\.[^.]*$", 1))).withColumn("import_file", F.when(through, F.col("scope").cast("long")))
        paths = _paths(imports, modules).withColumnRenamed("file_id", "import_file")
        bound = bound.join(paths, ["import_file", "via"], "left").withColumn("import_key", F.concat_ws("\x1f", "import_folder", F.when(F.col("import_folder").isNotNull(), F.substring_index("dst_name", ".", -1)))).join(target, "import_key", "left")
        by_import = F.when(F.col("import_id").isNotNull() & F.col("import_folder").isNotNull(), F.struct(F.col("import_id").alias("dst"), F.lit("module_import").alias("strategy")))
        exact = F.when(chosen["strategy"] == "exact_qualified", chosen)
        chosen = F.when(F.col("import_folder").isNotNull(), F.coalesce(by_import, exact)).otherwise(chosen)

    candidates = s.select(F.col("id").alias("b_id"), F.col("kind").isin(*TYPES).alias("b_type"), F.col("file_id").alias("b_file"))
    bound = bound.withColumn("b", chosen).join(candidates, F.col("b.dst") == F.col("b_id"), "left").select("key", "b", "veto", "shadow", "known", "b_type", "b_file")
    out = join_on(every.drop("folder", "package"), bound, "key", None if hot.isEmpty() else hot, "left")

    # a bare name means a type of its own file only
    elsewhere_type = F.col("language").isin("python", "typescript") & plain & F.col("b_type") & (F.col("b_file") != F.col("file_id"))
    out = out.withColumn("b", F.when(~F.coalesce(elsewhere_type, F.lit(False)), F.col("b")))
    confidence = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    blocked = F.when(F.col("b").isNull(), F.when(F.coalesce("language", F.lit("")) == "", "unknown_language").when(F.col("shadow"), "test_shadow").when(F.col("veto"), "ambiguity").when(F.col("known"), "language"))
    out = out.select("src", "file_id", "line", "language", "dst_name", F.col("b.dst").alias("dst"), F.col("b.strategy").alias("strategy"), confidence[F.col("b.strategy")].alias("confidence"), blocked.alias("blocked"))
    if imports is None:
        return out
    evidence = cpp_evidence(out.where(cpp & F.col("dst").isNull()).select("src", "file_id", "dst_name").distinct(), symbols, files, imports)
    given = evidence.select("src", "file_id", "dst_name", F.col("dst").alias("e_dst"), F.col("strategy").alias("e_strategy"))
    known = out.where(cpp).join(given, ["src", "file_id", "dst_name"], "left")
    known = known.select("src", "file_id", "line", "language", "dst_name", F.coalesce("dst", "e_dst").alias("dst"), F.coalesce("strategy", "e_strategy").alias("strategy"), F.coalesce("confidence", F.when(F.col("e_dst").isNotNull(), "high")).alias("confidence"), F.when(F.col("e_dst").isNull(), F.col("blocked")).alias("blocked"))
    return out.where(~F.coalesce(cpp, F.lit(False))).unionByName(known)


def includes(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, seen): the files a C++ file sees: itself, those its includes name by a path or the end of one, and those that these include."""
    f = files.select(F.col("id").alias("seen"), F.explode(F.array_distinct(F.concat(F.array("path"), F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), k, 1000), "/"))))).alias("named"))
    one = imports.select("file_id", text.canonical_path(F.regexp_replace("import_path", r"^(\.\./)+", "")).alias("named")).distinct().join(f, "named").select("file_id", "seen").distinct()
    two = one.join(one.select(F.col("file_id").alias("seen"), F.col("seen").alias("further")), "seen").select("file_id", F.col("further").alias("seen"))
    own = files.select(F.col("id").alias("file_id"), F.col("id").alias("seen"))
    return own.unionByName(one).unionByName(two).distinct()


def cpp_evidence(calls: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, file_id, dst_name, dst, strategy) for calls(src, file_id, dst_name) of C++ by bare or :: names.

    The name is tried in the caller's class and namespaces from the inside out, and globally; ::x
    only globally. A definition is visible where its file is seen by includes, or a
    declaration of the same qualified name and signature is. The innermost scope with a visible
    definition decides, if it has exactly one; production code sees no tests.
    """
    tested = files.select(F.col("id").alias("file_id"), text.is_test_file(F.col("path")).alias("in_test"))
    s = symbols.where(F.col("language") == "cpp").join(tested, "file_id")
    sign = F.col("signature") if "signature" in symbols.columns else F.lit("")
    definitions = s.where(F.col("kind").isin(*BINDABLE, *TYPES)).select("id", "qualified_name", sign.alias("signature"), "file_id", "in_test")
    declared = s.where("kind = 'declaration'").select("qualified_name", sign.alias("signature"), F.col("file_id").alias("offered"))
    offered = definitions.select("id", "qualified_name", "in_test", F.col("file_id").alias("offered")).unionByName(definitions.join(declared, ["qualified_name", "signature"]).select("id", "qualified_name", "in_test", "offered")).distinct()
    scopes = s.select(F.col("id").alias("src"), F.col("qualified_name").alias("of"), F.col("in_test").alias("from_test"))
    parts = F.split("of", "::")
    name = F.col("dst_name")
    keys = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.when(k == 0, name).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "::"), F.lit("::"), name)).alias("key")))
    keys = F.when(name.startswith("::"), F.array(F.struct(F.lit(0).alias("depth"), F.regexp_replace(name, "^::", "").alias("key")))).otherwise(keys)
    tried = calls.join(scopes, "src").withColumn("t", F.explode(keys)).select("src", "file_id", "dst_name", "from_test", "t.depth", "t.key")
    seen = includes(imports, files).withColumnRenamed("seen", "offered")
    hits = tried.join(offered.withColumnRenamed("qualified_name", "key"), "key").where("from_test or not in_test").join(seen, ["file_id", "offered"], "left_semi")
    by_depth = hits.groupBy("src", "file_id", "dst_name", "depth").agg(F.countDistinct("id").alias("n"), F.min("id").alias("dst"))
    inner = by_depth.groupBy("src", "file_id", "dst_name").agg(F.max_by(F.struct("n", "dst"), "depth").alias("top")).where("top.n = 1")
    return inner.select("src", "file_id", "dst_name", "top.dst", F.when(name.contains("::"), "exact_qualified").otherwise("exact_name").alias("strategy"))


def outcomes(resolved: DataFrame) -> DataFrame:
    """(outcome, n): calls by strategy, by what blocked them, or unresolved."""
    return resolved.groupBy(F.coalesce("strategy", F.concat(F.lit("blocked_by_"), "blocked"), F.lit("unresolved")).alias("outcome")).agg(F.count("*").alias("n"))


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name): the names and qualified names that symbols of changed files had or have. Both sides count, as a name that goes may free another."""
    both = lambda df: df.select(F.explode(F.array("name", "qualified_name")).alias("name"))
    return both(before).unionByName(both(after)).where("name <> ''").distinct()


def removed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name): names and qualified names that were declared in changed files and no longer are, captured before they are written."""
    both = lambda df: df.select(F.explode(F.array("name", "qualified_name")).alias("name")).where("name <> ''")
    return both(before).distinct().join(both(after), "name", "left_anti")


def contested_names(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(name, language, n) of the names that more than one symbol of a language bears by now, among ``names``."""
    borne = symbols.select("language", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name")).join(names, "name", "left_semi")
    return borne.groupBy("name", "language").agg(F.count("*").alias("n")).where("n > 1")


def re_resolve(resolved: DataFrame, symbols: DataFrame, files: DataFrame, changed_names: DataFrame, changed_files: DataFrame, imports: DataFrame | None = None, modules: DataFrame | None = None) -> DataFrame:
    """Bindings after a change: calls that are unresolved, name a changed symbol or lie in a changed file are resolved anew, the others stay.

    changed_names(name): names and qualified names declared before or after; the result
    equals a full resolve with the same imports and modules.
    """
    last = lambda c: F.substring_index(F.substring_index(c, "::", -1), ".", -1)
    hit = changed_names.select(F.lower(last(F.col("name"))).alias("tail"), F.lit(1).alias("hit")).distinct()
    moved = changed_files.select("file_id", F.lit(1).alias("moved")).distinct()
    touched = resolved.withColumn("tail", F.lower(last(F.col("dst_name")))).join(hit, "tail", "left").join(moved, "file_id", "left")
    again = F.col("dst").isNull() | F.col("hit").isNotNull() | F.col("moved").isNotNull()
    calls = touched.where(again).select("src", "file_id", "line", "language", "dst_name")
    return touched.where(~again).select(*resolved.columns).unionByName(resolve(calls, symbols, files, imports, modules))


def unbound_name_counts(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(metric, n): unbound calls, those whose name a symbol bears, and bound calls whose target is gone."""
    known = symbols.select(F.col("name").alias("dst_name")).distinct().withColumn("known", F.lit(True))
    there = symbols.select(F.col("id").alias("dst")).withColumn("there", F.lit(True))
    told = resolved.join(known, "dst_name", "left").join(there, "dst", "left")
    counted = told.agg(F.count_if(F.col("dst").isNull()).alias("unresolved"), F.count_if(F.col("dst").isNull() & F.col("known")).alias("unresolved_named"), F.count_if(F.col("dst").isNotNull() & F.col("there").isNull()).alias("dangling"))
    return counted.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in counted.columns]), F.array(*[F.col(c) for c in counted.columns]))).alias("metric", "n"))


def bind_test_links(links: DataFrame, symbols: DataFrame, files: DataFrame, test_files: DataFrame) -> DataFrame:
    """links with target_symbol_id and target_file_id: the sole production symbol of the key, else the file that the test's name points at."""
    tested = files.unionByName(test_files, allowMissingColumns=True)
    keep = links.join(tested.where(text.is_test_file(F.col("path"))).select(F.col("id").alias("test_file_id"), F.col("path").alias("test_path")), "test_file_id")
    production = files.where(~text.is_test_file(F.col("path")))
    sole = symbols.join(production.select(F.col("id").alias("file_id")), "file_id", "left_semi").groupBy(F.col("qualified_name").alias("target_key")).agg(F.count("*").alias("n"), F.min("id").alias("sid"), F.min("file_id").alias("fid")).where("n = 1").drop("n")
    sibling = production.select(F.col("path").alias("sibling"), F.col("id").alias("sibling_id"))
    out = keep.join(sole, "target_key", "left").withColumn("sibling", text.production_sibling(F.col("test_path"))).join(sibling, "sibling", "left")
    return out.select("test_file_id", "test_symbol_id", "target_key", F.col("sid").alias("target_symbol_id"), F.coalesce("fid", "sibling_id").alias("target_file_id"), F.when(F.col("sid").isNotNull(), F.col("reason")).when(F.col("sibling_id").isNotNull(), "test_file_name_match").otherwise(F.col("reason")).alias("reason"), "score")


def related_tests(bound_links: DataFrame, test_calls: DataFrame, tests: DataFrame, test_files: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, symbol, reason, score): tests linked with or calling one of ``targets`` (id), the best evidence of each."""
    t = targets.select("id")
    linked = bound_links.join(t, bound_links.target_symbol_id == t.id, "left_semi").select(F.col("test_symbol_id").alias("id"), "reason", "score", F.lit(2).alias("rank"))
    called = test_calls.join(t.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.lit("test_calls").alias("reason"), F.lit(0.9).alias("score"), F.lit(3).alias("rank"))
    both = linked.unionByName(called).join(tests.select("id", "file_id", "qualified_name"), "id").join(test_files.select(F.col("id").alias("file_id"), "path"), "file_id")
    pick = F.round(F.col("score") * 1000).cast("long") * 4 + F.col("rank")
    return both.groupBy("path", F.col("qualified_name").alias("symbol")).agg(F.max_by(F.struct("reason", "score"), pick).alias("best")).select("path", "symbol", "best.reason", "best.score")


def cross_language_links(bridges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, strategy) for bridges(src_file, dst_file) between files of two languages.

    One symbol of the same name on either side is a shared name; without any shared
    name, the only symbols of both files are linked; everything else abstains, and so
    does a source that several bridges answer.
    """
    able = symbols.where(F.col("kind").isin(*BINDABLE)).select("id", "file_id", "name")
    a = able.select(F.col("id").alias("src"), F.col("file_id").alias("src_file"), "name")
    b = able.select(F.col("id").alias("dst"), F.col("file_id").alias("dst_file"), "name")
    shared = bridges.join(a, "src_file").join(b, ["dst_file", "name"])
    named = shared.groupBy("src_file", "dst_file", "src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1").select("src_file", "dst_file", "src", "dst", F.lit("cross_language_shared_name").alias("strategy"))
    sole = able.groupBy("file_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    lone = bridges.join(shared.select("src_file", "dst_file").distinct(), ["src_file", "dst_file"], "left_anti")
    lone = lone.join(sole.select(F.col("file_id").alias("src_file"), F.col("id").alias("src")), "src_file").join(sole.select(F.col("file_id").alias("dst_file"), F.col("id").alias("dst")), "dst_file").select("src_file", "dst_file", "src", "dst", F.lit("cross_language_import_path").alias("strategy"))
    every = named.unionByName(lone)
    single = every.groupBy("src").agg(F.count("*").alias("n")).where("n = 1").select("src")
    return every.join(single, "src", "left_semi").select("src", "dst", "strategy")


def rebuild(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What to insert and what to delete so that ``stored`` becomes ``wanted``."""
    return wanted.join(stored, keys, "left_anti"), stored.join(wanted, keys, "left_anti")


def import_bridges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src_file, dst_file): imports whose path names exactly one file, of another language, and none of the importer's own.

    Paths are relative specifiers joined with the importer's folder, or others with a slash
    as they are; they are looked up whole, without extension, and with the specifier's own stripped.
    """
    f = files.select("id", "path", "language")
    source = imports.join(f.select(F.col("id").alias("file_id"), F.col("path").alias("from_path"), F.col("language").alias("from_language")), "file_id")
    spec = F.col("import_path")
    named = F.when(spec.rlike(r"^\.\.?/"), text.join_relative(F.col("from_path"), spec)).when(spec.contains("/"), spec)
    keys = source.withColumn("named", named).where("named is not null").withColumn("key", F.explode(F.array_distinct(F.array("named", text.without_extension(F.col("named"))))))
    places = f.select(F.col("id").alias("dst_file"), F.col("language").alias("to_language"), F.explode(F.array_distinct(F.array("path", text.without_extension(F.col("path"))))).alias("key"))
    hits = keys.join(places, "key").select("file_id", "import_path", "from_language", "dst_file", "to_language").distinct()
    same = F.count_if(F.col("from_language") == F.col("to_language"))
    sole = hits.groupBy("file_id", "import_path").agg(same.alias("same"), F.count("*").alias("n"), F.min("dst_file").alias("dst_file")).where("same = 0 and n = 1")
    return sole.select(F.col("file_id").alias("src_file"), "dst_file").distinct()


def related_tests_of_files(bound_links: DataFrame, test_calls: DataFrame, tests: DataFrame, test_files: DataFrame, symbols: DataFrame, wanted: DataFrame, limit: int = 50) -> DataFrame:
    """(path, symbol, reason, score) for wanted(place, file_id): of a test found for several files the first one's row stays; ``limit`` per file."""
    t = symbols.join(wanted, "file_id").select("id", "place")
    linked = bound_links.join(t, bound_links.target_symbol_id == t.id).select("place", F.col("test_symbol_id").alias("tid"), "reason", "score", F.lit(2).alias("rank"))
    called = test_calls.join(t, test_calls.dst == t.id).select("place", F.col("src").alias("tid"), F.lit("test_calls").alias("reason"), F.lit(0.9).alias("score"), F.lit(3).alias("rank"))
    every = linked.unionByName(called).join(tests.select(F.col("id").alias("tid"), "file_id", "qualified_name"), "tid").join(test_files.select(F.col("id").alias("file_id"), "path"), "file_id")
    pick = F.round(F.col("score") * 1000).cast("long") * 4 + F.col("rank")
    best = every.groupBy("place", "path", F.col("qualified_name").alias("symbol")).agg(F.max_by(F.struct("reason", "score"), pick).alias("b"))
    page = Window.partitionBy("place").orderBy(F.desc("b.score"), "path", "symbol")
    first = best.withColumn("n", F.row_number().over(page)).where(F.col("n") <= min(max(50, limit), 1000))
    return first.groupBy("path", "symbol").agg(F.min_by("b", "place").alias("b")).select("path", "symbol", "b.reason", "b.score")
