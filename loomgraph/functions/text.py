"""Scalar functions of the graph as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def qualified_suffix(q: Column) -> Column:
    """Text after the last slash, empty without one."""
    return F.when(F.instr(q, "/") > 0, F.substring_index(q, "/", -1)).otherwise("")


def _after_slash(q: Column) -> Column:
    return F.substring_index(q, "/", -1)


def _dots(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))


def dot_tail2(q: Column) -> Column:
    """Last two dot segments behind the last slash; empty without a dot or with a dot at the end."""
    s = _after_slash(q)
    return F.when((_dots(s) >= 1) & ~s.endswith("."), F.substring_index(s, ".", -2)).otherwise("")


def dot_tail3(q: Column) -> Column:
    """Last three dot segments if there are three dots at least, else empty."""
    s = _after_slash(q)
    return F.when((_dots(s) >= 3) & ~s.endswith("."), F.substring_index(s, ".", -3)).otherwise("")


def short_name(q: Column) -> Column:
    """Behind the last :: if anything follows it, else behind the last dot, else all; trimmed."""
    t = F.trim(q)
    colons, dots = F.substring_index(t, "::", -1), F.substring_index(t, ".", -1)
    return F.trim(F.when((F.instr(t, "::") > 0) & (colons != ""), colons).when((F.instr(t, ".") > 0) & (dots != ""), dots).otherwise(t))


def tokens(text: Column) -> Column:
    """Runs of two or more of [A-Za-z0-9_./-], ASCII letters lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"[a-z0-9_./\-]{2,}"), F.lit(0))


def fts_query(text: Column) -> Column:
    """Words between white space, quotes stripped, each as a quoted prefix term."""
    words = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.replace(w, F.lit('"'), F.lit(""))), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"*'))), " ")


def estimated_tokens(size: Column) -> Column:
    return F.when(size > 0, F.ceil(size / 4)).otherwise(0).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for unequal lengths, empty vectors and zero norms."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = lambda x: F.sqrt(total(F.transform(wide(x), lambda v: v * v)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def canonical_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def dir_prefix(path: Column) -> Column:
    """The folder with its slash, or empty."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def package_scope(path: Column, q: Column) -> Column:
    """Folder and first segment of a package-level name; empty without a package."""
    return F.when(F.instr(q, ".") > 0, F.concat(dir_prefix(path), F.substring_index(q, ".", 1))).otherwise("")


def coupling_label(n: Column) -> Column:
    return F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("low")


def proper_suffixes(q: Column) -> Column:
    """What follows each dot of a name, longest first."""
    parts = F.split(q, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def boundary_suffixes(q: Column, slashes: bool = False) -> Column:
    """What follows each dot and :: of a name, and each slash if asked for, longest first."""
    parts = F.split(q, r"(?<=[./])|(?<=::)" if slashes else r"(?<=\.)|(?<=::)")
    rest = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ""))
    return F.when(F.size(parts) > 1, F.filter(rest, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def member_qualified(name: Column) -> Column:
    """A dot or :: and no slash."""
    return ~name.contains("/") & (name.contains(".") | name.contains("::"))


def extends_at_boundary(name: Column, q: Column) -> Column:
    """Whether a name is a longer spelling of ``q``: it ends in ::q, .q or /q, ASCII case aside."""
    long, short = ascii_lower(name), ascii_lower(q)
    ends = long.endswith(F.concat(F.lit("::"), short)) | long.endswith(F.concat(F.lit("."), short)) | long.endswith(F.concat(F.lit("/"), short))
    return (q != "") & ends


def symbol_text(kind: Column, name: Column, signature: Column, doc: Column) -> Column:
    """The parts that are not empty, with single spaces: what an embedder is given."""
    return F.concat_ws(" ", *[F.when(x != "", x) for x in (kind, name, signature, doc)])


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def fingerprint(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16))


def visibility(language: Column, name: Column) -> Column:
    return F.when(language == "go", F.when(name.rlike("^[A-Z]"), "exported").otherwise("package")).otherwise(F.when(name.startswith("_"), "module").otherwise("public"))


def bare(name: Column) -> Column:
    """No dot, slash or colon."""
    return ~name.rlike("[./:]")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_test_file(path: Column) -> Column:
    """A test folder on the way, or a stem that the language marks as a test. Folders, affixes and extensions."""
    s, e = stem(path), extension(path)
    folder = path.rlike(r"(?i)(^|[/\\])(test|tests|testdata|__tests__)[/\\]")
    rules = [
        (("go",), s.endswith("_test")),
        (("py", "pyi"), s.startswith("test_") | s.endswith("_test")),
        (("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), s.endswith(".test") | s.endswith(".spec")),
        (("java", "kt", "kts", "cs", "swift"), s.endswith("Test") | s.endswith("Tests")),
        (("php",), s.endswith("Test")),
        (("rb",), s.startswith("test_") | s.endswith("_test") | s.endswith("_spec")),
        (("rs", "c", "cc", "cpp", "cxx", "h", "hh", "hpp"), s.endswith("_test")),
    ]
    found = folder
    for ends, hit in rules:
        found = found | (e.isin(*ends) & hit)
    return found


def production_sibling(path: Column) -> Column:
    """The file that a Go or Python test file tests by its name, or null; never itself a test path."""
    plain = F.regexp_replace(F.regexp_replace(path, r"/tests?/", "/"), r"^tests?/", "")
    go = F.when(path.rlike(r"_test\.go$"), F.regexp_replace(path, r"_test\.go$", ".go"))
    python = F.when(path.rlike(r"(^|/)test_[^/]*\.py$"), F.regexp_replace(path, r"(^|/)test_([^/]*\.py)$", "$1$2")).when(path.rlike(r"_test\.py$"), F.regexp_replace(path, r"_test\.py$", ".py"))
    found = F.coalesce(go, python)
    return F.when(~is_test_file(found), found).when(found.isNotNull() & ~is_test_file(plain), F.lit(None).cast("string"))


def escape_cell(text: Column) -> Column:
    """A cell of the compact table form: backslash, tab, line ends and a leading @ escaped."""
    x = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(F.replace(F.replace(x, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(x.startswith("@"), F.concat(F.lit("\\"), x)).otherwise(x)


def unescape_cell(cell: Column) -> Column:
    mark = F.lit("\x00")
    x = F.replace(cell, F.lit("\\\\"), mark)
    x = F.replace(F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.replace(F.replace(x, F.lit("\\@"), F.lit("@")), mark, F.lit("\\"))


def join_relative(path: Column, specifier: Column) -> Column:
    """A relative specifier against a file's folder, with . and up to eight .. resolved; null for others and for those that leave the root."""
    x = F.concat(dir_prefix(path), specifier)
    x = F.regexp_replace(x, r"/(\./)+", "/")
    x = F.regexp_replace(x, r"^(\./)+", "")
    for _ in range(8):
        x = F.regexp_replace(x, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return F.when(specifier.rlike(r"^\.\.?/") & ~x.rlike(r"(^|/)\.\.(/|$)"), x)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def normalize_imports(language: Column, specifier: Column) -> Column:
    """The imports that a statement's text stands for: Python aliases go and relative ones drop out, Java's static goes, Rust's braces open."""
    none = F.array().cast("array<string>")
    bare_python = F.trim(F.regexp_replace(specifier, r"\s+as\s+\w+\s*$", ""))
    head = F.regexp_extract(specifier, r"^([^{]*)\{", 1)
    inside = F.split(F.regexp_extract(specifier, r"\{([^{}]*)\}", 1), ",")
    opened = F.transform(F.filter(F.transform(inside, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.when(x == "self", F.regexp_replace(head, "::$", "")).otherwise(F.concat(head, F.regexp_replace(x, r"\s+as\s+\w+$", ""))))
    return (
        F.when(language == "python", F.when(bare_python.startswith("."), none).otherwise(F.array(bare_python)))
        .when(language == "java", F.array(F.trim(F.regexp_replace(specifier, r"^static\s+", ""))))
        .when((language == "rust") & specifier.contains("{"), opened)
        .otherwise(F.array(F.trim(specifier)))
    )


def database_name(root: Column) -> Column:
    """The name of a repository's store: sixteen digits of its path's hash."""
    return F.concat(F.left(F.sha2(root, 256), F.lit(16)), F.lit(".sqlite"))
