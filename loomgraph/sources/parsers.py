"""Parsers as table functions: files in, symbols, imports and calls out.

None of them is a grammar. Comments and literals are blanked first, with their length and
line ends kept, so what patterns find is code and stands at its place in the source;
spans follow from brackets or indentation.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame


class Fact(NamedTuple):
    path: str
    fact: str  # symbol, import or call
    kind: str
    name: str
    qualified_name: str  # of a call: of the function it stands in, or empty
    container_name: str
    line: int
    end_line: int
    start_col: int = 1
    end_col: int = 1
    signature: str = ""
    visibility: str = ""
    doc: str = ""
    stable_key: str = ""
    evidence: str = ""


_INTS = ("line", "end_line", "start_col", "end_col")
FACT = ", ".join(f"{n} {'int' if n in _INTS else 'string'}" for n in Fact._fields)

_LINE, _BLOCK, _QUOTED, _TICKED, _BACK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"`(?:\\.|[^`\\])*(?:`|\Z)"
_TRIPLE = r'""".*?(?:"""|\Z)'
#: What is no code, by style; the first alternative that fits at a place counts.
_HIDDEN = {
    style: re.compile("|".join(parts), re.S | re.M)
    for style, parts in {
        "c": [_LINE, _BLOCK, _TRIPLE, r'R"(?P<raw>[^()\s"]*)\(.*?\)(?P=raw)"', r'@"(?:[^"]|"")*"?', _QUOTED, _TICKED, _BACK],
        "go": [_LINE, _BLOCK, r"`[^`]*`?", _QUOTED, _TICKED],
        "rust": [_LINE, _BLOCK, r'\bb?r(?P<raw>#*)".*?"(?P=raw)', r'b?"(?:\\.|[^"\\])*"?', r"b?'(?:\\[^'\n]+|[^'\\\n])'"],
        "python": [r"#[^\n]*", r"(?i:\b[rbuf]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z))", r"(?i:\b[rbuf]{1,2})?(?:\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"],
        "ruby": [r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)", r"<<[~-](?P<q>['\"]?)(?P<here>[A-Z_a-z]\w*)(?P=q)[^\n]*\n.*?(?:^[ \t]*(?P=here)\b|\Z)", r"#(?!\{)[^\n]*", r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?", _BACK],
        "php": [r"(?://|#(?!\[))[^\n]*", _BLOCK, r"<<<(?P<q>['\"]?)(?P<here>\w+)(?P=q)\n.*?(?:^[ \t]*(?P=here)\b|\Z)", r'"(?:\\.|[^"\\])*"?', r"'(?:\\.|[^'\\])*'?"],
    }.items()
}


def blank(source: str, style: str) -> str:
    """The source with comments and literals as spaces."""
    return _HIDDEN[style].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


class _Places:
    """Lines and columns of offsets."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        return at - self.starts[self.line(at) - 1] + 1


def _close(code: str, at: int) -> int:
    """The offset behind the bracket that closes the one at ``at``; the end of the code if none does."""
    open_, shut = code[at], {"{": "}", "(": ")", "[": "]"}[code[at]]
    depth = 0
    for m in re.compile(rf"[{re.escape(open_ + shut)}]").finditer(code, at):
        depth += 1 if m[0] == open_ else -1
        if not depth:
            return m.end()
    return len(code)


def _words(text: str, most: int = 400) -> str:
    return " ".join(text.split())[:most]


def _doc(source: str, at: int) -> str:
    """The comment on the lines straight above the line of ``at``, without its marks."""
    lines = source[: source.rfind("\n", 0, at) + 1].split("\n")[:-1]
    kept: list[str] = []
    inside = False
    while lines:
        text = lines.pop().strip()
        if inside or text.endswith("*/"):
            inside = "/*" not in text
        elif not re.match(r"(//|#)", text):
            break
        kept.append(re.sub(r"^(?:/\*+|\*+/|\*|//+|#+)\s?|\*/$", "", text).strip())
    return " ".join(t for t in reversed(kept) if t)


def _module(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])


# Python

_python_def = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)")
_python_import = re.compile(r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+(.+))")
_call = re.compile(r"([A-Za-z_][\w.]*)\s*\(")
_python_words = {"def", "class", "if", "elif", "while", "for", "return", "and", "or", "not", "in", "lambda", "print", "with", "assert", "except", "yield", "await", "del", "raise", "import", "from", "is", "else", "try", "match", "case"}


def parse_python(path: str, source: str) -> Iterator[tuple]:
    """Definitions by indentation, imports, and calls with the definition they stand in.

    A line that goes on a bracket, a string or a backslash opens and closes nothing.
    """
    module = _module(path)
    code = blank(source, "python")
    places = _Places(source)
    inside = {places.line(m.end()) for m in _HIDDEN["python"].finditer(source) if "\n" in m[0]}
    raw = source.split("\n")
    stack: list[tuple[int, str, str, int]] = []  # indent, name, kind, place in rows
    rows: list[Fact] = []
    last, depth, goes_on = 0, 0, False
    lines = code.split("\n")
    for number, line in enumerate(lines, 1):
        if not line.strip():
            continue
        follows = depth > 0 or goes_on or number in inside
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        goes_on = line.rstrip().endswith("\\")
        indent = len(line) - len(line.lstrip())
        while not follows and stack and indent <= stack[-1][0]:
            place = stack.pop()[3]
            rows[place] = rows[place]._replace(end_line=last, end_col=len(raw[last - 1]) + 1)
        last = number
        found = None if follows else _python_def.match(line)
        if found:
            outer = [n for _, n, _, _ in stack]
            kind = "class" if found[2] == "class" else "method" if stack and stack[-1][2] == "class" else "function"
            box = outer[-1] if outer else module
            key = f"class:{module}:{found[3]}" if kind == "class" else f"func:{module}:{box if outer else ''}:{found[3]}"
            after, open_ = number - 1, 0  # the line that ends the head
            while after < len(lines):
                open_ += sum(lines[after].count(c) for c in "([{") - sum(lines[after].count(c) for c in ")]}")
                after += 1
                if open_ <= 0:
                    break
            doc = re.match(r"\s*(?i:[rbuf]{0,2})(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"([^\"\n]*)\"|'([^'\n]*)')", "\n".join(raw[after : after + 40]), re.S)
            summary = next((g for g in doc.groups() if g is not None), "") if doc else ""
            rows.append(Fact(path, "symbol", kind, found[3], ".".join([module, *outer, found[3]]), box, number, number, indent + 1, len(raw[number - 1]) + 1, _words(raw[number - 1]).removesuffix(":"), "module" if found[3].startswith("_") else "public", _words(summary), key))
            stack.append((indent, found[3], kind, len(rows) - 1))
            continue
        imported = None if follows else _python_import.match(line)
        if imported:
            for name in [imported[1]] if imported[1] else imported[2].split(","):
                if name.strip():
                    rows.append(Fact(path, "import", "import", name.strip(), "", "", number, number))
            continue
        for m in _call.finditer(line):
            if m[1] not in _python_words:
                owner = ".".join([module, *[n for _, n, _, _ in stack]]) if stack else ""
                rows.append(Fact(path, "call", "calls", m[1], owner, "", number, number, m.start() + 1, m.end() + 1, evidence=raw[number - 1].strip()))
    for *_, place in stack:
        rows[place] = rows[place]._replace(end_line=last, end_col=len(raw[last - 1]) + 1)
    return iter(rows)


# Go

_go_package = re.compile(r"^package\s+(\w+)", re.M)
_go_import = re.compile(r'^\s*(?:import\s+)?(?:(\w+|\.)\s+)?"([^"]+)"')
_go_func = re.compile(r"^func\s+(?:\(\s*(?:\w+\s+)?(\*?\s*[\w.]+(?:\[[^\]]*\])?)\s*\)\s*)?(\w+)\s*(?=[(\[])", re.M)
_go_group = re.compile(r"^(type|var|const)\s*(\()?", re.M)
_go_type = re.compile(r"\s*(\w+)(?:\[[^\]\n]*\])?\s+(?:=\s*)?([^\n]+)")
_go_value = re.compile(r"\s*(\w+(?:\s*,\s*\w+)*)")
_go_call = re.compile(r"((?:\[\])?[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)(?:\[[\w.*, \[\]]+\])?[ \t]*\(")
_go_words = {"func", "if", "for", "switch", "select", "case", "return", "go", "defer", "range", "var", "const", "type", "import", "chan", "map", "else", "struct", "interface"}


def _go_operand(code: str, at: int) -> int:
    """Where the expression begins that goes on with a dot before ``at``, as x in x.f(y).g."""
    while at > 0 and code[at - 1] == ".":
        at -= 1
        while at > 0 and code[at - 1] in ")]":
            depth = 0
            while at > 0:
                at -= 1
                depth += (code[at] in ")]") - (code[at] in "([")
                if not depth:
                    break
        while at > 0 and (code[at - 1].isalnum() or code[at - 1] == "_"):
            at -= 1
    return at


def _go_visibility(name: str) -> str:
    return "exported" if name[:1] == name[:1].upper() and name[:1] != "_" else "package"


def _go_imports(path: str, source: str, code: str) -> Iterator[tuple[str | None, Fact]]:
    """(alias, fact) of the import declarations, single and grouped."""
    raw, listed = source.split("\n"), False
    for number, line in enumerate(code.split("\n"), 1):
        if re.match(r"import\b", line) or listed:
            spec = _go_import.match(raw[number - 1])
            if spec:
                alias = spec[1] if spec[1] not in (None, "_", ".") else spec[2].rsplit("/", 1)[-1]
                yield alias, Fact(path, "import", "import", spec[2], "", "", number, number)
            listed = "(" in line or (listed and ")" not in line)


def _go_specs(path: str, package: str, source: str, code: str, places: _Places) -> Iterator[Fact]:
    """Types, variables and constants of the package, single and in groups."""
    for m in _go_group.finditer(code):
        if m[2]:
            end = _close(code, m.end() - 1) - 1
            at, begins = m.end(), []
            depth = 0
            for part in code[m.end() : end].split("\n"):
                if not depth and part.strip():
                    begins.append(at + len(part) - len(part.lstrip()))
                depth += sum(part.count(c) for c in "({[") - sum(part.count(c) for c in ")}]")
                at += len(part) + 1
        else:
            begins = [m.end() + len(code[m.end() :]) - len(code[m.end() :].lstrip(" \t"))]
        for at in begins:
            line_end = code.find("\n", at) if "\n" in code[at:] else len(code)
            if m[1] == "type":
                spec = _go_type.match(code, at)
                if not spec:
                    continue
                brace = code.find("{", spec.start(2), spec.end(2))
                end = _close(code, brace) if brace >= 0 else line_end
                signature = re.match(r"(struct|interface\{\}|interface|[^{]*)", _words(spec[2]))[1].strip()
                yield Fact(path, "symbol", "type", spec[1], f"{package}.{spec[1]}", package, places.line(spec.start(1)), places.line(max(at, end - 1)), places.column(spec.start(1)), places.column(max(at, end - 1)) + 1, signature, _go_visibility(spec[1]), _doc(source, at), f"type:{package}:{spec[1]}")
                continue
            spec = _go_value.match(code, at)
            for name in re.finditer(r"\w+", spec[1]) if spec else ():
                begin = spec.start(1) + name.start()
                line = places.line(begin)
                yield Fact(path, "symbol", "value", name[0], f"{package}.{name[0]}", package, line, line, places.column(begin), places.column(begin) + len(name[0]), "", _go_visibility(name[0]), _doc(source, at), f"value:{package}:{name[0]}")


def parse_go(path: str, source: str) -> Iterator[tuple]:
    """Definitions and imports, scoped by the package clause, and the calls in functions and methods.

    A call is spelled as the source has it; an import's alias before the dot gives way to its path.
    """
    code, places = blank(source, "go"), _Places(source)
    found = _go_package.search(code)
    package = found[1] if found else _module(path)
    aliases = {}
    for alias, fact in _go_imports(path, source, code):
        aliases[alias] = fact.name
        yield fact
    symbols, calls = list(_go_specs(path, package, source, code, places)), []
    for m in _go_func.finditer(code):
        receiver = (m[1] or "").replace(" ", "")
        owner = f"{package}.{receiver}.{m[2]}" if receiver else f"{package}.{m[2]}"
        # parameters and results, then the body if there is one
        at = m.end()
        while at < len(code) and code[at] not in "{\n":
            at = _close(code, at) if code[at] in "([" else at + 1
            inner = re.match(r"[ \t]*(?:interface|struct)\s*\{", code[at:])
            if inner:
                at = _close(code, at + inner.end() - 1)
        body = at if at < len(code) and code[at] == "{" else None
        end = _close(code, body) if body is not None else at
        symbols.append(Fact(path, "symbol", "function", m[2], owner, receiver or package, places.line(m.start()), places.line(max(m.start(), end - 1)), 1, places.column(max(m.start(), end - 1)) + 1, _words(source[m.start() : at]), _go_visibility(m[2]), _doc(source, m.start()), f"func:{package}:{receiver}:{m[2]}"))
        inside = code[m.end() : end]
        for call in _go_call.finditer(inside, (body or end) - m.end()):
            start = _go_operand(inside, call.start(1))
            name = re.sub(r"\s+", "", inside[start : call.end(1)])
            if name in _go_words or not name:
                continue
            spelled = name
            left, _, tail = name.rpartition(".")
            if left in aliases:
                name = f"{aliases[left]}.{tail}"
            row = places.line(m.end() + call.end() - 1)
            calls.append(Fact(path, "call", "calls", name, owner, "", row, row, places.column(m.end() + call.start(1)), places.column(m.end() + call.end() - 1), evidence=spelled))
    yield from sorted(symbols, key=lambda s: (s.line, s.start_col))
    yield from calls


# languages with patterns

_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_ARGS = r"\((?:[^(){};]|\([^()]*\))*\)"
_TYPED = r"[\w.<>\[\],?&*:@ \t]*[\w>\]?*&]\s+"
#: Per language: style, definitions as (kind, pattern), scopes that are no symbols, and imports in the source itself. A pattern that has a group kind names it so. The kinds.
_LANGUAGES = {
    ".java": ("c", "java", [
        ("type", rf"\b(?:class|interface|enum|record)\s+{_NAME}"),
        ("function", rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|native|synchronized|abstract|default)\s+)*(?:<[^>]*>\s*)?{_TYPED}{_NAME}\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])"),
        ("function", rf"^[ \t]*(?:public|protected|private)\s+{_NAME}\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+)?(?=\{{)"),
    ], None, [r"^\s*import\s+([^;]+);"]),
    ".kt": ("c", "kotlin", [(None, rf"\b(?P<kind>class|interface|object)\s+{_NAME}"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?{_NAME}\s*(?=\()")], None, [r"^\s*import\s+([\w.*]+)"]),
    ".cs": ("c", "csharp", [
        ("type", rf"\b(?:class|interface|struct|enum|record)\s+{_NAME}"),
        ("function", rf"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|new|partial|abstract|extern)\s+)*{_TYPED}{_NAME}\s*(?:<[^>]*>)?\s*{_ARGS}\s*(?:where[^{{;]*)?(?=[{{;]|=>)"),
        ("function", rf"^[ \t]*(?:public|private|protected|internal)\s+{_NAME}\s*{_ARGS}\s*(?::[^{{;]*)?(?=\{{)"),
    ], None, [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"]),
    ".ts": ("c", "typescript", [
        (None, rf"\b(?P<kind>class|interface|enum)\s+{_NAME}"), ("type", rf"^[ \t]*(?:export\s+)?type\s+{_NAME}[^=\n]*="),
        ("function", rf"\bfunction\s*\*?\s*{_NAME}\s*(?:<[^>]*>)?\s*(?=\()"), ("function", rf"\b(?:const|let|var)\s+{_NAME}\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:\((?:[^()\n]|\([^()\n]*\))*\)\s*(?::[^=\n]*)?|[\w$]+\s*)=>"),
        ("method", rf"^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*{_NAME}\s*(?:<[^>]*>)?{_ARGS}\s*(?::[^{{;=\n]*)?(?=\{{)"),
    ], None, [r"^\s*import\s+[^'\"\n]*\s+from\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"^\s*export\s+[^'\"\n]*\s+from\s+['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"]),
    ".rs": ("rust", "rust", [(None, rf"\b(?P<kind>struct|enum|trait)\s+{_NAME}"), ("function", rf"\bfn\s+{_NAME}")], rf"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{{]*?>)?\s+(?:[\w:<>, ']+?\s+for\s+)?{_NAME}", [r"^\s*(?:pub\s+)?use\s+([^;]+);"]),
    ".rb": ("ruby", "ruby", [("class", r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)"), ("type", r"^[ \t]*module\s+(?P<name>[A-Z][\w:]*)"), ("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)")], None, [r"^\s*(?:require|require_relative)\s+['\"]([^'\"]+)['\"]"]),
    ".swift": ("c", "swift", [(None, rf"\b(?P<kind>class|struct|enum|protocol|actor)\s+(?!func\b|var\b|let\b){_NAME}"), ("function", rf"\bfunc\s+{_NAME}")], rf"^[ \t]*(?:\w+\s+)*extension\s+{_NAME}", [r"^\s*import\s+(\w+)"]),
    ".php": ("php", "php", [("type", rf"\b(?:class|interface|trait|enum)\s+{_NAME}"), ("function", rf"\bfunction\s+&?{_NAME}\s*(?=\()")], None, [r"^\s*use\s+([\w\\]+)", r"^\s*require(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]"]),
    ".cpp": ("c", "cpp", [
        (None, rf"(?:^|(?<=[{{;}}]))[ \t]*(?:template\s*<[^>]*>\s*)?(?:typedef\s+)?(?P<kind>class|struct|enum)\s+(?:class\s+)?{_NAME}\s*(?:final\s*)?(?::[^;{{]*)?(?=\{{)"),
        ("function", rf"(?:^|(?<=[{{;}}]))[ \t]*(?:template\s*<[^>]*>\s*)?(?:[\w:<>,*&~\[\]]+[ \t*&]+)+(?P<name>(?:\w+::)*~?[A-Za-z_]\w*)\s*{_ARGS}\s*(?:const|noexcept|override|final|\s)*(?::[^;{{}}]*)?(?=[{{;])"),
    ], r"^[ \t]*(?:inline\s+)?namespace\s+(?P<name>[A-Za-z_][\w:]*)\s*(?=\{)", [r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]"]),
}
_SAME = {".tsx": ".ts", ".js": ".ts", ".jsx": ".ts", ".mjs": ".ts", ".cjs": ".ts", ".mts": ".ts", ".cts": ".ts", ".kts": ".kt", ".c": ".cpp", ".cc": ".cpp", ".cxx": ".cpp", ".h": ".cpp", ".hh": ".cpp", ".hpp": ".cpp", ".hxx": ".cpp", ".ipp": ".cpp"}
_compiled = {e: (style, language, [(k, re.compile(p, re.M)) for k, p in defs], re.compile(scope, re.M) if scope else None, [re.compile(p, re.M) for p in imports]) for e, (style, language, defs, scope, imports) in _LANGUAGES.items()}
_any_call = re.compile(r"(?<![\w$.>:!])(?P<name>(?:::)?[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$~][\w$]*)*[?!]?)\s*(?:<[\w\s,.:]*>)?\(")
#: Words that make a typed head a statement, words that no definition is named by, and words before a bracket that call nothing.
_words_before = set("return new else throw case async await yield delete typeof goto do in of is as let var const match using package import".split())
_no_heads = set("if for while switch catch return else do try synchronized lock foreach using throw".split())
_no_calls = _words_before | set("if for while switch catch when until unless elsif elif function fn fun func def sizeof alignof decltype synchronized lock fixed foreach assert and or not super this self defined array list isset unset echo print include require require_once include_once struct class enum guard defer where init".split())


def _visibility(language: str, name: str, signature: str) -> str:
    if language in ("java", "csharp", "php", "typescript"):
        given = re.search(r"\b(public|private|protected|internal)\b", signature)
        if given:
            return given[1]
    tail = name.rsplit("::", 1)[-1]
    return "public" if tail[:1].isupper() else "private" if tail.startswith("_") else "module"


def _arity(code: str, at: int) -> str:
    """The parameters of a C++ function as types alone, so that a declaration and its definition agree."""
    begin = code.find("(", at)
    inside = code[begin + 1 : _close(code, begin) - 1] if begin >= 0 else ""
    kinds = []
    for part in inside.split(",") if inside.strip() else []:
        words = re.findall(r"[\w:]+|[*&<>\[\]]", part.split("=")[0])
        kinds.append("".join(words[:-1] if len(words) > 1 and re.match(r"\w", words[-1]) and words[-1] not in ("int", "char", "const", "long", "short", "double", "float") else words))
    return "(" + ",".join(kinds) + ")"


def _ruby_end(code: str, at: int) -> int:
    """The offset behind the line with the ``end`` of a definition: the first at its indentation."""
    begin = code.rfind("\n", 0, at) + 1
    indent = re.match(r"[ \t]*", code[begin:])[0]
    found = re.compile(rf"^{indent}end\b", re.M).search(code, at)
    return found.end() if found else (code.find("\n", at) if "\n" in code[at:] else len(code))


def _end(language: str, code: str, at: int) -> int:
    """The offset behind a definition whose head ends at ``at``: behind its block, its semicolon or its line."""
    if language == "ruby":
        return _ruby_end(code, at)
    while at < len(code) and code[at] not in "{;}":
        if code[at] in "([":
            at = _close(code, at)
        elif code[at] == "\n" and language in ("kotlin", "swift") and not re.match(r"\s*[{:]", code[at:]):
            return at
        else:
            at += 1
    return _close(code, at) if at < len(code) and code[at] == "{" else at


class _Span(NamedTuple):
    start: int
    end: int
    name: str
    kind: str


def parse_heuristic(path: str, source: str) -> Iterator[tuple]:
    """Definitions, imports and calls by patterns of the language.

    What a type, an extension or a namespace holds has it for its container; a call belongs to the
    innermost function around it, and outside of functions there are none.
    """
    dot = path.rfind(".")
    extension = path[dot:].lower() if dot >= 0 else ""
    rules = _compiled.get(_SAME.get(extension, extension))
    if not rules:
        return
    style, language, definitions, scope, imports = rules
    module, code, places = _module(path), blank(source, style), _Places(source)
    spans: list[_Span] = [_Span(m.start("name"), _end(language, code, m.end()), m["name"], "scope") for m in scope.finditer(code)] if scope else []
    heads: dict[int, tuple[str, re.Match]] = {}
    for kind, pattern in definitions:
        for m in pattern.finditer(code):
            name, at = m["name"], m.start("name")
            before = code[m.start() : at].split()
            if at in heads or name in _no_heads or (language in ("java", "csharp", "cpp") and before and before[-1] in _words_before):
                continue
            heads[at] = (m["kind"] if kind is None else kind, m)
    for at, (kind, m) in heads.items():
        spans.append(_Span(at, _end(language, code, m.end()), m["name"], kind))
    spans.sort(key=lambda s: (s.start, -s.end))
    symbols, functions = [], []
    around: list[_Span] = []
    for span in spans:
        while around and around[-1].end <= span.start:
            around.pop()
        boxes = [s for s in around if s.kind not in ("function", "method")]
        in_function = any(s.kind in ("function", "method") for s in around)
        around.append(span)
        if span.kind == "scope":
            continue
        kind, m = heads[span.start]
        ends = code[m.end() : m.end() + 1]
        if kind == "method" and not boxes:
            continue  # a block after a call outside of a class
        if kind == "function" and ends == ";":
            # a head without body: a declaration of C++, a method of a type elsewhere, or a statement
            if in_function or (language != "cpp" and not boxes):
                continue
            kind = "declaration" if language == "cpp" else kind
        if kind == "function" and in_function and language in ("java", "csharp", "cpp"):
            continue  # none of these nests functions
        if language == "cpp":
            qualified = "::".join([*(s.name for s in boxes), span.name])
            box = qualified.rsplit("::", 1)[0] if "::" in qualified else module
            name = qualified.rsplit("::", 1)[-1]
        else:
            box = boxes[-1].name if boxes else module
            name, qualified = span.name, f"{module}.{span.name}" if box == module else f"{module}.{box}.{span.name}"
        head = _words(source[code.rfind("\n", 0, span.start) + 1 : m.end()])
        signature = name + _arity(code, m.end("name")) if language == "cpp" and kind in ("function", "declaration") else head
        key = f"{'func' if kind in ('function', 'method', 'declaration') else 'type'}:{language}:{module}:{name}"
        last = max(span.start, span.end - 1)
        symbols.append(Fact(path, "symbol", kind, name, qualified, box, places.line(span.start), places.line(min(last, len(source) - 1)), places.column(span.start), places.column(min(last, len(source) - 1)) + 1, signature, _visibility(language, name, head), _doc(source, span.start), key))
        if kind in ("function", "method"):
            functions.append((span, qualified))
    yield from symbols
    # imports are looked for in the source, where their strings are, but only where there is code
    for pattern in imports:
        for m in pattern.finditer(source):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if code[at : at + 1].strip():
                line = places.line(at)
                yield Fact(path, "import", "import", _words(m[1]), "", "", line, line)
    starts = [f.start for f, _ in functions]
    for m in _any_call.finditer(code):
        name = m["name"]
        last = re.search(r"[A-Za-z_$~][\w$]*[?!]?$", name)
        if name in _no_calls or (language == "rust" and name.endswith("!")) or m.start("name") in heads or (last and m.start("name") + last.start() in heads):
            continue  # the head of a definition, as in int ns::run(...)
        place = bisect.bisect_right(starts, m.start()) - 1
        while place >= 0 and functions[place][0].end <= m.start():
            place -= 1
        if place < 0:
            continue
        line = places.line(m.start())
        spelled = re.sub(r"->|\?\.", ".", name).replace("$", "")
        yield Fact(path, "call", "calls", spelled, functions[place][1], "", line, line, places.column(m.start()), places.column(m.end()), evidence=name)


def parse(files: DataFrame) -> DataFrame:
    """Facts of files(path, content); what cannot be decoded is read with replacement characters, and a file that breaks a parser gives one fact ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                source = bytes(content).decode("utf-8", "replace").replace("\r\n", "\n") if content is not None else ""
                parser = parse_python if path.endswith((".py", ".pyi")) else parse_go if path.endswith(".go") else parse_heuristic
                try:
                    rows += list(parser(path, source))
                except (ValueError, IndexError, TypeError, RecursionError) as e:
                    rows.append(Fact(path, "error", type(e).__name__, str(e)[:200], "", "", 1, 1))
            yield pd.DataFrame(rows, columns=list(Fact._fields))

    return files.select("path", "content").mapInPandas(run, FACT)
