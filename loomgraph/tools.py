"""The tool surface: names and arguments, ranking of tools for a query, argument checks, the result envelope and cursors."""

from __future__ import annotations

import base64
import hashlib
import json

#: Tools: category, what they are for, and their arguments. The names.
_TABLE = """
index_repo         | index     | index a tree anew                        | repo_root repo_path force paths
update_graph       | index     | index what has changed in a tree         | repo_root repo_path force paths
find_symbol        | search    | find symbols by name or qualified name   | query limit offset detail format
search_symbols     | search    | full-text search over symbols            | query limit offset detail format
search_semantic    | search    | token, vector or hybrid search           | query limit offset
find_callers       | graph     | callers of a symbol                      | symbol symbol_id limit offset detail format
find_callees       | graph     | callees of a symbol                      | symbol symbol_id limit offset detail format
get_impact_radius  | graph     | what a change reaches                    | symbols files depth limit offset detail format
trace_dependencies | graph     | dependencies up or down                  | symbol direction depth limit offset format
graph_analytics    | graph     | pagerank, coupling and cycles            | analysis limit
cross_language_links | graph   | links between languages                  | limit offset
find_dead_code     | quality   | symbols that nothing uses                | limit offset format
audit              | quality   | findings about the graph                 | examples fail_on
detect_frameworks  | quality   | frameworks in use                        |
find_related_tests | tests     | tests of a symbol or file                | symbol file files limit offset format
context_for_task   | context   | ranked context for a task                | task max_files max_symbols include_tests include_callers max_tokens cursor
benchmark_tokens   | context   | tokens saved by context                  | task
list_files         | inventory | files by path                            | path_filter limit offset format
graph_stats        | inventory | counts of the graph                      |
architecture_overview | inventory | degrees, kinds and folders            |
supported_languages | inventory | languages and extensions                |
list_repos         | inventory | repositories                             | limit offset
list_scans         | inventory | scans, newest first                      | limit offset
latest_scan_errors | inventory | scans that failed and why                | limit offset
session_log        | session   | append an event to the session log       | event_type key value metadata session_id
session_history    | session   | events of a session                      | session_id event_type limit offset
session_hot_files  | session   | files used most                          | session_id limit
session_context    | session   | decisions, facts and tasks               | session_id
agentic_query      | agent     | answer a question by calling tools       | query max_steps
usage_stats        | meta      | calls and tokens by tool                 | reset limit
tool_search        | meta      | find tools for a purpose                 | query limit include_schema
tool_call          | meta      | call a tool by name                      | name arguments
"""
TOOLS: dict[str, tuple[str, str]] = {}
ARGUMENTS: dict[str, list[str]] = {}
for _row in _TABLE.strip().split("\n"):
    _name, _category, _purpose, _arguments = (x.strip() for x in _row.split("|"))
    TOOLS[_name], ARGUMENTS[_name] = (_category, _purpose), _arguments.split()
#: Tools that a search shows behind all others.
HIDDEN = ("usage_stats", "tool_search", "tool_call")
LIMITS = {"page": 500, "depth": 10, "batch": 500, "context": 500, "examples": 100, "steps": 20}
#: Rows of a page by level of detail. Fixed values.
PAGES = {"card": 500, "skeleton": 200, "excerpt": 50, "full": 50}
FORMATS = ("json", "compact")


def score(name: str, category: str, description: str, term: str) -> int:
    """How well a tool fits a term: exact name 100, a segment 40, else 30 for a common prefix of four letters; category 20, description 10."""
    term = term.lower()
    segments = name.split("_")
    total = 100 if name == term else 0
    if term in segments:
        total += 40
    elif any(min(len(s), len(term)) >= 4 and (s.startswith(term) or term.startswith(s)) for s in segments):
        total += 30
    return total + 20 * (term == category) + 10 * (term in description)


def search(query: str, limit: int = 5) -> list[tuple[str, int]]:
    """(tool, score), best first, hidden tools behind the others; 1 to 20 of them."""
    scored = [(n, sum(score(n, c, d, t) for t in query.lower().split())) for n, (c, d) in TOOLS.items()]
    return sorted([x for x in scored if x[1] > 0], key=lambda x: (x[0] in HIDDEN, -x[1], x[0]))[: max(1, min(limit, 20))]


def check(kind: str, value: int) -> int:
    """The value, or an error above the bound: nothing is trimmed silently."""
    if not isinstance(value, int) or isinstance(value, bool) or value < 0 or value > LIMITS[kind]:
        raise ValueError(f"{kind} must be 0 to {LIMITS[kind]}")
    return value


def page_limit(value: int, detail: str = "card") -> int:
    """A page's limit, 0 for the default of 20; an error above what the level of detail allows."""
    if not isinstance(value, int) or isinstance(value, bool) or value < 0 or value > PAGES[detail]:
        raise ValueError(f"limit must be 0 to {PAGES[detail]} at detail {detail}")
    return value or 20


def envelope(data, **more) -> dict:
    return {"ok": True, "data": data, **{k: v for k, v in more.items() if v is not None}}


def fingerprint(value) -> str:
    """Sixteen digits of the hash of anything that JSON can hold."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def cursor(state: dict) -> str:
    """Page state as text; its digest guards it against other scans, tasks and rankings."""
    return base64.urlsafe_b64encode(json.dumps({"s": state, "d": fingerprint(state)}).encode()).decode().rstrip("=")


def read_cursor(text: str, expected: dict) -> int:
    """The offset; ValueError if the cursor is damaged or belongs to something else."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        state, digest, offset = found["s"], found["d"], int(found["s"]["offset"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if fingerprint(state) != digest or offset < 0 or any(state.get(k) != v for k, v in expected.items()):
        raise ValueError("stale cursor")
    return offset
