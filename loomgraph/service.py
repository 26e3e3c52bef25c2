"""Tools by name over an indexed graph: checked arguments in, an envelope of rows out."""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import agent, tools
from loomgraph.functions import text
from loomgraph.operators import detail as levels
from loomgraph.operators import context, graph, inventory, quality, resolve, scans, search, store
from loomgraph.plans import ingest
from loomgraph.sources import sinks
from loomgraph.streaming import sessions

ORDER = ["qualified_name", "start_line", "id"]
SCAN = "id long, scan_kind string, status string, started double, finished double, files_seen long, files_changed long, files_deleted long, error_text string"


@dataclass
class Page:
    """Rows with what the envelope tells beside them."""

    rows: DataFrame | list
    total: int | None = None
    truncated: bool | None = None
    next_cursor: str | None = None
    format: str = "json"
    more: dict | None = None


class Service:
    """``indexed`` is a tree's Index and ``root`` the tree; ``events`` names the folder of the session log, if there is one.

    With ``embeddings`` (id, embedding) and a ``provider`` of vectors semantic search is hybrid;
    ``ask`` is a language model for agentic_query.
    """

    def __init__(self, indexed: ingest.Index, events: str | None = None, root: str | None = None, embeddings: DataFrame | None = None, provider: Callable | None = None, ask: Callable[[str], str] | None = None, config: store.Config | None = None):
        self.g, self.events, self.root, self.embeddings, self.provider, self.ask, self.config = indexed, events, root, embeddings, provider, ask, config
        self.spark = indexed.files.sparkSession
        self.repos = store.upsert_repo(self.spark.createDataFrame([], "id long, root_path string, canonical_path string, updated_at timestamp"), root, os.path.realpath(root), F.current_timestamp()) if root else None
        self.scans: list[tuple] = []
        self.calls: list[tuple] = []
        self._scanned("full", time.time(), None)

    def call(self, name: str, /, _via: str = "direct", **arguments) -> dict:
        """The tool's rows as dictionaries; an error envelope for unknown tools, symbols and arguments out of bounds."""
        tool = getattr(self, f"_{name}", None)
        if name not in tools.TOOLS or tool is None:
            return {"ok": False, "error": f"unknown tool: {name}"}
        try:
            unknown = sorted(set(arguments) - set(tools.ARGUMENTS[name]))
            if unknown:
                raise ValueError(f"unknown arguments: {', '.join(unknown)}")
            found = tool(**arguments)
            out = self._told(found if isinstance(found, Page) else Page(found))
        except (ValueError, TypeError) as e:
            out = {"ok": False, "error": str(e)}
        self.calls.append((name, _via, str(arguments.get("format", "json")), str(arguments.get("detail", "card")), len(json.dumps(out, default=str))))
        return out

    def _told(self, page: Page) -> dict:
        if page.format == "compact":
            if isinstance(page.rows, list):
                raise ValueError("no compact form")
            columns = page.rows.columns
            lines = ["@" + "\t".join(columns), *[r[0] for r in sinks.compact(page.rows).collect()]]
            return tools.envelope(lines, total=page.total, truncated=page.truncated)
        rows = page.rows if isinstance(page.rows, list) else [r.asDict(recursive=True) for r in page.rows.collect()]
        return tools.envelope(rows, total=page.total, truncated=page.truncated, next_cursor=page.next_cursor, **(page.more or {}))

    # pages

    def _cut(self, df: DataFrame, order: list, limit: int, offset: int, format: str = "json", total: int | None = None) -> Page:
        """A page of a total order; one row more is looked for, to tell whether there are others."""
        if format not in tools.FORMATS:
            raise ValueError(f"format must be one of {', '.join(tools.FORMATS)}")
        limit = tools.page_limit(limit)
        rows = inventory.page(df, order, limit + 1, offset)
        if format == "compact":
            return Page(inventory.page(df, order, limit, offset), total, rows.count() > limit, format=format)
        found = [r.asDict(recursive=True) for r in rows.collect()]
        return Page(found[:limit], total, len(found) > limit)

    def _symbols(self, df: DataFrame, limit: int, offset: int, detail: str = "card", format: str = "json", total: int | None = None) -> Page:
        """A page of symbols at a level of detail: keys are cut first, the page's few rows are fetched whole behind them."""
        level = levels.level(detail)
        limit = tools.page_limit(limit, level)
        if format not in tools.FORMATS:
            raise ValueError(f"format must be one of {', '.join(tools.FORMATS)}")
        keys = [r[0] for r in inventory.page(df.select(*ORDER), ORDER, limit + 1, offset).select("id").collect()]
        wide = self.g.symbols.where(F.col("id").isin(keys[:limit]))
        rows = inventory.cards(wide, self.g.files)
        if level == "skeleton":
            rows = rows.join(levels.skeletons(wide, self.g.symbols), "id", "left")
        elif level in ("excerpt", "full"):
            rows = rows.join(levels.source_windows(wide, self._contents(wide), level), "id", "left")
        return Page(rows.orderBy(*ORDER), total, len(keys) > limit, format=format)

    def _contents(self, symbols: DataFrame) -> DataFrame:
        if self.root is None:
            raise ValueError("no tree to read sources from")
        files = self.g.files.join(symbols.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi")
        paths = [(r["id"], r["path"]) for r in files.select("id", "path").collect()]  # a page's files
        read = self.spark.read.format("binaryFile").load([os.path.join(self.root, p) for _, p in paths]) if paths else None
        if read is None:
            return self.spark.createDataFrame([], "file_id long, content string")
        names = self.spark.createDataFrame(paths, "file_id long, name string")
        return read.join(F.broadcast(names), F.col("path").endswith(F.concat(F.lit("/"), F.col("name")))).select("file_id", F.col("content").cast("string").alias("content"))

    def _targets(self, symbol: str | None, symbol_id: int | None = None) -> DataFrame:
        found = self.g.symbols.where(F.col("id") == symbol_id) if symbol_id is not None else inventory.lookup(self.g.symbols, symbol or "")
        if found.isEmpty():
            raise ValueError("symbol not found")
        return found

    # index

    def _scanned(self, kind: str, began: float, error: str | None) -> None:
        told = {"files_seen": 0, "files_changed": 0, "files_deleted": 0} if error else ingest.summary(self.g)
        self.scans.append((len(self.scans) + 1, kind, "failed" if error else "completed", began, time.time(), told["files_seen"], told["files_changed"], told["files_deleted"], error or ""))

    def _scan(self, kind: str, run: Callable[[], ingest.Index]) -> list[dict]:
        began = time.time()
        try:
            self.g = run()
        except Exception as e:
            self._scanned(kind, began, f"{type(e).__name__}: {e}"[:500])
            raise ValueError(f"scan failed: {e}") from e
        self._scanned(kind, began, None)
        return [{"scan_id": self.scans[-1][0], **ingest.summary(self.g), "phases": self.g.phases}]

    def _tree(self, repo_root: str | None, repo_path: str | None) -> str:
        root = repo_root or repo_path or self.root
        if not root:
            raise ValueError("repo not indexed")
        self.root = root
        if self.repos is not None:
            self.repos = store.upsert_repo(self.repos, root, os.path.realpath(root), F.current_timestamp())
        return root

    def _index_repo(self, repo_root: str | None = None, repo_path: str | None = None, force: bool = False, paths: list[str] | None = None) -> list[dict]:
        root = self._tree(repo_root, repo_path)
        if paths:
            return self._scan("paths", lambda: ingest.update(self.spark, self.g, root, paths, force, config=self.config))
        return self._scan("full", lambda: ingest.index(self.spark, root, config=self.config))

    def _update_graph(self, repo_root: str | None = None, repo_path: str | None = None, force: bool = False, paths: list[str] | None = None) -> list[dict]:
        root = self._tree(repo_root, repo_path)
        return self._scan("update", lambda: ingest.update(self.spark, self.g, root, paths, force, config=self.config))

    # search

    def _find_symbol(self, query: str, limit: int = 20, offset: int = 0, detail: str = "card", format: str = "json") -> Page:
        return self._symbols(search.search_symbols(self.g.symbols, query), limit, offset, detail, format)

    _search_symbols = _find_symbol

    def _hits(self, query: str, limit: int) -> DataFrame:
        """Hybrid where there are embeddings and a vector for the query, else by tokens."""
        if self.provider is not None and store.has_rows(self.embeddings):
            try:
                vector = self.provider([query])[0]
            except (OSError, ValueError):
                vector = None
            if vector is not None and any(vector):
                return search.hybrid(self.g.symbols, self.g.files, self.embeddings, query, vector, limit)
        return search.semantic(self.g.symbols, self.g.files, query, limit)

    def _search_semantic(self, query: str, limit: int = 20, offset: int = 0) -> Page:
        limit, offset = tools.page_limit(limit), max(0, offset)
        found = [r.asDict(recursive=True) for r in self._hits(query, limit + offset + 1).collect()][offset:]
        return Page(found[:limit], None, len(found) > limit)

    # graph

    def _find_callers(self, symbol: str | None = None, symbol_id: int | None = None, limit: int = 20, offset: int = 0, detail: str = "card", format: str = "json") -> Page:
        target = self._targets(symbol, symbol_id)
        spelling = symbol or target.first()["name"]
        return self._symbols(graph.all_callers(self.g.adjacent, self.g.unbound, self.g.symbols, target, spelling), limit, offset, detail, format)

    def _find_callees(self, symbol: str | None = None, symbol_id: int | None = None, limit: int = 20, offset: int = 0, detail: str = "card", format: str = "json") -> Page:
        return self._symbols(graph.all_callees(self.g.adjacent, self.g.unbound, self.g.symbols, self._targets(symbol, symbol_id)), limit, offset, detail, format)

    def _get_impact_radius(self, symbols: list[str] | None = None, files: list[str] | None = None, depth: int = 2, limit: int = 20, offset: int = 0, detail: str = "card", format: str = "json") -> Page:
        names, paths = list(symbols or []), list(files or [])
        if len(names) + len(paths) > tools.LIMITS["batch"]:
            raise ValueError(f"at most {tools.LIMITS['batch']} symbols and files")
        seeds = self.g.symbols.where(F.col("qualified_name").isin(names) | F.col("name").isin(names))
        inside = self._file_ids(paths).select(F.col("id").alias("file_id")) if paths else None
        reached = graph.impact(self.g.adjacent, self.g.symbols, seeds, tools.check("depth", depth), inside)
        return self._symbols(reached, limit, offset, detail, format, total=reached.count())

    def _file_ids(self, paths: list[str]) -> DataFrame:
        wanted = self.spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "place int, named string").select("place", text.canonical_path(F.col("named")).alias("path"))
        return store.live(self.g.files).join(F.broadcast(wanted), "path").select("id", "place", "path")

    def _trace_dependencies(self, symbol: str, direction: str = "downstream", depth: int = 3, limit: int = 500, offset: int = 0, format: str = "json") -> Page:
        if direction not in ("upstream", "downstream", "both"):
            raise ValueError("direction must be upstream, downstream or both")
        reached = graph.trace(self.g.adjacent, self._targets(symbol), direction, tools.check("depth", depth))
        rows = reached.join(self.g.symbols.select("id", "qualified_name", "kind", "name", "file_id"), "id").join(self.g.files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").drop("file_id")
        return self._cut(rows, ["depth", "qualified_name", "id"], limit, offset, format, total=rows.count())

    def _graph_analytics(self, analysis: str, limit: int = 20) -> DataFrame:
        limit = tools.page_limit(limit)
        if analysis == "pagerank":
            named = graph.pagerank(self.g.edges).join(self.g.symbols, "id").join(self.g.files.select(F.col("id").alias("file_id"), "path"), "file_id")
            rows = named.select("id", "rank", "path", "qualified_name", "kind", "start_line")
            return inventory.top_with_ties(rows, "rank", ["path", "qualified_name", "kind", "start_line", "id"], limit) if not rows.isEmpty() else rows
        if analysis == "coupling":
            return graph.coupling(self.g.edges, self.g.symbols, self.g.files, limit)
        if analysis == "cycles":
            return graph.cycle_paths(self.g.edges, self.g.symbols, self.g.files, limit).orderBy("place")
        raise ValueError("analysis must be pagerank, coupling or cycles")

    def _cross_language_links(self, limit: int = 500, offset: int = 0) -> Page:
        return self._cut(resolve.cross_language_links(resolve.import_bridges(self.g.imports, self.g.files), self.g.symbols), ["src", "dst"], limit, offset)

    # quality

    def _find_dead_code(self, limit: int = 20, offset: int = 0, format: str = "json") -> Page:
        return self._cut(inventory.dead_code(self.g.symbols, self.g.edges, self.g.files), ["path", "start_line", "id"], limit, offset, format)

    def _detect_frameworks(self) -> DataFrame:
        return quality.frameworks(self.g.files, self.g.imports).orderBy("framework").limit(len(quality.FRAMEWORKS))

    def _audit(self, examples: int = 5, fail_on: str = "error") -> Page:
        calls = self.g.calls.select(F.xxhash64("src", "line", "dst_name").alias("id"), "src", "dst", F.lit("calls").alias("kind"), "strategy", "confidence")
        found = quality.audit(calls, self.g.symbols, self.g.files, tools.check("examples", examples))
        rows = [r.asDict(recursive=True) for r in found.orderBy(F.col("severity") != "error", "code").collect()]
        status = "error" if any(r["severity"] == "error" for r in rows) else "warning" if rows else "ok"
        return Page(rows, more={"status": status, "failed": quality.fails(status, fail_on)})

    # tests

    def _related(self, targets: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
        in_tests = self.g.files.where(text.is_test_file(F.col("path")))
        if exclude is not None:
            in_tests = in_tests.join(exclude.select("id"), "id", "left_anti")
        tests = self.g.symbols.join(in_tests.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        calls = self.g.edges.join(tests.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()
        return resolve.related_tests(self.g.test_links, calls, tests, in_tests, targets)

    def _find_related_tests(self, symbol: str | None = None, file: str | None = None, files: list[str] | None = None, limit: int = 20, offset: int = 0, format: str = "json") -> Page:
        order = [F.desc("score"), "path", "symbol"]
        if files:
            if len(files) > tools.LIMITS["batch"]:
                raise ValueError(f"at most {tools.LIMITS['batch']} files")
            in_tests = self.g.files.where(text.is_test_file(F.col("path")))
            tests = self.g.symbols.join(in_tests.select(F.col("id").alias("file_id")), "file_id", "left_semi")
            calls = self.g.edges.join(tests.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()
            wanted = self._file_ids(files).select(F.col("id").alias("file_id"), "place")
            return self._cut(resolve.related_tests_of_files(self.g.test_links, calls, tests, in_tests, self.g.symbols, wanted, limit + offset), order, limit, offset, format)
        if file is not None:
            own = store.file_id(self.g.files, file)
            return self._cut(self._related(self.g.symbols.join(own.select(F.col("id").alias("file_id")), "file_id", "left_semi"), own), order, limit, offset, format)
        return self._cut(self._related(self._targets(symbol)), order, limit, offset, format)

    # context

    def _context_for_task(self, task: str, max_files: int = 10, max_symbols: int = 30, include_tests: bool = True, include_callers: bool = True, max_tokens: int = 4000, cursor: str | None = None) -> Page:
        """Direct hits, their callers and callees, and related tests, ranked, cut to the token budget and gone on with by a cursor."""
        if not isinstance(max_tokens, int) or not 0 < max_tokens <= 200_000:
            raise ValueError("max_tokens must be 1 to 200000")
        tools.check("context", max_symbols)
        scan = self.g.scan_id
        direct = context.direct_hits(self._hits(task, max(1, max_symbols)), self.g.symbols, self.g.files)
        related = self._related(direct.select("id")) if include_tests else None
        every = context.candidates(direct, self.g.symbols, self.g.files, self.g.adjacent if include_callers else None, related, max_files)
        ranked = search.rank_context(every, max(1, max_files)).orderBy(F.desc("score"), "path", "qualified_name").limit(max_symbols)
        rows = [r.asDict() | {"relevance": round(max(0.1, 1 - 0.05 * (r["file_rank"] - 1)), 2)} for r in ranked.collect()]
        if self.g.scan_id != scan:
            raise ValueError("the graph has changed meanwhile")
        options = [max_files, max_symbols, include_tests, include_callers, max_tokens]
        state = {"repo": tools.fingerprint(self.root), "scan": scan, "task": tools.fingerprint(task), "options": tools.fingerprint(options), "ranking": tools.fingerprint([(r["path"], r["qualified_name"], r["score"]) for r in rows])}
        offset = tools.read_cursor(cursor, state) if cursor else 0
        kept, more = self._within(rows, offset, state, max_tokens)
        return Page(kept, len(rows), more is not None, next_cursor=more)

    @staticmethod
    def _within(rows: list[dict], offset: int, state: dict, budget: int) -> tuple[list[dict], str | None]:
        """The greedy prefix of the rows from ``offset`` whose answer, envelope and cursor included, measures at most ``budget`` tokens; ValueError if not one fits."""
        size = lambda x: math.ceil(len(json.dumps(x, default=str).encode()) / 4)
        left = [r | {"cost": size(r)} for r in rows[offset:]]
        reserve = size(tools.envelope([], total=len(rows), truncated=True, next_cursor=tools.cursor(state | {"offset": len(rows)}))) if budget > 400 else 0
        kept, spent = [], reserve
        for r in left:
            if spent + r["cost"] > budget:
                break
            kept.append(r)
            spent += r["cost"]
        while kept and reserve and size(tools.envelope(kept, total=len(rows), truncated=True, next_cursor=tools.cursor(state | {"offset": offset + len(kept)}))) > budget:
            kept.pop()
        if left and not kept:
            raise ValueError(f"nothing fits into {budget} tokens; the first symbol takes {reserve + left[0]['cost']}")
        done = offset + len(kept) >= len(rows)
        return kept, None if done else tools.cursor(state | {"offset": offset + len(kept)})

    def _benchmark_tokens(self, task: str | None = None) -> Page:
        row = inventory.repository_size(self.g.files).first().asDict()
        context = row["sample_bytes"]
        if task:
            paths = [r["path"] for r in self._hits(task, 200).collect()]
            first = list(dict.fromkeys(paths))[:10]
            context = self.g.files.where(F.col("path").isin(first)).agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
        whole, part = row["bytes"] // 4, context // 4
        saved = round(100 * (whole - part) / whole, 2) if whole else 0.0
        return Page([row | {"context_tokens": part, "saved_percent": saved, "dollars_saved": round((whole - part) * 3 / 1e6, 6)}])

    # inventory

    def _list_files(self, path_filter: str = "", limit: int = 20, offset: int = 0, format: str = "json") -> Page:
        files = store.live(self.g.files).select("id", "path", "language", "size_bytes").where(F.lower("path").like(path_filter.lower() + "%"))
        return self._cut(files, ["path", "id"], limit, offset, format)

    def _graph_stats(self) -> DataFrame:
        return inventory.stats(store.live(self.g.files), self.g.symbols, self.g.edges).orderBy("metric")

    def _architecture_overview(self) -> DataFrame:
        return inventory.overview(store.live(self.g.files), self.g.symbols, self.g.edges)

    def _supported_languages(self) -> DataFrame:
        return inventory.supported_languages(self.spark)

    def _list_repos(self, limit: int = 20, offset: int = 0) -> Page:
        if self.repos is None:
            raise ValueError("repo not indexed")
        return self._cut(self.repos.select("id", "root_path", "canonical_path"), ["id"], limit, offset)

    def _scan_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.scans, SCAN)

    def _list_scans(self, limit: int = 20, offset: int = 0) -> Page:
        return self._cut(self._scan_table(), [F.desc("id")], limit, offset)

    def _latest_scan_errors(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return scans.latest_errors(self._scan_table(), tools.page_limit(limit), offset)

    # sessions

    def _session(self) -> DataFrame:
        if self.events is None:
            raise ValueError("no session log")
        return sessions.read_log(self.spark, self.events)

    def _session_log(self, event_type: str, key: str = "", value: str = "", metadata: str = "{}", session_id: str = "") -> list[dict]:
        if self.events is None:
            raise ValueError("no session log")
        sessions.log(self.spark, self.events, event_type, key, value, metadata, session_id)
        return [{"event_type": event_type, "key": key}]

    def _session_history(self, session_id: str | None = None, event_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return sessions.history(self._session(), session_id, event_type, tools.check("page", limit), offset)

    def _session_hot_files(self, session_id: str | None = None, limit: int = 20) -> DataFrame:
        return sessions.hot_keys(self._session(), session_id=session_id, limit=tools.page_limit(limit))

    def _session_context(self, session_id: str | None = None) -> DataFrame:
        return sessions.context(self._session(), session_id)

    # meta

    def _agentic_query(self, query: str, max_steps: int = agent.STEPS) -> list[dict]:
        if self.ask is None:
            raise ValueError("no language model is configured")
        return [agent.run(self.ask, self.call, query, tools.check("steps", max_steps))]

    def _usage_stats(self, reset: bool = False, limit: int = 25) -> list[dict]:
        if not self.calls:
            return []
        calls = self.spark.createDataFrame(self.calls, "tool string, via string, format string, detail string, bytes long")
        found = [r.asDict() for r in inventory.usage(calls, ["tool", "via", "format", "detail"], "bytes", limit=tools.page_limit(limit)).collect()]
        if reset:
            self.calls.clear()
        return found

    def _tool_search(self, query: str, limit: int = 5, include_schema: bool = False) -> list[dict]:
        return [{"name": n, "score": s, "description": tools.TOOLS[n][1], **({"arguments": tools.ARGUMENTS[n]} if include_schema else {})} for n, s in tools.search(query, limit)]

    def _tool_call(self, name: str, arguments: dict | None = None) -> Page:
        if name in ("tool_call", "tool_search"):
            raise ValueError(f"unknown tool: {name}")
        out = self.call(name, _via="gateway", **(arguments or {}))
        if not out["ok"]:
            raise ValueError(out["error"])
        return Page(out["data"] if isinstance(out["data"], list) else [out["data"]], out.get("total"), out.get("truncated"), out.get("next_cursor"))
