"""Traversal and ranking over edges(src, dst)."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import identity
from loomgraph.operators.resolve import TYPES
from loomgraph.storage import stash, stash_by, work_dir

MAX_DEPTH = 10
#: Up to so many ids are looked up by a filter that reaches the files' statistics; more by a join.
FEW = 1000
#: Up to so many ids of a closure are kept by the driver, 2 MB; more in the shared folder.
LOCAL_IDS = 200_000
#: Seeds of a context, at most, whose edges are looked up by their ids. Fixed value.
SEEDS = 200
#: Up to so many nodes have a number at the driver and, sent out, at each worker: 32 MB.
LOCAL_NODES = 4_000_000
#: Edges that are packed into one row.
CHUNK = 1 << 18
#: Such rows in one file: 16 MB at most.
ROWS = 8
#: Neighbours that a task holds before it leaves all but the first of each seed: 32 MB a side.
HELD = 1 << 22
#: Seeds, as a power of two, whose neighbours are put together at once.
SEED_BITS = 15
#: Pairs of files that one task takes in; what is left of a larger graph is reduced by joins first.
LOCAL_PAIRS = 2_000_000


@dataclass
class Adjacency:
    """The same edges(src, dst) twice, so that either end can be looked up in files sorted by it."""

    by_src: DataFrame
    by_dst: DataFrame


def adjacency(edges: DataFrame | Adjacency) -> Adjacency:
    if isinstance(edges, Adjacency):
        return edges
    bound = edges.where("dst is not null").select("src", "dst")
    return Adjacency(bound, bound)


def _touching(edges: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``edges`` whose ``column`` is one of ids(id)."""
    few = [r[0] for r in ids.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return edges.where(F.col(column).isin(few))
    return edges.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def callers(edges: DataFrame | Adjacency, targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct symbols with a bound edge to one of ``targets`` (id)."""
    hit = _touching(adjacency(edges).by_dst, "dst", targets.select("id")).select(F.col("src").alias("id")).distinct()
    return symbols.join(hit, "id", "left_semi")


def callees(edges: DataFrame | Adjacency, sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct symbols that one of ``sources`` (id) has a bound edge to."""
    hit = _touching(adjacency(edges).by_src, "src", sources.select("id")).select(F.col("dst").alias("id")).distinct()
    return symbols.join(hit, "id", "left_semi")


def unresolved_callers(calls: DataFrame, symbols: DataFrame, target: DataFrame, spelling: str) -> DataFrame:
    """Callers known by an unbound name only: the spelling itself or a boundary suffix of a target's qualified name, in the target's language."""
    names = target.select("language", F.explode(F.concat(F.array(F.lit(spelling), "qualified_name"), text.proper_suffixes(F.col("qualified_name")))).alias("dst_name")).distinct()
    hit = calls.join(names, ["language", "dst_name"], "left_semi").select(F.col("src").alias("id")).distinct()
    return symbols.join(hit, "id", "left_semi")


def all_callers(edges: DataFrame | Adjacency, unbound: DataFrame, symbols: DataFrame, target: DataFrame, spelling: str) -> DataFrame:
    """Bound callers of ``target`` and those of unbound calls (src, file_id, language, dst_name) whose name may mean it.

    A name may mean a target of its language if it is the spelling, a boundary suffix of the
    qualified name, or extends it at a boundary. A bare name means a Go symbol only in
    the folder and package of the call, and a type of a gated language only in its own file.
    """
    place = symbols.select(F.col("id").alias("src"), F.substring_index("qualified_name", ".", 1).alias("package"))
    t = target.select("id", "language", "qualified_name", "file_id", F.col("kind").isin(*TYPES).alias("is_type"))
    suffixes = F.array_distinct(F.concat(F.array(F.lit(spelling), "qualified_name"), text.boundary_suffixes(F.col("qualified_name"))))
    spelled = t.select("language", F.explode(suffixes).alias("dst_name"), F.col("file_id").alias("t_file"), "is_type", F.substring_index("qualified_name", ".", 1).alias("t_package")).distinct()
    near = unbound.join(spelled, ["language", "dst_name"]).join(place, "src", "left")
    bare = text.bare(F.col("dst_name"))
    in_scope = F.when(bare & (F.col("language") == "go"), F.col("package") == F.col("t_package")).when(bare & F.col("is_type") & F.col("language").isin(*identity.GATED), F.col("file_id") == F.col("t_file")).otherwise(True)
    longer = unbound.join(identity.extended_names(unbound, target), ["dst_name", "language"], "left_semi").select(F.col("src").alias("id"))
    hit = near.where(in_scope).select(F.col("src").alias("id")).unionByName(longer).distinct()
    bound = callers(edges, target, symbols).select("id")
    return symbols.join(bound.unionByName(hit).distinct(), "id", "left_semi")


def all_callees(edges: DataFrame | Adjacency, unbound: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Bound callees of ``sources`` (id) and what the names of their unbound calls may mean, by the identity cascade."""
    names = _touching(unbound, "src", sources.select("id")).select(F.col("dst_name").alias("name"), "language").distinct()
    meant = identity.identity_cascade(names, symbols).select("id")
    return symbols.join(callees(edges, sources, symbols).select("id").unionByName(meant).distinct(), "id", "left_semi")


def _found(edges: DataFrame, column: str, ids: DataFrame | list[int], other: str) -> DataFrame:
    """(id): the other ends of the edges whose ``column`` is one of ``ids``."""
    if isinstance(ids, list) and len(ids) > FEW:
        ids = F.broadcast(_ids(edges, ids))  # LOCAL_IDS at most
        hit = edges.join(ids.select(F.col("id").alias(column)), column, "left_semi")
    elif isinstance(ids, list):
        hit = edges.where(F.col(column).isin(ids))
    else:
        hit = _touching(edges, column, ids)
    return hit.select(F.col(other).alias("id"))


def _ids(like: DataFrame, ids: list[int], depths: list[int] | None = None) -> DataFrame:
    columns = {"id": pa.array(ids, pa.int64())} | ({} if depths is None else {"depth": pa.array(depths, pa.int32())})
    schema = "id long" if depths is None else "id long, depth int"
    return like.sparkSession.createDataFrame(pa.table(columns), schema) if ids else like.sparkSession.createDataFrame([], schema)


def closure(edges: DataFrame | Adjacency, seeds: DataFrame, depth: int, both: bool = True) -> DataFrame:
    """(id, depth): what is reached from seeds (id) within ``depth`` steps, at its least depth; seeds only if reached again (depth 0 rows are left out).

    A level's frontier is looked up in the edges; what was seen before drops out. While no more
    than LOCAL_IDS are reached the driver keeps them; beyond, levels are written to the shared
    folder, so plans stay short and lost executors cost one level. Small frontiers are looked
    up by their ids, which prunes edges that are stored in order.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_DEPTH}")
    adjacent = adjacency(edges)
    frontier: DataFrame | list[int] = seeds.select(F.col("id").cast("long").alias("id")).distinct()
    held: dict[int, int] | None = {}
    seen = None
    for level in range(1, depth + 1):
        near = _found(adjacent.by_src, "src", frontier, "dst")
        if both:
            near = near.unionByName(_found(adjacent.by_dst, "dst", frontier, "src"))
        near = near.distinct()
        if held is not None:
            found = near.limit(LOCAL_IDS + 1).toArrow()["id"].to_pylist()
            fresh = [i for i in found if i not in held]
            if len(found) <= LOCAL_IDS and len(held) + len(fresh) <= LOCAL_IDS:
                held.update(dict.fromkeys(fresh, level))
                frontier = fresh
                continue
            seen, held = stash(_ids(near, list(held), list(held.values())), "level"), None
        fresh_ids = stash(near.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)), "level")
        seen = seen.unionByName(fresh_ids)
        frontier = fresh_ids.select("id")
    return F.broadcast(_ids(adjacent.by_src, list(held), list(held.values()))) if held is not None else seen


def impact(edges: DataFrame | Adjacency, symbols: DataFrame, seeds: DataFrame, depth: int = 2, files: DataFrame | None = None) -> DataFrame:
    """Symbols within ``depth`` steps either way, with the depth; all symbols of an id that is reached. Seeds are in it only if reached again; the symbols of ``files`` (file_id) are seeds too and always in it, at depth 0."""
    if files is None:
        return symbols.join(closure(edges, seeds, depth), "id")
    inside = symbols.join(files.select("file_id").distinct(), "file_id", "left_semi").select("id").distinct()
    reached = closure(edges, seeds.select("id").unionByName(inside), depth)
    return symbols.join(reached.join(inside, "id", "left_anti").unionByName(inside.withColumn("depth", F.lit(0))), "id")


def snapshot(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, n): edges with either end among nodes(id)."""
    n = nodes.select("id").distinct()
    out = edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    into = edges.join(n.select(F.col("id").alias("dst")), "dst", "left_semi").join(n.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst")
    return out.unionByName(into).groupBy("src", "dst").agg(F.count("*").alias("n"))


def trace(edges: DataFrame | Adjacency, seeds: DataFrame, direction: str = "downstream", depth: int = 3) -> DataFrame:
    """(id, depth) along or against the edges; the seeds are not reached again. ``both`` gives downstream, as the catalogue has it."""
    adjacent = adjacency(edges)
    if direction == "upstream":
        turned = lambda df: df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        adjacent = Adjacency(turned(adjacent.by_dst), turned(adjacent.by_src))
    reached = closure(adjacent, seeds, depth, both=False)
    return reached.join(seeds.select("id"), "id", "left_anti")


def _rows_in(edges: DataFrame, ids) -> DataFrame:
    """(into, begin, src), all binary: about CHUNK edges a row, grouped by target, each end as its place in the sorted ``ids`` (a broadcast)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def packed():
            src, dst = (np.searchsorted(ids.value, np.concatenate([b[k] for b in held])).astype(np.int32) for k in (0, 1))
            order = np.argsort(dst, kind="stable")
            into, begin = np.unique(dst[order], return_index=True)
            return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (into, begin, src[order])], ["into", "begin", "src"])

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst")])
            count += batch.num_rows
            if count >= CHUNK:
                yield packed()
                held, count = [], 0
        if count:
            yield packed()

    return edges.mapInArrow(run, "into binary, begin binary, src binary")


def _pagerank_here(edges: DataFrame, out: DataFrame, nodes: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(id, rank) of at most LOCAL_NODES nodes: the driver keeps a number for each and sends them out, the edges stay where they are, and each round's sums come back."""
    spark = edges.sparkSession
    ids = np.sort(nodes.toArrow()["id"].to_numpy())
    n, counted = len(ids), out.toArrow()
    degree = np.ones(n)
    degree[np.searchsorted(ids, counted["src"].to_numpy())] = counted["out"].to_numpy()
    at = spark.sparkContext.broadcast(ids)
    path, packed = work_dir(spark, "rows"), _rows_in(edges, at)
    packed.write.option("compression", "zstd").option("maxRecordsPerFile", ROWS).parquet(path)  # a reader's batch takes in a file
    rows = spark.read.schema(packed.schema).parquet(path)
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        share = spark.sparkContext.broadcast(rank / degree)

        def step(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = []
                for begin, src in zip(batch.column("begin").to_pylist(), batch.column("src").to_pylist(), strict=True):
                    sums.append(np.add.reduceat(share.value[np.frombuffer(src, np.int32)], np.frombuffer(begin, np.int32)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("into"), pa.array(sums, pa.binary())], ["into", "sums"])

        found = rows.mapInArrow(step, "into binary, sums binary").toArrow()
        given = np.zeros(n)
        for into, sums in zip(found["into"].to_pylist(), found["sums"].to_pylist(), strict=True):
            given[np.frombuffer(into, np.int32)] += np.frombuffer(sums)  # a chunk has a target once
        rank = (1 - damping) / n + damping * given
        share.destroy()
    at.destroy()
    return stash(spark.createDataFrame(pa.table({"id": ids, "rank": rank}), "id long, rank double"), "ranks")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, local: int = LOCAL_NODES) -> DataFrame:
    """(id, rank): multi-edges count, nodes without out-edges lose their mass, ranks rounded to six places.

    Edges are written once, by target. Up to ``local`` nodes a round sends a number for each to
    the edges, which are packed by target, and brings back the sums. Beyond, edges shrink to
    distinct pairs with weights, kept in buckets by source, so a round moves sums by target
    only: the pairs stay where they are. A node without in-edges has the
    base rank in every round and needs no row. Ranks are written every fifth round.
    """
    edges = edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    edges = stash(edges.repartition("dst"), "by-target")
    out = stash(edges.groupBy("src").agg(F.count("*").alias("out")), "out")
    nodes = stash(out.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")).distinct()).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    if n <= local:
        return _pagerank_here(edges, out, nodes, rounds, damping).select("id", F.round("rank", 6).alias("rank"))
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    weighted = stash_by(pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w")), "weights", "src")
    base, ranks = (1 - damping) / n, None
    for k in range(rounds):
        from_src = F.lit(1.0 / n) if ranks is None else F.coalesce("rank", F.lit(base))
        joined = weighted if ranks is None else weighted.join(ranks, weighted.src == ranks.id, "left")
        ranks = joined.groupBy("dst").agg((F.lit(base) + damping * F.sum(from_src * F.col("w"))).alias("rank")).withColumnRenamed("dst", "id")
        if k % 5 == 4:
            ranks = stash(ranks, "ranks")
    ranks = stash(ranks, "ranks") if rounds % 5 else ranks
    return nodes.join(ranks, "id", "left").select("id", F.round(F.coalesce("rank", F.lit(base)), 6).alias("rank"))


def file_pairs(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(a, b, n): edges from symbols of file a to symbols of another file b. Sums by symbol pair come first."""
    file_of = symbols.select("id", "file_id")
    thin = edges.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    both = thin.join(file_of.select(F.col("id").alias("src"), F.col("file_id").alias("a")), "src").join(file_of.select(F.col("id").alias("dst"), F.col("file_id").alias("b")), "dst")
    return both.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def coupling(edges: DataFrame, symbols: DataFrame, files: DataFrame, limit: int | None = 20) -> DataFrame:
    """(file_a, file_b, n, label) by descending count, then paths."""
    path = files.select("id", "path")
    named = file_pairs(edges, symbols).join(path.select(F.col("id").alias("a"), F.col("path").alias("file_a")), "a").join(path.select(F.col("id").alias("b"), F.col("path").alias("file_b")), "b")
    out = named.select("file_a", "file_b", "n", text.coupling_label(F.col("n")).alias("label"))
    return out if limit is None else out.orderBy(F.desc("n"), "file_a", "file_b").limit(limit)


def _knots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nodes of the pairs (a, b) that share a strongly connected component with another, by one depth-first walk (Tarjan, 1972) without recursion."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    src, dst = both[: len(a)], both[len(a) :]
    order = np.argsort(src, kind="stable")
    after, begin = dst[order].tolist(), np.searchsorted(src[order], np.arange(len(nodes) + 1)).tolist()
    index, low, on, found = [0] * len(nodes), [0] * len(nodes), bytearray(len(nodes)), []
    clock, stack = 1, []
    for root in range(len(nodes)):
        if index[root]:
            continue
        walk = [(root, begin[root])]
        index[root] = low[root] = clock
        clock += 1
        stack.append(root)
        on[root] = 1
        while walk:
            v, at = walk.pop()
            if at < begin[v + 1]:
                walk.append((v, at + 1))
                w = after[at]
                if not index[w]:
                    index[w] = low[w] = clock
                    clock += 1
                    stack.append(w)
                    on[w] = 1
                    walk.append((w, begin[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if walk:
                low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
            if low[v] == index[v]:
                knot = []
                while True:
                    w = stack.pop()
                    on[w] = 0
                    knot.append(w)
                    if w == v:
                        break
                if len(knot) > 1:
                    found += knot
    return nodes[np.array(sorted(found), np.int64)]


def files_on_cycles(pairs: DataFrame, local: int = LOCAL_PAIRS) -> DataFrame:
    """(id): nodes of pairs(a, b) that reach themselves through another.

    Nodes without a way in or out are peeled off, a few layers at a time. What is left, if at
    most ``local`` pairs, is walked in one task. Else the least label is spread forwards from
    all nodes at once and, among nodes of one label, backwards from its owner: who gets it
    both ways shares the owner's cycles, and every label settles one component, so
    all of them shrink in the same rounds.
    """
    live = stash(pairs.select("a", "b").where("a <> b").distinct(), "pairs")
    found = None
    while True:
        for _ in range(3):
            kept = live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            live = kept.join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        live = stash(live, "pairs")
        if live.limit(local + 1).count() <= local:

            def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(_knots(table["a"].to_numpy(), table["b"].to_numpy()), pa.int64())], ["id"])

            last = live.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(walk, "id long")
            return last if found is None else found.unionByName(last)
        label = _spread(live)
        inner = live.join(label.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(label.select(F.col("id").alias("b"), F.col("label").alias("y")), "b").where("x = y")
        inner = stash(inner.select("a", "b", F.col("x").alias("label")), "inner")
        owners = label.where("id = label").select("id")
        back = _reach(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), owners)
        # an owner alone is a component of one; with others it is a knot
        many = label.join(back, "id", "left_semi").groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
        group = stash(label.join(back, "id", "left_semi").join(many, "label", "left_semi").select("id"), "group")
        found = group if found is None else found.unionByName(group)
        live = stash(live.join(back.select(F.col("id").alias("a")), "a", "left_anti").join(back.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"), "pairs")


def _spread(pairs: DataFrame) -> DataFrame:
    """(id, label): the least node that reaches it, itself included."""
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    label = stash(nodes.withColumn("label", F.col("id")), "label")
    while True:
        given = pairs.join(label.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("given"))
        after = stash(label.join(given, "id", "left").select("id", F.least("label", "given").alias("label"), F.coalesce(F.col("given") < F.col("label"), F.lit(False)).alias("moved")), "label")
        label = after.select("id", "label")
        if after.where("moved").isEmpty():
            return label


def _reach(pairs: DataFrame, start: DataFrame) -> DataFrame:
    seen = frontier = stash(start, "reach")
    while True:
        fresh = pairs.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = stash(fresh.join(seen, "id", "left_anti"), "reach")
        if frontier.isEmpty():
            return seen
        seen = stash(seen.unionByName(frontier), "reach")


def cycles(pairs: list[tuple[str, str]], limit: int) -> list[list[str]]:
    """Cycles closed by back edges of a depth-first walk over sorted roots and successors; for a bounded list of file pairs on the driver."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        after.setdefault(a, []).append(b)
    state, out = {}, []
    for root in sorted(after):
        if root in state:
            continue
        path, walk = [root], [iter(after[root])]
        state[root] = 1
        while walk:
            step = next(walk[-1], None)
            if step is None:
                state[path.pop()] = 2
                walk.pop()
            elif state.get(step) == 1:
                out.append([*path[path.index(step) :], step])
                if len(out) == limit:
                    return out
            elif step not in state:
                state[step] = 1
                path.append(step)
                walk.append(iter(after.get(step, [])))
    return out


def cycle_paths(edges: DataFrame, symbols: DataFrame, files: DataFrame, limit: int = 20, local: int = LOCAL_PAIRS) -> DataFrame:
    """(place, length, path): the first ``limit`` cycles of files, each from and to the same path.

    The walk is one task's. Over more than ``local`` pairs of files it sees only those between
    files on cycles; then it may enter a cycle at another of its files.
    """
    pairs = stash(file_pairs(edges, symbols).select("a", "b"), "file-pairs")
    if pairs.limit(local + 1).count() > local:
        on = stash(files_on_cycles(pairs, local), "on-cycles")
        pairs = pairs.join(on.select(F.col("id").alias("a")), "a", "left_semi").join(on.select(F.col("id").alias("b")), "b", "left_semi")
    name = files.select("id", "path")
    named = pairs.join(name.select(F.col("id").alias("a"), F.col("path").alias("x")), "a").join(name.select(F.col("id").alias("b"), F.col("path").alias("y")), "b").select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [p for batch in batches for p in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        found = cycles(rows, limit) if limit > 0 else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([len(c) - 1 for c in found], pa.int32()), pa.array(found, pa.list_(pa.string()))], ["place", "length", "path"])

    return named.coalesce(1).mapInArrow(run, "place int, length int, path array<string>")


class _Inner:
    """Spans seen so far, as the two best for each end: by increasing end, the least (length, id) of those that end there or later and the least of those with another id."""

    def __init__(self):
        self.ends, self.tops = [], []

    def best(self, end: int, own: int) -> tuple[int, int] | None:
        """(length, id) of the shortest span up to ``end`` or further whose id is not ``own``."""
        at = bisect.bisect_left(self.ends, end)
        if at == len(self.ends):
            return None
        first, second = self.tops[at]
        return second if first[1] == own else first

    @staticmethod
    def _with(top: tuple, key: tuple[int, int]) -> tuple:
        first, second = top
        if first is None or key[1] == first[1]:
            return (key if first is None or key < first else first), second
        if key < first:
            return key, first
        return (first, key) if second is None or key < second else top

    def add(self, start: int, end: int, which: int) -> None:
        key, at = (end - start, which), bisect.bisect_left(self.ends, end)
        after = self.tops[at] if at < len(self.ends) else (None, None)
        top = self._with(after, key)
        if top == after:  # nor does it better any earlier end
            return
        to = at + (at < len(self.ends) and self.ends[at] == end)
        ends, tops = [end], [top]
        while at > 0 and (top := self._with(self.tops[at - 1], key)) != self.tops[at - 1]:
            at -= 1
            if top != tops[-1]:
                ends.append(self.ends[at])
                tops.append(top)
        if at > 0 and self.tops[at - 1] == tops[-1]:
            at -= 1
        self.ends[at:to], self.tops[at:to] = ends[::-1], tops[::-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by file, start, falling end, with the symbols of a span before its containers."""
    file, held = None, _Inner()
    for batch in batches:
        ids, owners, spans = [], [], []
        for f, start, end, which, role in zip(*(batch.column(c).to_pylist() for c in ("file_id", "start_line", "end_line", "id", "role")), strict=True):
            if f != file:
                file, held = f, _Inner()
            if role:
                held.add(start, end, which)
            elif (owner := held.best(end, which)) is not None:
                ids.append(which)
                spans.append(owner[0])
                owners.append(owner[1])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.int64()), pa.array(owners, pa.int64())], ["id", "span", "container"])


def members(symbols: DataFrame, containers: DataFrame) -> DataFrame:
    """(id, container): the innermost container whose span of lines holds a symbol's, in the same file, and is larger; of equally long ones the least id.

    An id that several symbols bear has one row, with the innermost of all their containers, and none of its own spans is one.
    One sort and one sweep per file, whatever its symbols: what a task holds is the spans still open.
    """
    rows = lambda df, role: df.select(F.col("file_id").cast("long").alias("file_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("id").cast("long").alias("id"), F.lit(role).alias("role"))
    every = rows(symbols, 0).unionByName(rows(containers, 1)).where("file_id is not null and start_line is not null and end_line is not null")
    held = every.repartition("file_id").sortWithinPartitions("file_id", "start_line", F.desc("end_line"), "role", "id").mapInArrow(_members, "id long, span long, container long")
    return held.groupBy("id").agg(F.min(F.struct("span", "container")).alias("best")).select("id", "best.container")


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by file, line, spans before points, and spans of one start by falling end."""
    file, held = None, []  # open spans [start, end, id], innermost last, ends falling
    for batch in batches:
        files, lines, owners = [], [], []
        for f, line, end, which, role in zip(*(batch.column(c).to_pylist() for c in ("file_id", "line", "end_line", "id", "role")), strict=True):
            if f != file:
                file, held = f, []
            if role:
                while held and held[-1][1] < line:
                    held.pop()
                files.append(f)
                lines.append(line)
                owners.append(held[-1][2] if held else None)
            elif held and held[-1][:2] == [line, end]:
                held[-1][2] = None  # two equal spans
            else:
                while held and held[-1][1] <= end and held[-1][0] < line:
                    held.pop()
                held.append([line, end, which])
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(lines, pa.int64()), pa.array(owners, pa.int64())], ["file_id", "line", "owner"])


def attribute(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(file_id, line) with owner: the innermost span (file_id, id, start_line, end_line) that holds the line, i.e. the last to begin and of these the first to end; null if two equal spans do.

    One sort and one sweep per file.
    """
    long = lambda c, name: F.col(c).cast("long").alias(name)
    s = spans.select(long("file_id", "file_id"), long("start_line", "line"), long("end_line", "end_line"), long("id", "id"), F.lit(0).alias("role"))
    p = points.select(long("file_id", "file_id"), long("line", "line"), F.lit(None).cast("long").alias("end_line"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("role")).distinct()
    swept = s.unionByName(p).where("file_id is not null and line is not null").repartition("file_id").sortWithinPartitions("file_id", "line", "role", F.desc("end_line"), "id").mapInArrow(_owners, "file_id long, line long, owner long")
    return points.join(swept, ["file_id", "line"], "left")


def _canonical() -> list:
    """Symbols in their order, nulls behind all others as in the SQL."""
    return [F.asc_nulls_last(c) for c in ("qualified_name", "start_line", "id")]


class _Places:
    """Numbers of ids: their places in the sorted ``ids``, by a table where these lie close together."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.table = ids, None
        if len(ids) and int(ids[-1]) - int(ids[0]) < 4 * len(ids) + 1024:
            self.table = np.full(int(ids[-1]) - int(ids[0]) + 1, -1, np.int32)
            self.table[ids - ids[0]] = np.arange(len(ids), dtype=np.int32)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        """The number of each, or -1."""
        if not len(self.ids):
            return np.full(len(found), -1, np.int32)
        if self.table is not None:
            inside = (found >= self.ids[0]) & (found <= self.ids[-1])
            return np.where(inside, self.table[np.where(inside, found, self.ids[0]) - self.ids[0]], -1)
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        return np.where(self.ids[at] == found, at, -1).astype(np.int32)


def _firsts(keys: np.ndarray, fanout: int) -> np.ndarray:
    """The distinct keys (a seed's number << 32 | a rank) in order, of each seed the first ``fanout``."""
    keys = np.sort(keys)
    keys = keys[np.diff(keys, prepend=-1) != 0]
    seed = keys >> 32
    return keys[np.r_[np.ones(min(fanout, len(keys)), bool), seed[fanout:] != seed[:-fanout]]]


@dataclass
class _Ranked:
    """Of the sorted ``ids`` the k-th is borne by the symbols of ``ranks[first[k]:first[k+1]]``; ``wanted`` tells by number which are seeds, None if any end of an edge is one."""

    ids: np.ndarray
    first: np.ndarray
    ranks: np.ndarray
    wanted: np.ndarray | None

    @staticmethod
    def of(by_rank: np.ndarray, seeds: np.ndarray | None) -> _Ranked:
        ids = np.unique(by_rank if seeds is None else np.concatenate([by_rank, seeds]))
        order = np.argsort(by_rank, kind="stable")
        first = np.searchsorted(by_rank[order], ids)
        return _Ranked(ids, np.append(first, len(by_rank)).astype(np.int32), order.astype(np.int32), None if seeds is None else np.isin(ids, seeds))

    def spread(self, number: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``number``, rank) for the first ``fanout`` symbols of each; -1 has none."""
        begin = self.first[number]
        size = np.where(number < 0, 0, np.minimum(self.first[number + 1] - begin, fanout))
        at = np.repeat(np.arange(len(number)), size)
        return at, self.ranks[begin[at] + np.arange(len(at)) - (np.cumsum(size) - size)[at]]


def _near(edges: DataFrame, shared, fanout: int, parts: int) -> DataFrame:
    """(side, part, keys, seeds): of what some edges tell of each seed the first ``fanout``, as keys of numbers and ranks.

    A seed that no symbol bears has no number: its id stands in ``seeds`` and its keys are ranks. Null has the number behind the last.
    """
    most, bits = HELD, SEED_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Ranked = shared.value
        places, null = _Places(own.ids), len(own.ids)
        held, strange = ([], []), ([], [])
        counts, odd = [0, 0], [0, 0]

        def rows(side: int, found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            part, keys, seeds = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([side] * len(found), pa.int32()), pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(seeds, pa.binary())], ["side", "part", "keys", "seeds"])

        def cut(side: int, last: bool) -> Iterator[pa.RecordBatch]:
            keys = _firsts(np.concatenate(held[side]), fanout)
            held[side][:], counts[side] = [keys], len(keys)
            if len(keys) and (last or len(keys) > most // 2):
                at = np.searchsorted(keys, np.arange(parts + 1) << (bits + 32))
                yield rows(side, [(k, keys[at[k] : at[k + 1]].tobytes(), b"") for k in np.flatnonzero(np.diff(at)).tolist()])
                held[side][:], counts[side] = [], 0

        def cut_strange(side: int, last: bool) -> Iterator[pa.RecordBatch]:
            seeds, ranks = _strange_firsts(strange[side], fanout)
            strange[side][:], odd[side] = [(seeds, ranks)], len(seeds)
            if len(seeds) and (last or len(seeds) > most // 2):
                part = seeds % parts
                yield rows(side, [(k, ranks[part == k].tobytes(), seeds[part == k].tobytes()) for k in np.unique(part).tolist()])
                strange[side][:], odd[side] = [], 0

        for batch in batches:
            ends = []
            for name in ("src", "dst"):
                column = batch.column(name)
                values = column.fill_null(0).to_numpy()
                number = places(values)
                missing = np.asarray(column.is_null()) if column.null_count else None
                ends.append((values, number, missing))
            for side, ((_, near, gone), (values, seed, missing)) in enumerate((ends, ends[::-1])):
                at, rank = own.spread(near if gone is None else np.where(gone, -1, near), fanout)
                if missing is not None:
                    seed = np.where(missing, null if own.wanted is None else -1, seed)
                seed = seed[at]
                known = seed >= 0 if own.wanted is None else (seed >= 0) & own.wanted[seed]
                if not known.all():
                    if own.wanted is None:
                        strange[side].append((values[at][~known], rank[~known]))
                        odd[side] += len(strange[side][-1][0])
                    seed, rank = seed[known], rank[known]
                held[side].append(seed.astype(np.int64) << 32 | rank)
                counts[side] += len(seed)
                if counts[side] >= most:
                    yield from cut(side, False)
                if odd[side] >= most:
                    yield from cut_strange(side, False)
        for side in (0, 1):
            if counts[side]:
                yield from cut(side, True)
            if odd[side]:
                yield from cut_strange(side, True)

    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).mapInArrow(run, "side int, part int, keys binary, seeds binary")


def _strange_firsts(held: list[tuple[np.ndarray, np.ndarray]], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, ranks): as ``_firsts`` for seeds without numbers."""
    seeds, number = np.unique(np.concatenate([s for s, _ in held]), return_inverse=True)
    keys = _firsts(number.astype(np.int64) << 32 | np.concatenate([r for _, r in held]), fanout)
    return seeds[keys >> 32], (keys & 0xFFFFFFFF).astype(np.int32)


def _placed(shared, fanout: int):
    most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by side and part."""
        own: _Ranked = shared.value
        by_rank = np.empty(len(own.ranks), np.int64)
        by_rank[own.ranks] = np.repeat(own.ids, np.diff(own.first))
        ids, null = np.append(own.ids, 0), len(own.ids)
        group, held, strange, count = None, [], [], 0

        def batch_of(seeds: np.ndarray, missing: np.ndarray | None, ranks: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
            n = len(seeds)
            head = np.flatnonzero(begins)
            place = np.arange(n) - np.repeat(head, np.diff(np.append(head, n))) + 1
            side = pa.repeat("callee" if group[0] else "caller", n)
            return pa.RecordBatch.from_arrays([pa.array(seeds, mask=missing), side, pa.array(by_rank[ranks]), pa.array(place.astype(np.int32))], ["seed", "side", "id", "place"])

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                keys = _firsts(np.concatenate(held), fanout)
                seed = keys >> 32
                yield batch_of(ids[seed], seed == null, keys & 0xFFFFFFFF, np.diff(seed, prepend=-1) != 0)
            if strange:
                seeds, ranks = _strange_firsts(strange, fanout)
                yield batch_of(seeds, None, ranks, np.r_[True, seeds[1:] != seeds[:-1]])

        for batch in batches:
            for side, part, keys, seeds in zip(batch.column("side").to_pylist(), batch.column("part").to_pylist(), batch.column("keys"), batch.column("seeds"), strict=True):
                if (side, part) != group:
                    if group is not None:
                        yield from told()
                    group, held, strange, count = (side, part), [], [], 0
                if len(seeds.as_buffer()):
                    strange.append((np.frombuffer(seeds.as_buffer(), np.int64), np.frombuffer(keys.as_buffer(), np.int32)))
                    count += len(strange[-1][0])
                else:
                    held.append(np.frombuffer(keys.as_buffer(), np.int64))
                    count += len(held[-1])
                if count >= most:
                    held = [_firsts(np.concatenate(held), fanout)] if held else []
                    strange = [_strange_firsts(strange, fanout)] if strange else []
                    count = 0
        if group is not None:
            yield from told()

    return run


def _neighbours_here(edges: DataFrame, seeds: np.ndarray | None, symbols: DataFrame, fanout: int) -> DataFrame:
    """(seed, side, id, place) of symbols whose ranks are sent out: the edges are read once, where they are, and what is shuffled are the first ``fanout`` of each seed that a task has seen."""
    by_rank = symbols.orderBy(*_canonical()).select("id").toArrow()["id"].to_numpy()
    ranked = _Ranked.of(by_rank, seeds)
    shared, parts = edges.sparkSession.sparkContext.broadcast(ranked), (len(ranked.ids) >> SEED_BITS) + 1
    cut = _near(edges, shared, fanout, parts).repartition("side", "part").sortWithinPartitions("side", "part")
    return cut.select("side", "part", "keys", "seeds").mapInArrow(_placed(shared, fanout), "seed long, side string, id long, place int")


def seed_neighbours(edges: DataFrame | Adjacency, seeds: DataFrame | None, symbols: DataFrame, fanout: int = 10, local: int = LOCAL_NODES) -> DataFrame:
    """(seed, side, id, place): up to ``fanout`` callers and callees of each seed in canonical order, an id for each symbol that bears it.

    Without ``seeds`` every end of an edge is one, null and ids that no symbol bears included. Up to ``local``
    symbols are sorted once and their ranks sent out to the edges; beyond, all pairs are joined and sorted.
    """
    symbols = symbols.select(F.col("id").cast("long").alias("id"), "qualified_name", "start_line").where("id is not null")
    if seeds is None:
        both = edges.by_src if isinstance(edges, Adjacency) else edges
        if symbols.count() <= local:
            return _neighbours_here(both, None, symbols, fanout)
        into = out = both
    else:
        adjacent, s = adjacency(edges), seeds.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
        few = [r[0] for r in s.limit(SEEDS + 1).collect()]
        if len(few) <= SEEDS:
            into, out = adjacent.by_dst.where(F.col("dst").isin(few)), adjacent.by_src.where(F.col("src").isin(few))
        else:
            if symbols.count() <= local:
                many = s.limit(local + 1).toArrow()["id"].to_numpy()
                if len(many) <= local:
                    return _neighbours_here(adjacent.by_src, many, symbols, fanout)
            into, out = adjacent.by_dst.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi"), adjacent.by_src.join(s.withColumnRenamed("id", "src"), "src", "left_semi")
    up = into.select(F.col("dst").alias("seed"), F.lit("caller").alias("side"), F.col("src").alias("id"))
    down = out.select(F.col("src").alias("seed"), F.lit("callee").alias("side"), F.col("dst").alias("id"))
    near = up.unionByName(down).distinct().join(symbols, "id")
    order = Window.partitionBy("seed", "side").orderBy(*_canonical())
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= fanout).select("seed", "side", "id", "place")
