"""MinHash near-deduplication by fast similarity sketching.

Sketch (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017): in
round i every element of the set is hashed to one bin and to a value in [i, i+1)
and each of the t bins keeps its least value. A bin that is still empty after
t rounds is filled in round t + bin, in which all elements fall into that bin, so
every coordinate fills and, unlike one-permutation hashing, the number of equal
coordinates is concentrated as t independent draws would be. Large sets are
done after one or two rounds, i.e. O(t log t + n) instead of O(t n).

Steps: sketch per document -> copies (equal sets, 128-bit digest) collapse into
one class -> bands of the class representatives -> every member of a bucket is
compared with the bucket's hub, its smallest id, exactly, on full shingle sets ->
components -> the members of a hub that are still in different components are
compared with one another, exactly too: as all of them are known as the hub's set less
some and plus some shingles, this takes only those differences, in blocks.
So all pairs of a bucket are decided, while no bucket is expanded to its pairs, none
is capped, and what travels grows with the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.skew import hot_keys, join_on
from loomgraph.llm.words import mix, row_blocks, shingle_sets, utf8, word_hashes
from loomgraph.storage import stash

ROWS, BANDS = 6, 30
#: A block of the second comparison: members outside the hub's main component, and members of the hub.
MINOR, MEMBERS = 512, 2048
#: Cells of the count matrices of a block that are worked on at once.
CELLS = 1 << 25
#: Members that meet their hub in one group of the verification.
TOGETHER = 64
#: The largest filter of wanted ids has 2**SIEVE bits, 32 MB: enough for 27 million ids.
SIEVE = 28
#: Set in every hash of a difference, so that none is taken for a place in the hub's set.
ADDED = np.uint64(1 << 63)


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates per non-empty set; for equal sets equal, else equal in each with the Jaccard similarity as probability."""
    counts = np.array([len(s) for s in sets], np.int64)
    if not len(counts):
        return np.zeros((0, size), np.uint64)
    out = np.full(len(sets) * size, ~np.uint64(0), np.uint64)
    items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    empty = ~np.uint64(0)
    for i in range(2 * size):
        h = mix(items + np.uint64((0xD1B54A32D192ED03 * (i + 1)) % (1 << 64)))
        place = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, owner * size + place, np.uint64(i << 48) | (mix(h) & np.uint64((1 << 48) - 1)))
        open_sets = (out.reshape(-1, size) == empty).any(axis=1)
        if not open_sets.any():
            break
        live = open_sets[owner]
        items, owner = items[live], owner[live]
    return out.reshape(-1, size)


def band_keys(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per band, the band's number hashed in."""
    keys = np.empty((len(sketch), bands), np.uint64)
    for j in range(bands):
        h = np.full(len(sketch), j + 1, np.uint64)
        for k in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[:, j * rows + k])
        keys[:, j] = h
    return keys.view(np.int64)


def _profiles(size: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for lo, hi in row_blocks(at):
                sets = shingle_sets(*word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]), size)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                digest: list = [None] * len(sets)
                for k, row in zip(full, band_keys(sketches([sets[k] for k in full], rows * bands), rows, bands), strict=True):
                    keys[k], digest[k] = row, hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def sieve(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids(doc_id) as 64-bit words: ten bits an id in three places, in all at most 2**SIEVE bits.

    Bits are put together by a sum over words, so what the driver takes in is the filter itself.
    Beyond 2**SIEVE / 10 ids more and more others pass, until it holds nothing back; it
    never holds back one of its own.
    """
    n = ids.count()
    bits = min(SIEVE, max(10, (10 * n).bit_length()))
    place = lambda k: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(k)), 64 - bits)
    at = ids.select(F.explode(F.array(*[place(k) for k in range(3)])).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _sets(size: int, shared):
    """Sets of the texts whose places (three of a row) are all in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, may = shared.value, np.ones(len(batch), bool)
            bits = np.uint64(len(words) * 64 - 1).item().bit_length()
            for k in range(3):
                at = batch.column(f"h{k}").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
                may &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            batch = batch.select(["doc_id", "text"]).filter(pa.array(may))
            data, at = utf8(batch.column("text"))
            for lo, hi in row_blocks(at):
                sets = [s.tobytes() for s in shingle_sets(*word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]), size)]
                digests = [hashlib.blake2b(s, digest_size=16).digest() if s else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "digest", "shingles"])

    return run


def sets_of(source: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles) for wanted(doc_id, digest), a row for each, from the texts of ``source``.

    The scan itself leaves out what the filter of wanted ids holds back, so only sets, and of few
    others, are shuffled to meet the wanted rows, which decide exactly.
    """
    shared = source.sparkSession.sparkContext.broadcast(sieve(wanted.select("doc_id")))  # 2**SIEVE bits at most
    marked = source.select("doc_id", "text", *[F.xxhash64("doc_id", F.lit(k)).alias(f"h{k}") for k in range(3)])
    found = marked.where("doc_id is not null").mapInArrow(_sets(size, shared), "doc_id long, digest binary, shingles binary")
    return found.hint("merge").join(wanted.hint("merge"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "shingles")


def _with_hub(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (hub, salt, member): a group's first row, without member, is the hub's own set."""
        hub_id, hub = None, None
        for batch in batches:
            a, b, sets = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles")
            out: list[list] = [[] for _ in _STAR]
            for k in range(len(a)):
                own = np.frombuffer(sets[k].as_buffer(), np.uint64)
                if b[k] is None:
                    hub_id, hub = a[k], own.copy()
                elif hub_id == a[k]:
                    at = np.searchsorted(hub, own)
                    at[at == len(hub)] = 0
                    held = hub[at] == own
                    common = int(np.count_nonzero(held))
                    missing = np.ones(len(hub), bool)
                    missing[at[held]] = False
                    row = (a[k], b[k], len(hub), len(own), 100 * common >= percent * (len(hub) + len(own) - common), np.concatenate([np.flatnonzero(missing).astype(np.uint64), own[~held] | ADDED]).tobytes(), len(hub) - common)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, _STAR, strict=True)], [n for n, _ in _STAR])

    return run


#: A member b of hub a: sizes of both sets, whether they are linked, and the difference: places in the hub's set that b lacks, then hashes that only b has.
_STAR = [("a", pa.int64()), ("b", pa.int64()), ("hub_n", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("difference", pa.binary()), ("lacks", pa.int64())]


def with_hub(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The columns of _STAR for pairs (a, b): linked if 100 * intersection >= percent * union on full sets.

    Members travel to their hub's set; a hub with many members is spread over
    groups of about TOGETHER, each with a copy of the hub's set.
    """
    spread = stash(pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("groups")), "spread")
    dealt = stash(pairs.hint("merge").join(spread.hint("merge"), "a").select("a", "b", F.expr("pmod(xxhash64(b), groups)").alias("salt")), "dealt")
    members = dealt.hint("merge").join(sets.hint("merge"), dealt.b == sets.doc_id).select("a", "salt", "b", "shingles")
    hubs = dealt.select("a", "salt").distinct().hint("merge").join(sets.hint("merge"), F.col("a") == F.col("doc_id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    near = members.unionByName(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return near.select("a", "b", "shingles").mapInArrow(_with_hub(percent), "a long, b long, hub_n long, n long, linked boolean, difference binary, lacks long")


class _Block:
    """The minor members of a block, ready to be compared with others by the differences from their common hub.

    With the places a member lacks and the hashes it adds, the intersection of two members is
    |hub| - lacks(x) - lacks(y) + |both lack| + |both add|; the last two are counts of
    common elements of the differences (hashes have the top bit, places never do).
    """

    def __init__(self, percent: int, hub_n: int):
        self.percent, self.hub_n, self.rows, self.parts, self.parent = percent, hub_n, [], None, {}

    def add(self, row: tuple) -> None:
        self.rows.append(row)

    def _root(self, label: int) -> int:
        while self.parent.setdefault(label, label) != label:
            label = self.parent[label]
        return label

    def _prepare(self) -> None:
        self.parts, lo = [], 0
        while lo < len(self.rows):
            hi, total = lo, 0
            while hi < len(self.rows) and (hi == lo or (total + len(self.rows[hi][4])) * (hi + 1 - lo) <= CELLS):
                total += len(self.rows[hi][4])
                hi += 1
            part = self.rows[lo:hi]
            universe, at = np.unique(np.concatenate([r[4] for r in part]), return_inverse=True)
            table = np.zeros((len(universe), len(part)), np.uint8)
            table[at, np.repeat(np.arange(len(part)), [len(r[4]) for r in part])] = 1
            self.parts.append((universe, table, *(np.array([r[k] for r in part], np.int64) for k in range(4))))
            lo = hi

    def meet(self, others: list[tuple]) -> Iterator[tuple[int, int]]:
        """Links between the block's members and ``others`` that join components not yet joined by this block."""
        if self.parts is None:
            self._prepare()
        for universe, table, ids, label, n, lacks in self.parts:
            lo = 0
            while lo < len(others):
                hi, total = lo, 0
                while hi < len(others) and (hi == lo or (total + len(others[hi][4])) * len(ids) <= CELLS):
                    total += len(others[hi][4])
                    hi += 1
                group = others[lo:hi]
                lo = hi
                common = np.zeros((len(group), len(ids)), np.int64)
                flat = np.concatenate([r[4] for r in group])
                owner = np.repeat(np.arange(len(group)), [len(r[4]) for r in group])
                if len(universe) and len(flat):
                    at = np.searchsorted(universe, flat)
                    at[at == len(universe)] = 0
                    known = universe[at] == flat
                    at, owner = at[known], owner[known]
                    if len(at):
                        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                        common[owner[first]] = np.add.reduceat(table[at], first, axis=0, dtype=np.int64)
                other_ids, other_label, other_n, other_lacks = (np.array([r[k] for r in group], np.int64)[:, None] for k in range(4))
                both = self.hub_n - lacks - other_lacks + common
                linked = (100 * both >= self.percent * (n + other_n - both)) & (label != other_label)
                for y, x in zip(*np.nonzero(linked), strict=True):
                    one, two = self._root(int(label[x])), self._root(int(other_label[y, 0]))
                    if one != two:
                        self.parent[one] = two
                        yield int(ids[x]), int(other_ids[y, 0])


def _among(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (hub, blocks, role): the minor members of a block, then the others."""
        key, block = None, None
        for batch in batches:
            a, i, j, role = (batch.column(c).to_pylist() for c in ("a", "i", "j", "role"))
            b, label, n, lacks, hub_n = (batch.column(c).to_pylist() for c in ("b", "label", "n", "lacks", "hub_n"))
            difference, found, waiting = batch.column("difference"), [], []
            for k in range(len(a)):
                if key != (a[k], i[k], j[k]):
                    if waiting:
                        found += block.meet(waiting)
                        waiting = []
                    key, block = (a[k], i[k], j[k]), _Block(percent, hub_n[k])
                row = (b[k], label[k], n[k], lacks[k], np.frombuffer(difference[k].as_buffer(), np.uint64).copy())
                if role[k] == 0:
                    block.add(row)
                else:
                    waiting.append(row)
            if waiting:
                found += block.meet(waiting)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def among_members(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a common hub whose components differ; of links that join the same two components, one at least.

    The members outside a hub's largest component (minor) meet all members of the hub, in
    blocks of about MINOR by MEMBERS: for M members, m of them minor, m * M comparisons of
    differences and M * m / MINOR + m * M / MEMBERS copies of rows. That is much if a bucket
    of very many documents falls into many components, which a band of six equal
    coordinates makes rare; each block is a task's work of its own, so it spreads.
    """
    members = stash(
        stars.hint("merge").join(labels.hint("merge"), stars.b == labels.node, "left").select("a", "b", "hub_n", "n", "lacks", "difference", F.coalesce("label", "b").alias("label")),
        "members",
    )
    counted = stash(members.groupBy("a", "label").agg(F.count("*").alias("of_label")), "counted")
    split = stash(
        counted.groupBy("a")
        .agg(F.count("*").alias("labels"), F.sum("of_label").alias("all"), F.max(F.struct("of_label", "label")).alias("top"))
        .where("labels > 1")
        .select("a", F.col("top.label").alias("main"), F.ceil(F.col("all") / MEMBERS).cast("int").alias("js"), F.ceil((F.col("all") - F.col("top.of_label")) / MINOR).cast("int").alias("is")),
        "split",
    )
    open_members = stash(members.hint("merge").join(split.hint("merge"), "a"), "open")
    i, j = F.expr("cast(pmod(xxhash64(b, 1), `is`) as int)"), F.expr("cast(pmod(xxhash64(b, 2), js) as int)")
    columns = ["a", "b", "label", "n", "lacks", "hub_n", "difference"]
    minor = open_members.where("label <> main").select(*columns, i.alias("i"), F.explode(F.expr("sequence(0, js - 1)")).alias("j"), F.lit(0).alias("role"))
    others = open_members.select(*columns, F.explode(F.expr("sequence(0, `is` - 1)")).alias("i"), j.alias("j"), F.lit(1).alias("role"))
    blocks = minor.unionByName(others).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j", "role", "b")
    return blocks.mapInArrow(_among(percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``.

    Documents are linked if 100 * |A & B| >= percent * |A | B| over their distinct
    ``words``-word shingles (A-Z lower-cased; the whole sequence, if shorter). Shingles
    are told apart by 64-bit hashes of their words' 64-bit hashes.
    With the defaults a pair at 0.85 is missed by all bands with probability 7e-7,
    at 0.8 with 1e-4, and then only if no third document connects it.

    Defined cases: null or empty texts and texts of white space have no shingles
    and are linked with nothing. A null doc_id is linked with nothing, has a null
    component_id and is kept. Rows that share a doc_id are one document: with
    equal texts trivially, else the set with the least digest stands for all.
    An empty table gives an empty result; other columns are ignored. Texts may be of any length.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = stash(source.mapInArrow(_profiles(words, rows, bands), "doc_id long, n_shingles long, digest binary, bands array<long>"), "profiles")
    # merge joins throughout: none of these sides is bounded, however small it may be today
    usable = profile.where("digest is not null and doc_id is not null")
    heads = stash(usable.groupBy("digest").agg(F.min("doc_id").alias("head")), "heads")
    copied = hot_keys(usable, "digest")
    # one set per representative, should two texts share a doc_id
    own = usable.hint("merge").join(heads.hint("merge"), (usable.digest == heads.digest) & (usable.doc_id == heads["head"]), "left_semi").groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles", "bands")).alias("own"))
    own = stash(own.select("doc_id", "own.*"), "representatives")
    grid = own.select("doc_id", F.explode("bands").alias("bucket"))
    shared = stash(grid.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("members")).where("members > 1").drop("members"), "buckets")
    pairs = stash(grid.hint("merge").join(shared.hint("merge"), "bucket").where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")

    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = stash(own.select("doc_id", "digest").hint("merge").join(wanted.hint("merge"), "doc_id"), "wanted")
    sets = stash(sets_of(source, wanted, words), "sets")
    stars = stash(with_hub(pairs, sets, percent), "stars")
    links = stars.where("linked").select("a", "b")
    labels = connected_components(links)
    more = stash(among_members(stars, labels, percent), "more")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))

    named = heads.hint("merge").join(labels.hint("merge"), heads["head"] == labels.node, "left").select("digest", F.coalesce("label", "head").alias("component"))
    # rows that share a doc_id follow the least component of their texts
    return (
        join_on(profile.select("doc_id", "n_shingles", "digest"), stash(named, "named"), "digest", copied, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, of which one stays per group of near-duplicate texts: that of the smallest doc_id, and one more of its rows without an id.

    Rows are compared one by one whatever their doc_id: where different texts share an id, both
    stay. Texts without words are linked with nothing but the same text of the same id; of those
    without an id all stay. An empty table gives an empty result.
    """
    keyed = stash(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    text, doc_id = F.col("row").getField("text").cast("string"), F.col("row").getField("doc_id").cast("long")
    found = near_duplicates(keyed.select(F.col("at").alias("doc_id"), text.alias("text")), words, percent).select(F.col("doc_id").alias("at"), "n_shingles", "component_id")
    own = keyed.select("at", doc_id.alias("id"), F.xxhash64(text).alias("same"))
    grouped = own.hint("merge").join(found.hint("merge"), "at")
    # a text without words stands for itself, but once for an id
    worded = F.col("n_shingles") > 0
    alone = ~worded & F.col("id").isNull()
    group = [F.when(worded, F.col("component_id")).when(alone, F.col("at")).alias("g"), F.when(~worded, F.col("id")).alias("i"), F.when(~worded, F.col("same")).alias("s"), worded.alias("w"), F.col("id").isNull().alias("n")]
    stay = grouped.groupBy(*group).agg(F.min(F.struct("id", "same", "at")).alias("first")).select("first.at")
    return keyed.hint("merge").join(stay.hint("merge"), "at", "left_semi").select("row.*")
