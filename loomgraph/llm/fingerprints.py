"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks cut points; chunks are cut by normalised
chunking (Xia et al., "FastCDC", 2016): no cut within the first ``least`` bytes of
a chunk, a strict mask up to the average size, a loose one beyond it, and a hard cut
at ``most``. A fingerprint is the set of chunk digests with the chunks' lengths. An
insertion or deletion moves the cuts only near it, so two texts share the chunks of
what they share; containment weighs them by length.

In a text below ``SHORT`` bytes chunks begin small and grow with their place, so that
a few dozen words make several. The sizes follow from the place, not the text's length:
a beginning that two short texts share is cut alike in both, and a text that an edit
takes past ``SHORT`` loses about the first kilobyte's chunks.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import mix
from loomgraph.storage import stash

LEAST, AVERAGE, MOST = 64, 256, 1024
#: Two bits more than the average asks for before it, two less beyond it.
STRICT, LOOSE = np.uint32(0x3FF << 22), np.uint32(0x3F << 26)
#: Texts below so many bytes: (chunks that begin before, least, average, most) with the masks' bits two more and two less than the average asks for.
SHORT = 1 << 15
FINE = [(64, 8, 16, 64), (256, 16, 32, 128), (1024, 32, 128, 512), (SHORT, LEAST, AVERAGE, MOST)]
SEGMENT = 1 << 20
#: Rows in a range of consecutive ids, about, and the most ranges, as the driver holds a row for each; beyond, ranges get longer.
RANGE_ROWS, RANGES = 2000, 1 << 16

_gear = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash of the up to 32 bytes that end at each byte."""
    h = _gear[data]
    for width in (1, 2, 4, 8, 16):
        further = h.copy()
        further[width:] += h[:-width] << np.uint32(width)
        h = further
    return h


def _top(bits: int) -> np.uint32:
    return np.uint32(((1 << bits) - 1) << (32 - bits))


def _end(loose: list[int], strict: list[int], begin: int, n: int, least: int, average: int, most: int) -> int:
    """Where the chunk that begins at ``begin`` ends."""
    end = min(n, begin + most)
    if n - begin > least:
        k = bisect.bisect_left(strict, begin + least)
        if k < len(strict) and strict[k] <= begin + average:
            return min(end, strict[k])
        k = bisect.bisect_right(loose, begin + average)
        if k < len(loose):
            end = min(end, loose[k])
    return end


def _short_cuts(raw: bytes) -> list[int]:
    h = _hashes(np.frombuffer(raw, np.uint8))
    ends, begin, n = [], 0, len(raw)
    for until, least, average, most in FINE:
        if begin >= n:
            break
        bits = average.bit_length() - 1
        near = h[: until + most]
        at = np.flatnonzero((near & _top(bits - 2)) == 0)
        loose, strict = (at + 1).tolist(), (at[(near[at] & _top(bits + 2)) == 0] + 1).tolist()
        while begin < min(n, until):
            begin = _end(loose, strict, begin, n, least, average, most)
            ends.append(begin)
    return ends


def _marks(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of possible chunks: positions after a byte whose gear hash has the loose bits clear, and of these the strict."""
    loose, strict = [], []
    for lo in range(0, len(data), SEGMENT):
        begin = max(0, lo - 31)
        h = _hashes(data[begin : lo + SEGMENT])[lo - begin :]
        at = np.flatnonzero((h & LOOSE) == 0)
        loose.append(at + lo + 1)
        strict.append(at[(h[at] & STRICT) == 0] + lo + 1)
    return (np.concatenate(loose).tolist(), np.concatenate(strict).tolist()) if loose else ([], [])


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``."""
    if len(raw) < SHORT:
        return _short_cuts(raw)
    loose, strict = _marks(np.frombuffer(raw, np.uint8))
    ends, begin, n = [], 0, len(raw)
    while begin < n:
        begin = _end(loose, strict, begin, n, LEAST, AVERAGE, MOST)
        ends.append(begin)
    return ends


def chunk_digests(raw: bytes) -> dict[int, int]:
    """64-bit chunk digest -> bytes of the chunk, each distinct chunk once."""
    out, begin, view = {}, 0, memoryview(raw)
    for end in cuts(raw):
        out[xxhash.xxh3_64_intdigest(view[begin:end])] = end - begin
        begin = end
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of ``a``'s chunk lengths that ``b`` has; of two empty sets 1, of an empty and another 0."""
    if not a or not b:
        return float(not a and not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprint(chunks: dict[int, int]) -> str:
    """Digests with lengths in the order of digests, e.g. 00ab...:211."""
    return ",".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def in_order(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(range, own, doc_id, text): ranges of consecutive rows, each in one partition and sorted, closed by the first row of the next range with own = false.

    The order is that of doc_id, null first, then of the texts' hashes, then of the rows'
    places in the table, so it is total: rows without an id, or with the same one, spread
    over ranges like any others. The last range is closed by the first row of all. What is
    sorted to find the bounds are these three numbers of each row, not the texts. A range
    has max(rows, n / RANGES) rows, which a task streams through, so n only sets how long tasks run.
    ``docs`` is read twice and has to give its rows in the same order, as a table does.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("at")]
    ranked = stash(keyed.select("doc_id", "hash", "at").orderBy(*order).select("doc_id", "hash", "at", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("inside")), "order")
    sizes = {r["part"]: (r["low"], r["n"]) for r in ranked.groupBy("part").agg(F.min("inside").alias("low"), F.count("*").alias("n")).collect()}  # a row per partition of the sort
    n, begin, before = sum(k for _, k in sizes.values()), [], 0
    for part in sorted(sizes):
        begin.append((part, before - sizes[part][0]))
        before += sizes[part][1]
    size = max(rows, -(-n // RANGES))
    offset = F.create_map(*[F.lit(x) for pair in begin for x in pair])[F.col("part")] if begin else F.lit(0)
    bounds = [(r["doc_id"], r["hash"], r["at"]) for r in ranked.withColumn("rank", F.col("inside") + offset).where(F.col("rank") % size == 0).orderBy("rank").select("doc_id", "hash", "at").collect()]  # at most RANGES rows
    ranged = keyed.withColumn("range", _place(bounds))
    firsts = docs.sparkSession.createDataFrame([(at, (k - 1) % len(bounds)) for k, (_, _, at) in enumerate(bounds)], "first long, before int")
    closing = keyed.join(F.broadcast(firsts), F.col("at") == F.col("first")).select(F.col("before").alias("range"), F.lit(False).alias("own"), "doc_id", "text", "hash", "at")
    both = ranged.select("range", F.lit(True).alias("own"), "doc_id", "text", "hash", "at").unionByName(closing)
    # the row that closes the last range is the first of all: it goes behind the others all the same
    return both.repartition("range").sortWithinPartitions("range", F.desc("own"), *order).select("range", "own", "doc_id", "text")


def _place(bounds: list[tuple[int | None, int, int]]):
    """How many of the sorted bounds but the first are at most (doc_id, hash, at), by halving."""
    rest = bounds[1:]
    n = len(rest)
    if not n:
        return F.lit(0)
    least = -(1 << 63)
    ids, hashes, places = (F.expr(f"split('{','.join(str(least if b[k] is None else b[k]) for b in rest)}', ',')").cast("array<long>") for k in range(3))
    nulls = sum(b[0] is None for b in rest)
    own = F.coalesce(F.col("doc_id"), F.lit(least))

    def reached(k):
        # bounds without an id come first: a row with one is behind them, one without is before the others
        same = (F.get(hashes, k) < F.col("hash")) | ((F.get(hashes, k) == F.col("hash")) & (F.get(places, k) <= F.col("at")))
        with_id = F.col("doc_id").isNotNull() & ((F.get(ids, k) < own) | ((F.get(ids, k) == own) & same))
        return F.when(k < nulls, F.col("doc_id").isNotNull() | same).otherwise(with_id)

    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & reached(at + step - 1), at + step).otherwise(at)).cast("int")


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as
    many, or all, of the next document's in ascending doc_id; after the last comes the
    first. near_edited and near_next are the containments of the text's fingerprint in the
    edited text's and the next document's. Null texts count as empty; empty texts have
    an empty fingerprint, contained wholly in another empty one and not at all in others. Null
    doc_ids come before all others; rows with the same doc_id are in the order of
    their texts' hashes, equal ones in that of their places. An only row is its own next.
    Texts may be of any length. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, own, doc_id, text, chunks), waiting for its next
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            text_column = batch.column("text")
            for k, (range_, own, doc) in enumerate(zip(batch.column("range").to_pylist(), batch.column("own").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                text = text_column[k].as_py()
                chunks = chunk_digests(text.encode())
                if held and held[0] == range_ and held[1]:
                    _, _, own_id, before, have = held
                    n = len(before)
                    edited = (before[: n - n // 4] + text[: n // 4]).encode()
                    other = chunk_digests(edited)
                    for column, value in zip(out, (own_id, n, hashlib.sha256(edited).hexdigest(), fingerprint(have), fingerprint(other), containment(have, other), containment(have, chunks)), strict=True):
                        column.append(value)
                held = (range_, own, doc, text, chunks)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return in_order(rows).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
