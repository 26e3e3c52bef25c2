"""Best-fit packing of token sequences by exact-complement hashing.

Texts become ids and pieces on the map side. How many pieces there are of every
length, at most ``capacity`` numbers, is all that planning needs: the driver
fills gaps exactly with one, two or three lengths out of hashed sums, under the
counts that are left, and places the rest by best fit. A piece then finds its
place from its length and its rank among the pieces of that length; ranks come
from counts by (length, salt), so no length is ever gathered in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import stash

#: Entries of a worker's cache, and characters of the longest piece in it.
CACHE, LONGEST = 1 << 20, 64
#: Pieces of one length that are numbered in one group, about.
GROUP = 8192
#: White space to Python that the tokenizer takes for characters.
_separators = re.compile("[\x1c-\x1f]")
#: The tokenizer's own pattern with letters and numbers of Latin-1 spelt out. Fixed values.
_letters, _numbers = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_pieces = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_letters}]+|[{_numbers}]|[^\s{_letters}{_numbers}]+")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class _Ids(dict):
    """A piece between white space -> its ids as little-endian bytes; the older half goes when it is full."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: str) -> bytes:
        ids = self.whole(piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                for old in list(islice(self, CACHE // 2)):
                    del self[old]
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        """Ids of a text. Latin-1 texts are cut by the tokenizer's pattern, in lower case as it has them; others at white space."""
        if _separators.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return b"".join(map(self.__getitem__, text.split()))
        return b"".join(map(self.__getitem__, _pieces.findall(text.lower())))


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    """One cache per worker process, kept from task to task."""
    return _Ids(path)


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs``.

    The tokenizer drops white space and its tokens end there, so a text's ids are
    those of its pieces in turn. Null and empty texts are the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = ids.of(text or "") + end
                for k in range(0, len(found), 4 * capacity):
                    part = found[k : k + 4 * capacity]
                    for column, value in zip(out, (doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Sums:
    """Which pairs and triples of available lengths have a given sum."""

    def __init__(self, left: np.ndarray):
        self.left, self.stale = left, True

    def _index(self) -> None:
        n = len(self.left)
        self.lengths = np.flatnonzero(self.left)
        self.lengths = self.lengths[self.lengths > 0]
        self.pair = np.zeros(n, np.int64)  # the larger length of a pair with that sum
        for a in self.lengths.tolist():
            others = self.lengths[(self.lengths <= a) & (self.lengths < n - a)]
            if self.left[a] < 2:
                others = others[others != a]
            self.pair[others + a] = a
        self.stale = False

    def _free(self, combo: tuple[int, ...]) -> bool:
        return all(self.left[x] >= combo.count(x) for x in combo)

    def find(self, gap: int) -> tuple[int, ...] | None:
        if self.left[gap] > 0:
            return (gap,)
        for _ in range(2):
            if self.stale:
                self._index()
                fresh = True
            else:
                fresh = False
            a = int(self.pair[gap])
            if a and self._free((a, gap - a)):
                return a, gap - a
            firsts = self.lengths[(self.lengths < gap)]
            second = self.pair[gap - firsts]
            for k in np.flatnonzero(second)[::-1].tolist():
                combo = (int(firsts[k]), int(second[k]), int(gap - firsts[k] - second[k]))
                if self._free(combo):
                    return combo
            if fresh:
                return None
            self.stale = True
        return None

    def take(self, combo: tuple[int, ...], times: int) -> None:
        for x in combo:
            self.left[x] -= times


def plan(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, how many, first sequence, offset) for ``counts[length]`` pieces, and the number of sequences.

    Slot i of a pattern that is used m times takes m consecutive ranks of its
    length and puts them into m consecutive sequences. The work depends on
    ``capacity`` alone, not on how many pieces there are.
    """
    left = counts.astype(np.int64).copy()
    rank = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, times: int, first: int, offset: int) -> None:
        slots.append((length, int(rank[length]), times, first, offset))
        rank[length] += times

    if left[capacity]:
        put(capacity, int(left[capacity]), 0, 0)
        sequences, left[capacity] = int(left[capacity]), 0
    sums = _Sums(left)
    rest = np.zeros(capacity + 1, np.int64)
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            left[length] -= 1  # the seed itself is not to be found again
            combo = sums.find(capacity - length)
            left[length] += 1
            if combo is None:
                rest[length], left[length] = left[length], 0
                sums.stale |= True
                break
            use = (length, *combo)
            times = min(int(left[x]) // use.count(x) for x in set(use))
            sums.take(use, times)
            offset = 0
            for x in use:
                put(x, times, sequences, offset)
                offset += x
            sequences += times
    # what fits exactly nowhere: best fit, longest first; bins of equal history are one entry
    gaps: dict[int, list[tuple[int, int]]] = {}
    for length in range(capacity, 0, -1):
        todo = int(rest[length])
        while todo:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                gaps.setdefault(capacity, []).append((sequences, -(-todo // (capacity // length))))
                sequences += gaps[capacity][-1][1]
                gap = capacity
            first, many = gaps[gap].pop()
            times = min(many, todo)
            if many > times:
                gaps[gap].append((first + times, many - times))
            if not gaps[gap]:
                del gaps[gap]
            put(length, times, first, capacity - gap)
            todo -= times
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, times))
    return np.array(slots, np.int64).reshape(-1, 5), sequences


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces``, a written table with a number of its own per row in ``row``, with sequence_id and offset.

    Every row has a place of its own, equal ones and those with null ids too: ranks within a
    length are dealt by ``row``, in groups of about GROUP, so no id, text or length is
    gathered in one task. Lengths are 1 to ``capacity``. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # one row per length, at most ``capacity``
        counts[length] = n
    slots, _ = plan(counts, capacity)
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    shared = spark.sparkContext.broadcast(slots[order])  # bounded by the capacity
    salts = max(1, -(-int(counts.max()) // GROUP))
    salted = pieces.withColumn("salt", F.expr(f"cast(pmod(xxhash64(row), {salts}) as int)"))
    groups = stash(salted.groupBy("length", "salt").count(), "groups")
    before = groups.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = (
        salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
        .join(stash(before, "before"), ["length", "salt"])
        .withColumn("rank", F.col("place") + F.col("before"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        at = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(at, (length << 44) | rank, "right") - 1
            sequence, offset = table[k, 3] + rank - table[k, 1], table[k, 4]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces and their places.

    Only documents longer than ``capacity`` are cut. Null and empty texts are one piece
    with the end id. Rows that repeat, or have a null doc_id, are documents of their
    own and get places of their own. Texts may be of any length. Other columns are
    ignored; an empty table gives an empty result.
    """
    return place(stash(tokenize(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)
