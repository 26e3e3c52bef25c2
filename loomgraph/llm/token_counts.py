"""Token counts by a two-tier lookup on the map side.

Texts are cut into the tokenizer's pre-tokens by its byte-level pattern, with numpy over
the code points of many texts at once, and every pre-token is known by a 64-bit hash.
Tier one is a broadcast table of the corpus's frequent pre-tokens, as sorted hashes with a
16-bit length each, built from counts over all documents; tier two is a cache in each Python
worker, filled by the tokenizer itself. Pre-tokens are never shuffled, but for the few heavy
hitters of every task.

The pattern's classes are read from Python's Unicode tables, which agree with the library's
on the blocks in ``_table``. A text with a character of any other block is cut
before single spaces instead, where no pre-token reaches over, and a text with a special
string goes to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import mix

#: Entries of the broadcast table, of what each task proposes for it, and of a worker's cache.
TABLE, PROPOSED, CACHE = 1 << 15, 1 << 13, 1 << 20
#: A pre-token longer than this is not kept in table or cache.
LONGEST = 64
#: Code points that are cut at once, about; one text at least.
BLOCK = 1 << 20
_inner_space = re.compile(r"\s \s|\s \Z")
_single_space = re.compile(r"(?<=\S) (?=\S)")

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = range(5)
#: Blocks with the same classes in all versions of Unicode in use: Latin to Cyrillic, general punctuation, currency. Fixed values.
_BLOCKS = [(0x0, 0x530), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x20A0, 0x20C0)]
#: White space of Unicode in these blocks. Fixed values.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, _UNKNOWN, np.uint8)
    for lo, hi in _BLOCKS:
        for c in range(lo, hi):
            kind = unicodedata.category(chr(c))
            out[c] = _UNKNOWN if kind == "Cn" else {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
    out[_WHITE] = _SPACE
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 2 * BLOCK), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def pre_tokens(points: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of texts that begin at at[:-1]; ``kind`` are their classes.

    A run of letters, numbers or other characters is one, with a single space before it. Of
    white space before another character the last one stands alone, or is that space; white
    space at the end of a text is one. An apostrophe that begins one takes s, t, m, d, re, ve
    or ll with it.
    """
    n = len(points)
    ends = np.zeros(n + 1, bool)  # a text ends before this place
    ends[at] = True
    border = np.ones(n, bool)
    border[1:] = (kind[1:] != kind[:-1]) | ends[1:n]
    blank = kind == _SPACE
    after_space = np.zeros(n, bool)
    after_space[1:] = (points[:-1] == 0x20) & ~ends[1:n]
    first = border & (blank | ~after_space)
    last_blank = np.zeros(n, bool)
    last_blank[:-1] = blank[:-1] & ~blank[1:] & ~ends[1:n]
    first |= last_blank
    # a lone apostrophe before letters of the same text
    mark = np.flatnonzero(first & (points == 0x27))
    mark = mark[(mark + 1 < n) & ~ends[np.minimum(mark + 1, n)]]
    if len(mark):
        one = points[mark + 1]
        two = np.where((mark + 2 < n) & ~ends[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((two == 0x6C) & (one == 0x6C))
        for found, width in ((mark[short], 2), (mark[long], 3)):
            first[found + 1] = False
            rest = found + width
            rest = rest[rest < n]
            first[rest] = True
    return np.flatnonzero(first)


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Cut:
    """Texts cut into pre-tokens: their hashes, places and owners, and the texts that have to be counted otherwise."""

    def __init__(self, texts: list[str], special: tuple[str, ...]):
        self.joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(self.joined.encode("utf-32-le"), "<u4")
        kind = _table()[points]
        unknown = np.unique(np.searchsorted(self.at, np.flatnonzero(kind == _UNKNOWN), "right") - 1)
        self.others = sorted(set(unknown.tolist()) | {k for k, t in enumerate(texts) if any(s in t for s in special)})
        self.starts = pre_tokens(points, kind, self.at)
        self.ends = np.append(self.starts[1:], len(points)) if len(self.starts) else self.starts
        self.hashes = _hashes(points, self.starts, self.ends)
        self.begin = np.searchsorted(self.starts, self.at)
        if self.others:
            owner = np.searchsorted(self.at, self.starts, "right") - 1
            keep = ~np.isin(owner, self.others)
            self.starts, self.ends, self.hashes = self.starts[keep], self.ends[keep], self.hashes[keep]
            self.begin = np.searchsorted(self.starts, self.at)

    def text(self, k: int) -> str:
        return self.joined[self.starts[k] : self.ends[k]]


def parts_of(text: str, special: tuple[str, ...]) -> Iterator[str]:
    """A long text in parts of about BLOCK characters, cut before single spaces; whole if it has a special string or no such place."""
    lo, n = 0, len(text)
    if n > BLOCK and not any(s in text for s in special):
        while n - lo > BLOCK:
            place = _single_space.search(text, lo + BLOCK)
            if place is None:
                break
            yield text[lo : place.start()]
            lo = place.start()
    yield text[lo:]


def blocks(texts: list[str | None], special: tuple[str, ...]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, texts or their parts) of about BLOCK characters together; null counts as empty."""
    rows, held, size = [], [], 0
    for k, text in enumerate(texts):
        for part in parts_of(text or "", special):
            rows.append(k)
            held.append(part)
            size += len(part)
            if size >= BLOCK:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def pieces(text: str) -> list[str] | None:
    """Pieces whose token counts add up to the text's, cut before single spaces; None if it must be encoded whole."""
    if not text:
        return []
    if _inner_space.search(text):
        return None
    head, *rest = text.split(" ")
    return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]


class _Lengths(dict):
    """Tier two: hash of a pre-token, or a piece -> number of tokens; the older half goes when it is full."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def _kept(self, key, length: int, size: int) -> int:
        if size <= LONGEST:
            if len(self) >= CACHE:
                for old in list(islice(self, CACHE // 2)):
                    del self[old]
            self[key] = length
        return length

    def __missing__(self, piece: str) -> int:
        return self._kept(piece, self.whole(piece), len(piece))

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def otherwise(self, text: str) -> int:
        """Tokens of a text that is not cut by the pattern."""
        parts = None if any(s in text for s in self.special) else pieces(text)
        return self.whole(text) if parts is None else sum(map(self.__getitem__, parts))

    def of(self, cut: Cut, rows: np.ndarray) -> np.ndarray:
        """Tokens of the pre-tokens ``rows`` of ``cut``."""
        found, where, back = np.unique(cut.hashes[rows], return_index=True, return_inverse=True)
        out = np.empty(len(found), np.int64)
        for k, (key, row) in enumerate(zip(found.tolist(), rows[where].tolist(), strict=True)):
            n = self.get(key)
            if n is None:
                piece = cut.text(row)
                n = self._kept(key, self.whole(piece), len(piece))
            out[k] = n
        return out[back]


@lru_cache(maxsize=2)
def _lengths(path: str) -> _Lengths:
    """One cache per worker process, kept from task to task."""
    return _Lengths(path)


def count_texts(texts: list[str | None], lengths: _Lengths, table: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Tokens of each text by the table (sorted hashes, lengths) and, behind it, the cache."""
    known, length_of = table
    out = np.zeros(len(texts), np.int64)
    for rows, held in blocks(texts, lengths.special):
        cut = Cut(held, lengths.special)
        n = np.zeros(len(cut.hashes), np.int64)
        hit = np.zeros(len(cut.hashes), bool)
        if len(known) and len(n):
            place = np.searchsorted(known, cut.hashes)
            place[place == len(known)] = 0
            hit = known[place] == cut.hashes
            n[hit] = length_of[place[hit]]
        misses = np.flatnonzero(~hit)
        if len(misses):
            n[misses] = lengths.of(cut, misses)
        total = np.concatenate([[0], np.cumsum(n)])
        counts = total[cut.begin[1:]] - total[cut.begin[:-1]]
        for k in cut.others:
            counts[k] = lengths.otherwise(held[k])
        np.add.at(out, rows, counts)
    return out.tolist()


def frequent_pre_tokens(docs: DataFrame, special: tuple[str, ...] = ()) -> list[str]:
    """The heaviest pre-tokens over all documents, at most TABLE of them.

    Every task counts all its pre-tokens, pruning those of one whenever the counter
    outgrows CACHE, and proposes its PROPOSED heaviest; the proposals are summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for _, held in blocks(batch.column(0).to_pylist(), special):
                cut = Cut(held, special)
                found, where, n = np.unique(cut.hashes, return_index=True, return_counts=True)
                for key, row, times in zip(found.tolist(), where.tolist(), n.tolist(), strict=True):
                    own = seen.get(key)
                    if own:
                        own[0] += times
                    elif cut.ends[row] - cut.starts[row] <= LONGEST:
                        seen[key] = [times, cut.text(row)]
                if len(seen) > CACHE:
                    seen = {k: v for k, v in seen.items() if v[0] > 1}
                    if len(seen) > CACHE // 2:
                        seen = dict(sorted(seen.items(), key=lambda kv: -kv[1][0])[: CACHE // 2])
        top = sorted(seen.values(), key=lambda v: (-v[0], v[1]))[:PROPOSED]
        yield pa.RecordBatch.from_arrays([pa.array([t for _, t in top], pa.string()), pa.array([n for n, _ in top], pa.int64())], ["piece", "n"])

    told = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "piece string, n long")
    heaviest = told.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE)
    return [r[0] for r in heaviest.select("piece").collect()]


def compact_table(tokenizer: str, frequent: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of pre-tokens, each of which is cut as one, and their token counts as 16-bit numbers."""
    hashes, counts, lengths = [], [], _lengths(tokenizer)
    for piece in frequent:
        cut = Cut([piece], lengths.special)
        if len(cut.hashes) == 1:
            hashes.append(int(cut.hashes[0]))
            counts.append(lengths.whole(piece))
    order = np.argsort(np.array(hashes, np.uint64))
    return np.array(hashes, np.uint64)[order], np.array(counts, np.uint16)[order]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per row of ``docs``, as the tokenizer file's library counts them.

    No begin, end or added special tokens, no truncation; special strings inside a text
    count as the library's default has it (one token). Null texts count as empty:
    0 bytes, 0 tokens. Texts may be of any length and are counted whole. Repeated rows and
    null ids are rows like any other; other columns are ignored; an empty table gives an
    empty result. Pre-tokens are told apart by 64-bit hashes: with 10**10 different ones
    the chance that any of the table's has a double is 2e-5.
    """
    table = compact_table(tokenizer, frequent_pre_tokens(docs, _lengths(tokenizer).special))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 10 bytes for each of TABLE entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = count_texts(texts, lengths, shared.value)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
