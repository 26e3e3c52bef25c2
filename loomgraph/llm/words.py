"""Words of UTF-8 text blocks as 64-bit hashes, found with numpy over whole Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D. Texts are handled in
blocks of about ``BLOCK`` bytes that are cut only between words, so memory does
not grow with the length of one text beyond its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += 32
_lower += 1
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, limit: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK bytes that end at a text's end or before a space."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:
            k = int(np.searchsorted(offsets, hi, "right")) - 1
            if offsets[k] > lo:
                hi = int(offsets[k])
            else:  # inside one long text
                end = int(offsets[k + 1])
                while hi < end and not _space[data[hi]]:
                    hi += 1
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and where each text's words begin (one more entry than texts)."""
    return sized_words(data, offsets)[::2]


def sized_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their bytes, and where each text's words begin."""
    found, sizes, begun = [], [], []
    for lo, hi in _spans(data, offsets):
        part = data[lo:hi]
        solid = ~_space[part]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        edges = offsets[(offsets > lo) & (offsets < hi)] - lo
        first[edges] = solid[edges]
        last[edges - 1] = solid[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_lower[part] * up[: len(part)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        found.append(mix(h + (ends - starts).astype(np.uint64)))
        sizes.append(ends - starts)
        begun.append(starts + lo)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.concatenate(sizes), np.searchsorted(np.concatenate(begun), offsets)


def shingle_sets(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; of all its words, if fewer."""
    sets = []
    for k in range(len(at) - 1):
        own = words[at[k] : at[k + 1]]
        if not len(own):
            sets.append(own)
            continue
        width = min(size, len(own))
        h = np.full(len(own) - width + 1, width, np.uint64)
        for j in range(width):
            h = mix(h * np.uint64(_BASE) + own[j : len(own) - width + 1 + j])
        sets.append(np.unique(h))
    return sets
