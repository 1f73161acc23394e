"""Words of whole texts as hash arrays, vectorised over the bytes of Arrow columns.

Texts are UTF-8, and every separator is an ASCII character, so words can be
cut on bytes. ``A-Z`` hash like ``a-z``; other letters stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: every ASCII character but digits and letters
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[c for c in range(128) if not chr(c).isalnum()]] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and ends; null is the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte begin and end of every word, and the number of the first word of each text."""
    inside = ~separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def hash_spans(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges are in order and not empty."""
    global _POWERS
    if not len(begins):
        return np.empty(0, np.uint64)
    lengths = ends - begins
    if (longest := int(lengths.max())) > len(_POWERS):
        _POWERS = np.cumprod(np.full(longest, _POWERS[0], np.uint64), dtype=np.uint64)
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(at, lengths)
    letters = raw[within + np.repeat(begins, lengths)]
    sums = np.add.reduceat(_BYTE[letters] * _POWERS[within], at)
    return mix(sums ^ (lengths.astype(np.uint64) * _STEP))


def hashed_words(column: pa.Array, separators: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per range of texts: its first and last number, all word hashes, the first word of each text."""
    raw, offsets = text_bytes(column)
    for first, last in slices(offsets):
        own = offsets[first : last + 1]
        part = raw[own[0] : own[-1]]
        begins, ends, starts = word_spans(part, own - own[0], separators)
        yield first, last, hash_spans(part, begins, ends), starts


def shingles(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each text, sorted within it, and the number of the text of each.

    A text of fewer than k words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(starts[1:], counts) - np.arange(len(words))
    value = np.zeros(len(words), np.uint64)
    for i in range(k):
        shifted = np.zeros(len(words), np.uint64)
        shifted[: max(0, len(words) - i)] = words[i:]
        value = mix(value * np.uint64(3) + np.where(left > i, shifted, np.uint64(0)))
    head = np.zeros(len(words), bool)
    head[starts[:-1][counts > 0]] = True
    taken = (left >= k) | (head & (left < k))
    value, owner = value[taken], owner[taken]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
    return value, owner
