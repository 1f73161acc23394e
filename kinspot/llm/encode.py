"""Whole texts to ids of a public tokenizer, in the tasks.

Both vocabularies are byte-pair encodings of pre-tokens: runs of letters, of
digits or of symbols, with the space before them at most. A text may
therefore be cut wherever such a run certainly ends, and equal units need
encoding once: the units of a batch are made a dictionary by Arrow, a worker
remembers the ids of units it has met under two 64-bit hashes of each, and the
texts' ids are gathered by number. Only cuts that hold for any text are made: characters whose kind is
not plain from their bytes, apostrophes (contractions) and texts that may
name a special token stay whole. Tests compare with the library's own result.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinspot.llm.stage import give_back
from kinspot.llm.words import hash_spans, mix, slices, text_bytes

#: units a worker remembers, at some 50 bytes each; then it begins anew
REMEMBERED = 1_000_000
#: units that are learnt before they are merged into the sorted ones
RECENT = 1 << 17
#: units that the library encodes at once; what it returns of a unit is many times its ids
LEARNT = 4096
SLICE_BYTES = 1 << 20
HELD_IN = "kinspot_encoders"

# kinds of bytes: 0 unknown, 1 letter, 2 digit, 3 symbol, 4 space or newline, 5 apostrophe
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(0x21, 0x7F)]] = 3
_KIND[[c for c in range(128) if chr(c).isalpha()]] = 1
_KIND[[c for c in range(128) if chr(c).isdigit()]] = 2
_KIND[[0x20, 0x0A]] = 4
_KIND[0x27] = 5


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Where a unit begins for certain, as booleans over the bytes."""
    kind = _KIND[raw]
    if len(raw) > 1:
        # U+00C0 to U+00FF are letters but for the signs of multiplication and division
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
    begins = np.ones(len(raw), bool)
    before, here = kind[:-1], kind[1:]
    run = (before > 0) & (before < 4)
    begins[1:] = (here == 4) & (run | (before == 5)) | run & (here > 0) & (here < 4) & (here != before)
    return begins


#: another order of the bytes, for a second hash; the plain one takes A to Z for a to z
MIXED = np.random.default_rng(17).permutation(256).astype(np.uint8)


def _merged(one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    whole = [np.concatenate(pair) for pair in zip(one, other, strict=True)]
    order = np.argsort(whole[0], kind="stable")
    return tuple(x[order] for x in whole)


class Encoder:
    """Ids of text columns under one vocabulary file."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.n = self.used = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        self.sorted, self.recent = none, none  # first hash in ascending order, second hash, number of the unit

    def _known(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of units by their hashes; -1 for those that have not been met."""
        out = np.full(len(first), -1, np.int64)
        for own_first, own_second, number in (self.sorted, self.recent):
            if len(own_first):
                at = np.minimum(np.searchsorted(own_first, first), len(own_first) - 1)
                same = (own_first[at] == first) & (own_second[at] == second)
                out[same] = number[at[same]]
        return out

    def _encoded(self, units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All ids of ``LEARNT`` units at a time, and the number of each unit's."""
        for first in range(0, len(units), LEARNT):
            part = [u.decode() for u in units[first : first + LEARNT]]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            yield np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, units: list[bytes], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Numbers of new units, which are encoded and remembered."""
        flat, lengths = (np.concatenate(parts) for parts in zip(*self._encoded(units), strict=True))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(lengths) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        numbers = np.arange(self.n, self.n + len(lengths), dtype=np.int32)
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[numbers] = lengths
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.n += len(lengths)
        self.recent = _merged(self.recent, (first, second, numbers))
        if len(self.recent[0]) > RECENT:
            self.sorted, self.recent = _merged(self.sorted, self.recent), tuple(x[:0] for x in self.recent)
        return numbers

    def _part(self, raw: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = unit_starts(raw)
        for i in np.flatnonzero(whole):
            begins[offsets[i] : offsets[i + 1]] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(raw)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = column.dictionary_encode()
        if self.n > REMEMBERED:
            self._forget()
        _, bounds, data = coded.dictionary.buffers()
        bounds, letters = np.frombuffer(bounds, np.int64)[: len(coded.dictionary) + 1], np.frombuffer(data, np.uint8)
        folded, second = (hash_spans(part, bounds[:-1], bounds[1:]) for part in (letters, MIXED[letters]))
        first = mix(folded ^ mix(second))
        number = self._known(first, second)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn(coded.dictionary.take(pa.array(new)).to_pylist(), first[new], second[new])
        number = number[coded.indices.to_numpy()]
        lengths = self.length[number].astype(np.int64)
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[number] - (ends - lengths), lengths)
        ids = self.ids[at + np.arange(len(at))]
        first_unit = np.searchsorted(cuts[:-1], offsets)
        return ids, np.concatenate(([0], ends))[first_unit]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, and where those of each text begin and end; null is the empty text."""
        raw, offsets = text_bytes(column)
        whole = pc.fill_null(pc.match_substring(column, "<|"), False)
        whole = np.asarray(whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole, dtype=bool)
        parts, bounds, total = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for first, last in slices(offsets, SLICE_BYTES):
            own = offsets[first : last + 1]
            if own[-1] == own[0]:
                bounds.append(np.full(last - first, total, np.int64))
                continue
            ids, ends = self._part(raw[own[0] : own[-1]], own - own[0], whole[first:last])
            parts.append(ids)
            bounds.append(ends[1:] + total)
            total += len(ids)
        give_back()  # a worker with its encoder stands beside the executor's heap for all later tasks
        return np.concatenate(parts), np.concatenate(bounds)


def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker process and vocabulary file, kept from task to task.

    Task functions travel by value, and their own globals with them, so the
    encoders live in a module of the worker's.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    held = vars(sys.modules.setdefault(HELD_IN, ModuleType(HELD_IN)))
    if vocabulary not in held:
        held[vocabulary] = Encoder(vocabulary)
    return held[vocabulary]
