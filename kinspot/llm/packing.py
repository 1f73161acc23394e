"""Packing documents into sequences by cutting-stock patterns.

Documents are encoded and cut at the sequence length; a histogram of the
pieces' lengths, of at most ``capacity`` rows, goes to the driver. There a
linear program over patterns (how many pieces of each length class fill one
sequence) is solved by column generation: dual prices of the classes, and a
knapsack dynamic program that looks for a pattern worth more than one
sequence. The rounded-down patterns are dealt to pieces by their rank within
their class. What rounding leaves is no more than one sequence a class; those
pieces are laid end to end and cut at the sequence length, the last one at
powers of two, so that they take no padding at all.

Cases: null text is the empty text, a piece of its end id alone. Repeated
rows, equal ids and null ids are packed like any other row. No documents give
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinspot.llm.encode import encoder
from kinspot.llm.stage import stored, whole_text
from kinspot.llm.token_store import id_width, with_end

CAPACITY = 2048
#: tokens to a length class; a piece may leave up to one less than this as padding
UNIT = 8
#: column generation ends when the program's value is within this share of its lower bound
GAP = 1e-4
#: mean pieces that are ranked together
RANKED = 50_000


def _cut_task(vocabulary: str, end_id: int, width: int, capacity: int):
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = with_end(*encoder(vocabulary).encode(batch.column("text")), end_id)
            total = np.diff(bounds)
            n_pieces = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), n_pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * capacity
            length = np.minimum(total[row] - start, capacity)
            at = np.append(0, np.cumsum(length)) * width
            ids = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat.astype(kind))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total[row], pa.int64()), ids.cast(pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def _knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best value of items within ``room``, each any number of times, and how many of each."""
    best, chosen = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fit = np.searchsorted(sizes, w, "right")
        best[w] = best[w - 1]
        if fit:
            value = best[w - sizes[:fit]] + prices[:fit]
            i = int(np.argmax(value))
            if value[i] > best[w] + 1e-12:
                best[w], chosen[w] = value[i], i
    counts, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if chosen[w] < 0:
            w -= 1
        else:
            counts[chosen[w]] += 1
            w -= sizes[chosen[w]]
    return float(best[room]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Basic optimal patterns (one per row: pieces of each size) and how often each is used, not rounded.

    Minimises the number of sequences that hold ``demand`` pieces of each of
    the ascending ``sizes``. A revised simplex method keeps the inverse of the
    basis; Farley's bound ends it.
    """
    m = len(sizes)
    basis = np.diag(room // sizes).astype(np.int64)  # row p: pattern p
    inverse = np.diag(1.0 / np.diag(basis))  # of the matrix whose columns are the patterns
    used = inverse @ demand
    for _ in range(50 * m):
        prices = inverse.sum(0)
        value, pattern = _knapsack(np.maximum(prices, 0), sizes, room)
        if value <= 1 + gap:
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, used / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[out] = pattern
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        used = np.maximum(inverse @ demand, 0)
    return basis, used


class Plan:
    """Which ranks of each class go to which pattern, and where the rest begins."""

    def __init__(self, histogram: dict[int, int], capacity: int, unit: int):
        room = capacity // unit
        by_class: dict[int, int] = {}
        for length, n in histogram.items():
            by_class[-(-length // unit)] = by_class.get(-(-length // unit), 0) + n
        self.sizes = np.array(sorted(by_class), np.int64)
        demand = np.array([by_class[s] for s in self.sizes], float)
        basis, used = patterns(self.sizes, demand, room) if len(self.sizes) else (np.zeros((0, 0), np.int64), np.zeros(0))
        copies = np.floor(used + 1e-7).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(copies)))
        self.n_sequences = int(first[-1])
        #: by class: bounds of ranks, and for each range its first sequence, pieces a sequence and first slot
        self.deals: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        slots = np.cumsum(basis, 1) - basis
        left = demand.astype(np.int64)
        for i, size in enumerate(self.sizes):
            own = np.flatnonzero((basis[:, i] > 0) & (copies > 0))
            bounds = np.append(0, np.cumsum(basis[own, i] * copies[own]))
            over = bounds > left[i]  # a pattern may ask for more pieces of a class than there are
            bounds[over] = left[i]
            self.deals[int(size)] = (bounds, first[own], basis[own, i], slots[own, i])

    def deal(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and slot of the pieces of these ranks; sequence -1 for the rest."""
        bounds, first, each, slot = self.deals[size]
        if len(first) == 0:
            return np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        i = np.minimum(np.searchsorted(bounds, rank, "right") - 1, len(first) - 1)
        within = rank - bounds[i]
        rest = rank >= bounds[-1]
        return np.where(rest, -1, first[i] + within // each[i]), np.where(rest, 0, slot[i] + within % each[i])


def _deal_task(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(sequence_id=np.int64(-1), slot=np.int64(0))
            for size, at in batch.groupby("size").indices.items():
                sequence, slot = plan.deal(int(size), batch["rank"].to_numpy()[at])
                batch.iloc[at, batch.columns.get_loc("sequence_id")] = sequence
                batch.iloc[at, batch.columns.get_loc("slot")] = slot
            yield batch[["piece", "length", "sequence_id", "slot"]]

    return run


def _rest_cuts(length: int, at: int, total: int, capacity: int) -> list[int]:
    """Places within ``at`` .. ``at + length`` where sequences of the rest begin: every ``capacity``, at the end powers of two."""
    whole = total // capacity * capacity
    edges, edge = [], whole
    for bit in reversed(range(capacity.bit_length())):
        if (total - whole) >> bit & 1:
            edges.append(edge)
            edge += 1 << bit
    begins = [*range(at // capacity * capacity, min(at + length, whole), capacity), *edges]
    return [b for b in begins if at < b < at + length]


def _rest_task(total: int, capacity: int, first: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = total // capacity * capacity
        starts = [whole + (((total - whole) >> (b + 1)) << (b + 1)) for b in reversed(range(capacity.bit_length())) if (total - whole) >> b & 1]
        for batch in batches:
            rows = []
            for piece, length, at in zip(batch["piece"], batch["length"], batch["at"], strict=True):
                edges = [at, *_rest_cuts(length, at, total, capacity), at + length]
                for a, b in zip(edges, edges[1:]):
                    if a < whole:
                        number, begin = a // capacity, a // capacity * capacity
                    else:
                        k = int(np.searchsorted(starts, a, "right")) - 1
                        number, begin = whole // capacity + k, starts[k]
                    rows.append((piece, a - at, b - a, first + number, a - begin))
            yield pd.DataFrame(rows, columns=["piece", "skip", "length", "sequence_id", "offset"])

    return run


def _slice_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skip, length = batch.column("skip").to_pylist(), batch.column("length").to_pylist()
            ids = [np.frombuffer(x, f"<u{width}", n, s * width).astype("<u4").tobytes() for x, s, n in zip(batch.column("ids").to_pylist(), skip, length, strict=True)]
            columns = {c: batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(ids, pa.binary())], [*columns, "ids"])

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids (a power of two, a multiple of ``unit``).

    Returns per piece doc_id, start, length, doc_tokens, sequence_id, offset
    and ids (little-endian 32-bit bytes). Every id lies in one piece, and the
    pieces of a sequence follow each other from 0 without gaps.
    """
    width = id_width(vocabulary, end_id)
    cut = whole_text(docs).mapInArrow(_cut_task(vocabulary, end_id, width, capacity), "doc_id long, start long, length long, doc_tokens long, ids binary")
    pieces = stored(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")

    size = F.ceil(F.col("length") / unit).alias("size")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, capacity, unit)
    n_shares = max(1, math.ceil(sum(histogram.values()) / RANKED))

    # rank within a class: counts of hashed shares, then rows within a share
    narrow = pieces.select("piece", "length", size, F.pmod(F.xxhash64("piece"), F.lit(n_shares)).alias("share"))
    before = Window.partitionBy("size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    shares = narrow.groupBy("size", "share").agg(F.count("*").alias("n")).select("size", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("size", "share").orderBy("piece"))
    ranked = narrow.withColumn("row", within).join(shares, ["size", "share"]).select("piece", "length", "size", (F.col("ahead") + F.col("row") - 1).alias("rank"))
    dealt = stored(ranked.mapInPandas(_deal_task(plan), "piece long, length long, sequence_id long, slot long"), "dealt")

    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    full = dealt.filter("sequence_id >= 0").select("piece", F.lit(0).cast("long").alias("skip"), "length", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
    # the rest: at most one sequence for each of the capacity / unit classes
    rest = dealt.filter("sequence_id < 0")
    total = rest.agg(F.sum("length")).first()[0] or 0
    ahead = F.coalesce(F.sum("length").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = rest.select("piece", "length", ahead.alias("at")).mapInPandas(_rest_task(total, capacity, plan.n_sequences), "piece long, skip long, length long, sequence_id long, offset long")

    payload = pieces.select("piece", "doc_id", F.col("start").alias("begin"), "doc_tokens", "ids")
    joined = full.unionByName(rest).join(payload, "piece")
    joined = joined.select("doc_id", (F.col("begin") + F.col("skip")).alias("start"), "skip", "length", "doc_tokens", "sequence_id", "offset", "ids")
    return joined.mapInArrow(_slice_task(width), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def packed_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``pack`` with a digest of each piece's ids in place of the ids."""
    return pack(docs, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
