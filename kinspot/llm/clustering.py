"""Exact Lloyd clustering of vectors on an integer grid, with heaps of bound gaps.

A vector's gap is the lower bound of its distance to the second nearest
centroid less the upper bound of its distance to its own. When centroids move,
a gap shrinks by no more than its own centroid's move and the largest move of
the others. So each cluster keeps a heap of its vectors' gaps, each raised by
the drift that the cluster had accumulated when the gap was measured: a gap
has expired when its entry is not above the drift of now. A round looks at the
top of each heap, pops what has expired, measures these vectors exactly
against all centroids, and pushes them into the heap of their nearest. Vectors
whose entries stay in a heap are not touched.

Vectors are packed into blocks, one table row each, that are written once; a
block's heaps are a row of a narrow table that is written anew each round and
joined by block number. Sums over clusters are kept from round to round: a
block gives the sums of the vectors that came and went, which are added up
before the shuffle, and only clusters times components numbers go to the
driver. All arithmetic on vectors and centroids is in whole numbers; bounds
are real numbers with a margin far above their rounding, and ties are always
measured anew.

Cases: vectors that are null, of another length, or that hold null or
non-finite components are left out, and so are those with a component beyond
``LARGEST`` steps of the grid, whose squared distances have no 64-bit integer.
Rows that share an id are vectors each; a null id hashes like an id without
digits. With fewer vectors than clusters, each starts a cluster; equal starts
leave the later ones empty, and an empty cluster stays where it is. No vectors
give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kinspot.llm.stage import stored

BLOCK_ROWS = 4096
#: blocks that a worker holds at once
BATCH_BLOCKS = 8
LARGEST = 1 << 27
#: components up to this size are multiplied as doubles, which is exact
EXACT = 1 << 22
#: a gap within this of the drift counts as expired; distances are rounded by far less
MARGIN = 1e-4

VECTORS = "block long, ids array<long>, vectors binary"
HEAPS = "block long, entries binary, slots binary, sizes binary, moved array<long>"


def on_grid(embeddings: DataFrame, id_col: str, vec_col: str, width: int, scale: int) -> DataFrame:
    """``id`` and ``v`` (array of double) of the vectors that can be clustered."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= LARGEST))
    kept = embeddings.filter((F.size(v) == width) & F.coalesce(sound, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _pack_task(width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            grid = np.floor(flat * scale).astype("<i4").reshape(-1, width)
            for start in range(0, len(grid), BLOCK_ROWS):
                part = grid[start : start + BLOCK_ROWS]
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column("id").slice(start, len(part)))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([part.tobytes()], pa.binary())], ["block", "ids", "vectors"])
                number += 1

    return run


def squared_distances(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer centers."""
    kind = np.float64 if max(np.abs(vectors).max(initial=0), np.abs(centers).max(initial=0)) <= EXACT else np.int64
    products = (vectors.astype(kind) @ centers.astype(kind).T).astype(np.int64)
    x, c = vectors.astype(np.int64), centers.astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * products + (c * c).sum(1)[None, :]


class GapHeaps:
    """For each cluster the entries of its vectors (gap plus drift when measured) in heap order, and their slots in the block."""

    def __init__(self, entries: np.ndarray, slots: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes)[:-1]
        self.entries, self.slots = np.split(entries, ends), np.split(slots, ends)
        self.opened: dict[int, list[tuple[float, int]]] = {}

    def _open(self, cluster: int) -> list[tuple[float, int]]:
        """The heap as a list that can be popped and pushed; heaps that are not touched stay arrays."""
        if cluster not in self.opened:
            self.opened[cluster] = list(zip(self.entries[cluster].tolist(), self.slots[cluster].tolist(), strict=True))
        return self.opened[cluster]

    def pop_expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots whose gap has expired, and the clusters they were in."""
        slots, owners = [], []
        for cluster, entries in enumerate(self.entries):
            limit = drift[cluster] + MARGIN
            if not len(entries) or entries[0] > limit:
                continue
            heap = self._open(cluster)
            while heap and heap[0][0] <= limit:
                slots.append(heapq.heappop(heap)[1])
                owners.append(cluster)
        return np.array(slots, np.int64), np.array(owners, np.int64)

    def push(self, cluster: int, entries: np.ndarray, slots: np.ndarray) -> None:
        if len(self.entries[cluster]) == 0 and cluster not in self.opened:
            order = np.argsort(entries, kind="stable")  # a sorted array is a heap
            self.entries[cluster], self.slots[cluster] = entries[order], slots[order]
            return
        heap = self._open(cluster)
        for entry in zip(entries.tolist(), slots.tolist(), strict=True):
            heapq.heappush(heap, entry)

    def columns(self) -> tuple[bytes, bytes, bytes]:
        for cluster, heap in self.opened.items():
            self.entries[cluster] = np.array([e for e, _ in heap], np.float64)
            self.slots[cluster] = np.array([s for _, s in heap], np.int64)
        sizes = np.array([len(e) for e in self.entries], "<i4")
        return np.concatenate(self.entries).astype("<f8").tobytes(), np.concatenate(self.slots).astype("<i4").tobytes(), sizes.tobytes()

    def owners(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for cluster, slots in enumerate(self.slots):
            out[[s for _, s in self.opened[cluster]] if cluster in self.opened else slots] = cluster
        return out


def _rescan(vectors: np.ndarray, centers: np.ndarray, drift: np.ndarray, heaps: GapHeaps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pop, measure and push; the slots that were measured, the clusters they leave and those they go to."""
    slots, old = heaps.pop_expired(drift)
    if not len(slots):
        return slots, old, old
    distances = squared_distances(vectors[slots], centers)
    new = distances.argmin(1)  # of equal ones the first
    at = np.arange(len(slots))
    nearest = distances[at, new]
    distances[at, new] = np.iinfo(np.int64).max
    gaps = np.sqrt(distances.min(1).astype(float)) - np.sqrt(nearest.astype(float)) if len(centers) > 1 else np.full(len(slots), math.inf)
    for cluster in np.unique(new):
        own = new == cluster
        heaps.push(int(cluster), gaps[own] + drift[cluster], slots[own])
    return slots, old, new


def _moved(vectors: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """Per cluster the count and the sums of the vectors that came, less those that went (``old`` is -1 at first)."""
    rows = np.concatenate((np.ones((len(vectors), 1), np.int64), vectors.astype(np.int64)), axis=1)
    total = np.zeros((k + 1, rows.shape[1]), np.int64)
    np.add.at(total, new, rows)
    np.subtract.at(total, old, rows)  # -1 is the row that is cut off
    return total[:k]


def _first_heaps(vectors: np.ndarray, k: int) -> GapHeaps:
    """All vectors expired, in the first heap."""
    sizes = np.zeros(k, np.int64)
    sizes[0] = len(vectors)
    return GapHeaps(np.full(len(vectors), -math.inf), np.arange(len(vectors)), sizes)


def _blocks(batch: pa.RecordBatch, width: int, k: int) -> Iterator[tuple[int, np.ndarray, GapHeaps, bool]]:
    """Row number, vectors and heaps of each block, and whether it has been clustered before."""
    for row in range(batch.num_rows):
        vectors = np.frombuffer(batch.column("vectors")[row].as_py(), "<i4").reshape(-1, width)
        known = "sizes" in batch.schema.names
        if not known:
            yield row, vectors, _first_heaps(vectors, k), False
            continue
        kinds = {"entries": "<f8", "slots": "<i4", "sizes": "<i4"}
        yield row, vectors, GapHeaps(*(np.frombuffer(batch.column(c)[row].as_py(), kind) for c, kind in kinds.items())), True


def _round_task(centers: np.ndarray, drift: np.ndarray):
    k, width = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, vectors, heaps, known in _blocks(batch, width, k):
                slots, old, new = _rescan(vectors, centers, drift, heaps)
                changed = old != new if known else np.ones(len(slots), bool)
                moved = _moved(vectors[slots[changed]], old[changed] if known else np.full(len(slots), -1), new[changed], k)
                entries, places, sizes = heaps.columns()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block").slice(row, 1), *(pa.array([x], pa.binary()) for x in (entries, places, sizes)), pa.array([moved.ravel().tolist()], pa.list_(pa.int64()))],
                    ["block", "entries", "slots", "sizes", "moved"])

    return run


def _assign_task(centers: np.ndarray, drift: np.ndarray):
    k, width = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, vectors, heaps, _ in _blocks(batch, width, k):
                _rescan(vectors, centers, drift, heaps)
                owners = heaps.owners(len(vectors))
                apart = vectors.astype(np.int64) - centers[owners]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, pa.array(owners, pa.int32()), pa.array((apart * apart).sum(1))], ["vec_id", "cluster", "distance"])

    return run


def _starts(vectors: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of seed and id; equal ids in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()  # k rows
    return np.array([[math.floor(scale * x) for x in r.v] for r in first], np.int64)


def _joined(blocks: DataFrame, heaps: DataFrame | None) -> DataFrame:
    return blocks if heaps is None else blocks.join(heaps.drop("moved"), "block")


def cluster_vectors(
    embeddings: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, width: int = 64, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, Sequence[Sequence[int]]]:
    """``vec_id, cluster, distance`` (squared, on the grid) of every sound vector after ``rounds`` rounds, and the centroids."""
    sound = on_grid(embeddings, id_col, vec_col, width, scale)
    blocks = stored(sound.mapInArrow(_pack_task(width, scale), VECTORS), "vector-blocks", BLOCK_ROWS)
    centers = _starts(sound, k, seed, scale)
    spark = embeddings.sparkSession
    if not len(centers):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    k, heaps = len(centers), None
    totals, drift = [[0] * (width + 1) for _ in range(k)], np.zeros(k)
    for turn in range(rounds):
        heaps = stored(_joined(blocks, heaps).mapInArrow(_round_task(centers, drift), HEAPS), f"heaps-{turn}", BATCH_BLOCKS)
        # clusters times components sums, whatever the number of vectors
        added = heaps.select(F.posexplode("moved").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
        for row in added:
            totals[row["at"] // (width + 1)][row["at"] % (width + 1)] += row["n"]
        before = centers
        centers = np.array([[s // t[0] for s in t[1:]] if t[0] else old.tolist() for t, old in zip(totals, before)], np.int64)
        moves = np.sqrt(((centers - before).astype(float) ** 2).sum(1))
        others = [np.delete(moves, c).max(initial=0.0) for c in range(k)]
        drift = drift + moves + np.array(others)
    assigned = stored(_joined(blocks, heaps).mapInArrow(_assign_task(centers, drift), "vec_id long, cluster int, distance long"), "clusters", BATCH_BLOCKS)
    return assigned, centers.tolist()


def cluster_report(embeddings: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, width: int = 64) -> DataFrame:
    """Cluster and squared distance of each vector, inertia of its cluster and of all, digest of its centroid."""
    assigned, centers = cluster_vectors(embeddings, k, rounds, seed, scale, width)
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    about = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centers)]
    known = embeddings.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
