"""Exact nearest vectors that reads only the regions which can hold them.

Vectors are grouped around centres, which are vectors drawn by a hash. A
region keeps its centre and the largest angle of its vectors to it (and their
smallest and largest length), so no vector of the region can have a larger
product with a query than its length allows at the smallest angle left:
``|q| * |x| * cos(max(0, angle(q, centre) - largest angle))``.

A probe scores each query exactly in the regions of its highest bounds, which
gives its k-th best score; after that only regions whose bound reaches this
score are read. The result is the exact top k. Where vectors are spread out so
evenly that a query would have to read most regions, it is answered by the
block product of :mod:`kinspot.operators.dense` instead, which copies each
query to fewer places.

A region of many vectors is dealt to parts by a hash of the id, each a block
of its own, so a value that a third of all vectors share is many blocks. Zero
vectors have no direction; they are a region with the bound 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspot.operators.dense import BLOCK_ROWS, block_topk, dense_topk, pack_blocks, sound_vector
from kinspot.operators.topk import top_k
from kinspot.session import new_path, written

#: regions, at most: their centres go to every task
MOST_REGIONS = 4096
#: regions of each query that are scored for its threshold, at least
PROBE_REGIONS = 2
#: a query that would read a larger share of the regions is answered by the block product
LARGEST_SHARE = 0.3
#: what rounding may add to an angle, and to a score that is compared with a bound
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-5
ZEROS = -1
#: cells of a matrix of rows and regions that a task holds at once
MOST_CELLS = 1 << 20


@dataclass(frozen=True)
class RegionIndex:
    """``blocks``: region, part, ids, vectors. ``regions``: region, centre, angle, shortest, longest, n, parts."""

    blocks: DataFrame
    regions: DataFrame


def _row_slices(batches: Iterator[pa.RecordBatch], regions: int) -> Iterator[pa.RecordBatch]:
    """The same rows, as few at once as ``MOST_CELLS`` allows, however many regions there are."""
    step = max(1, MOST_CELLS // max(1, regions))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _assign(centres: np.ndarray):
    """Rows of (id, vector) with region, angle to its centre and length."""
    unit = centres / np.linalg.norm(centres, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _row_slices(batches, len(unit)):
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            lengths = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ unit.T / np.where(lengths > 0, lengths, 1.0)[:, None]
            region = cosines.argmax(1)
            angle = np.arccos(np.clip(cosines[np.arange(len(region)), region], -1.0, 1.0))
            region = np.where(lengths > 0, region, ZEROS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(region.astype(np.int32)), pa.array(np.where(lengths > 0, angle, 0.0)), pa.array(lengths)],
                names=["doc_id", "unit_vec", "region", "angle", "length"],
            )

    return run


def _pack_sorted(names: list[str], ids: str, vectors: str):
    """Consecutive rows that agree on ``names`` become blocks of at most BLOCK_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1
            for first, last in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                for start in range(first, last, BLOCK_ROWS):
                    part = batch.slice(start, min(BLOCK_ROWS, last - start))
                    flat = part.column("unit_vec").flatten()
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[part.column(c).slice(0, 1) for c in names],
                            pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                            pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                        ],
                        names=[*names, ids, vectors],
                    )

    return run


def _packed(rows: DataFrame, names: list[str], ids: str, vectors: str) -> DataFrame:
    """Blocks of rows ``(id, unit_vec, *names)``, each of one value of ``names``."""
    id_type = rows.schema[rows.columns[0]].dataType.simpleString()
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    together = rows.repartition(*names).sortWithinPartitions(*names)
    return together.mapInArrow(_pack_sorted(names, ids, vectors), f"{kinds}, {ids} array<{id_type}>, {vectors} array<double>")


def build_regions(index: DataFrame, path: str | None = None, regions: int | None = None) -> RegionIndex:
    """Write the regions of ``(doc_id, unit_vec)``, about the square root of their number if not given.

    All vectors must have one length; vectors that are not sound are left out.
    """
    spark = index.sparkSession
    root = path or new_path(spark, "regions")
    vectors = index.where(sound_vector("unit_vec")).select("doc_id", "unit_vec")
    n, short, long = vectors.agg(F.count("*"), F.min(F.size("unit_vec")), F.max(F.size("unit_vec"))).first()
    if short != long:
        raise ValueError(f"vectors of {short} to {long} numbers")
    wanted = min(MOST_REGIONS, regions or max(1, math.isqrt(n)))
    some = vectors.where(F.exists("unit_vec", lambda x: x != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted)
    centres = np.array([r["unit_vec"] for r in some.select("unit_vec").collect()], float).reshape(-1, short or 1)  # MOST_REGIONS rows
    centres = np.unique(centres, axis=0) if len(centres) else np.ones((1, short or 1))
    id_type = vectors.schema["doc_id"].dataType.simpleString()
    assigned = written(
        vectors.mapInArrow(_assign(centres), f"doc_id {id_type}, unit_vec array<double>, region int, angle double, length double"), "assigned", f"{root}/assigned"
    )
    about = assigned.groupBy("region").agg(
        F.max("angle").alias("angle"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.count("*").alias("n")
    )
    rows = [(*r, centres[max(r["region"], 0)].tolist(), -(-r["n"] // BLOCK_ROWS)) for r in about.collect()]  # MOST_REGIONS rows
    schema = "region int, angle double, shortest double, longest double, n bigint, centre array<double>, parts bigint"
    summary = written(spark.createDataFrame(rows, schema).coalesce(1), "regions", f"{root}/regions")
    part = F.pmod(F.xxhash64("doc_id"), "parts")
    parted = assigned.join(F.broadcast(summary.select("region", "parts")), "region").select("doc_id", "unit_vec", "region", part.cast("int").alias("part"))
    written(_packed(parted, ["region", "part"], "ids", "vectors"), "blocks", f"{root}/blocks")
    return load_regions(spark, root)


def load_regions(spark: SparkSession, root: str) -> RegionIndex:
    return RegionIndex(spark.read.parquet(f"{root}/blocks"), spark.read.parquet(f"{root}/regions"))


class _Bounds:
    """Bounds of the products of queries with the vectors of every region."""

    def __init__(self, index: RegionIndex):
        rows = index.regions.orderBy("region").collect()  # MOST_REGIONS rows
        self.region = np.array([r["region"] for r in rows], np.int32)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.angle, self.shortest, self.longest = (np.array([r[c] for r in rows]) for c in ("angle", "shortest", "longest"))
        centres = np.array([r["centre"] for r in rows], float)
        self.unit = centres / np.linalg.norm(centres, axis=1, keepdims=True) if len(rows) else np.empty((0, 0))

    def of(self, queries: np.ndarray) -> np.ndarray:
        lengths = np.linalg.norm(queries, axis=1)
        cosines = queries @ self.unit.T / np.where(lengths > 0, lengths, 1.0)[:, None]
        least = np.maximum(0.0, np.arccos(np.clip(cosines, -1.0, 1.0)) - self.angle - ANGLE_SLACK)
        cosines = np.cos(np.minimum(least, np.pi))
        return lengths[:, None] * np.where(cosines > 0, self.longest, self.shortest) * cosines


def _probe(bounds: _Bounds, k: int, probe: int):
    """The regions of the highest bounds of each query: ``probe`` of them, and more until they hold k vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, MOST_CELLS // max(1, len(bounds.region)))
        for batch in batches:
            for row in range(batch.num_rows):
                all_ids, flat = batch.column("q_ids")[row].values, batch.column("q_vectors")[row].values.to_numpy(zero_copy_only=False)
                queries = flat.reshape(len(all_ids), -1)
                for start in range(0, len(all_ids), step):
                    ids, reach = all_ids.slice(start, step), bounds.of(queries[start : start + step])
                    order = np.argsort(-reach, axis=1, kind="stable")
                    held = np.cumsum(bounds.n[order], axis=1) - bounds.n[order]
                    chosen = (np.arange(order.shape[1]) < probe) | (held < k + 1)  # one more, as a query may be left out
                    rows, at = np.nonzero(chosen)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(bounds.region[order[rows, at]])], ["query_id", "region"])

    return run


def _reach(bounds: _Bounds):
    """Regions, probed ones included, whose bound is not below the query's ``least`` score, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _row_slices(batches, len(bounds.region)):
            queries = batch.column("unit_vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            least = batch.column("least").to_numpy(zero_copy_only=False)
            rows, at = np.nonzero(bounds.of(queries) >= np.where(np.isnan(least), -np.inf, least)[:, None] - SCORE_SLACK)
            count = np.bincount(rows, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(rows)), pa.array(bounds.region[at]), pa.array(count[rows].astype(np.int64))], ["query_id", "region", "reached"]
            )

    return run


def _scores(index: RegionIndex, pairs: DataFrame, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k best rows of each block that a query ``(query_id, region)`` meets."""
    groups = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    slot = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")  # a region that all queries reach is several chunks
    asked = pairs.join(queries, "query_id").select("query_id", "unit_vec", "region", slot.alias("slot"))
    chunks = _packed(asked, ["region", "slot"], "q_ids", "q_vectors")
    parts = index.regions.select("region", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    met = chunks.join(parts, "region").join(index.blocks, ["region", "part"]).select("q_ids", "q_vectors", "ids", "vectors")
    kinds = [queries.schema["query_id"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()]
    return met.mapInArrow(block_topk(k, exclude_self), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


@dataclass(frozen=True)
class RegionSearch:
    """A finished search: ``hits`` (query_id, doc_id, score, rank) and the regions each query read."""

    hits: DataFrame
    read: DataFrame  # query_id, region


def region_search(index: RegionIndex, queries: DataFrame, k: int = 10, exclude_self: bool = False, probe: int = PROBE_REGIONS) -> RegionSearch:
    """Exact top-k by inner product of queries ``(query_id, unit_vec)``, ids unique, with the vectors of the regions."""
    bounds = _Bounds(index)
    width = bounds.unit.shape[1]  # 0 without regions: then no query has it
    asked = written(queries.where(sound_vector("unit_vec") & (F.size("unit_vec") == width)).select("query_id", "unit_vec"), "asked")
    id_type = asked.schema["query_id"].dataType.simpleString()
    packed = pack_blocks(asked).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    probed = written(packed.mapInArrow(_probe(bounds, k, probe), f"query_id {id_type}, region int"), "probed")
    first = written(top_k(_scores(index, probed, asked, k, exclude_self), k), "probe_hits").drop("rank")
    least = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") >= k)
    scored = asked.join(least.select("query_id", "least"), "query_id", "left")
    reached = written(scored.select("query_id", "unit_vec", "least").mapInArrow(_reach(bounds), f"query_id {id_type}, region int, reached bigint"), "reached")
    many = F.col("reached") > max(2 * probe, LARGEST_SHARE * len(bounds.region))
    left = written(reached.where(~many).select("query_id", "region").join(probed, ["query_id", "region"], "left_anti"), "left_regions")
    spread = written(asked.join(reached.where(many).select("query_id").distinct(), "query_id", "left_semi"), "spread_queries")
    near = first.join(spread.select("query_id"), "query_id", "left_anti").unionByName(_scores(index, left, asked, k, exclude_self))
    if not spread.isEmpty():
        vectors = index.blocks.select(F.explode(F.arrays_zip("ids", _rows("vectors", width))).alias("x"))
        vectors = vectors.select(F.col("x.ids").alias("doc_id"), F.col("x.unit_vec").alias("unit_vec"))
        near = near.unionByName(dense_topk(vectors, spread, k, exclude_self).drop("rank"))
    read = left.unionByName(probed).unionByName(reached.where(many).select("query_id", "region")).distinct()
    return RegionSearch(top_k(near, k), read)


def _rows(flat: str, width: int):
    """A flat array of numbers as an array of vectors."""
    starts = F.sequence(F.lit(1), F.size(flat), F.lit(width))
    return F.transform(starts, lambda at: F.slice(flat, at, F.lit(width))).alias("unit_vec")
