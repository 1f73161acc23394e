"""Nearest neighbours by a permutation index.

A bounded sample of distinct vectors are the pivots. Every vector is described
by its ``PREFIX`` nearest pivots in order, and posted in the inverted file of
each. The index is cut in blocks of about ``BLOCK_ROWS`` vectors. A block of
queries meets a block of the index in one task: only vectors posted with a
pivot of the query are touched. The footrule distance between the two orders
(places beyond the prefix count as its end) tells how near their directions
are. As the measure is the inner product, a vector's rank is that nearness
times its length, and the first ``SHARE`` of the block is reranked by the exact
inner product. Blocks send their best k, of which the k best remain.

Vectors that are null, zero, of another length than most or hold null or
non-finite components take no part, nor do rows without id; of rows of one id
the smallest vector in array order counts. Ties go to the smaller id. Fewer
candidates than k are all returned. No vectors or no queries give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinspot.llm.stage import stored

#: the bound of the sample that pivots come from, and the pivots
SAMPLED, PIVOTS, PREFIX = 2048, 256, 64
BLOCK_ROWS, QUERY_ROWS, SHARE = 16_384, 4_096, 0.25


@dataclass(frozen=True)
class PermutationIndex:
    """``rows`` (block, vec_id, vector, nearest): vectors as 64-bit floats, pivots as 16-bit numbers."""

    rows: DataFrame
    n_blocks: int
    n_rows: int


def _usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def _order_task(pivots: np.ndarray, prefix: int):
    def run(batches):
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            order = np.argsort(-(x @ pivots.T), 1, kind="stable")[:, :prefix].astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("vec_id"), pa.array([v.astype("<f8").tobytes() for v in x], pa.binary()), pa.array([o.tobytes() for o in order], pa.binary())],
                ["block", "vec_id", "vector", "nearest"])

    return run


def build_index(vectors: DataFrame) -> PermutationIndex:
    """The index of ``vectors`` (vec_id, embedding), written to the shared folder."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    known = known.filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    known = stored(known.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    widths = known.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width, n_rows = (widths["width"], widths["n"]) if widths else (1, 0)
    known = known.filter(F.size("vector") == width)
    drawn = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED).select("vector").collect()
    pivots = np.array(list(dict.fromkeys(tuple(r["vector"]) for r in drawn))[:PIVOTS], float).reshape(-1, width)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    n_blocks = max(1, math.ceil(n_rows / BLOCK_ROWS))
    blocked = known.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    rows = blocked.mapInArrow(_order_task(pivots, min(PREFIX, len(pivots))), "block long, vec_id long, vector binary, nearest binary")
    return PermutationIndex(stored(rows, "permutations"), n_blocks, n_rows)


def _search_task(k: int, share: float):
    names = ["query_id", "vec_id", "score"]

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        index = index.sort_values("vec_id")
        ids, n = index["vec_id"].to_numpy(), len(index)
        x = np.frombuffer(b"".join(index["vector"]), "<f8").reshape(n, -1)
        nearest = np.frombuffer(b"".join(index["nearest"]), "<u2").reshape(n, -1)
        prefix = nearest.shape[1]
        # inverted files: who is posted with a pivot, and how far before the end of its prefix
        order = np.argsort(nearest.ravel(), kind="stable")
        posted, before_end = order // prefix, (prefix - order % prefix).astype(np.int64)
        lists = np.searchsorted(nearest.ravel()[order], np.arange(int(nearest.max()) + 2))
        n_taken = min(n, max(10 * k, math.ceil(share * n)))
        # relative to the largest number, so that no square overflows
        lengths = np.linalg.norm(x / np.abs(x).max(), axis=1)
        out = []
        for query, vector, own in zip(queries["vec_id"], queries["vector"], queries["nearest"], strict=True):
            # footrule distance is 2 * (sum of places) minus 2 * this overlap, so the nearest overlap the most
            overlap = np.zeros(n, np.int64)
            for place, pivot in enumerate(np.frombuffer(own, "<u2")):
                if pivot + 1 < len(lists):
                    at = slice(lists[pivot], lists[pivot + 1])
                    overlap[posted[at]] += np.minimum(before_end[at], prefix - place)
            taken = np.sort(np.argsort(-overlap * lengths, kind="stable")[:n_taken]) if n_taken < n else np.arange(n)
            score = (x[taken] * np.frombuffer(vector, "<f8")).sum(1)
            score[ids[taken] == query] = -np.inf
            best = np.lexsort((ids[taken], -score))[:k]
            best = best[score[best] > -np.inf]
            out.append((np.full(len(best), query), ids[taken][best], score[best]))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def search(index: PermutationIndex, queries: DataFrame, n_queries: int, k: int = 20, share: float = SHARE) -> DataFrame:
    """The ``k`` nearest found of each query (rows of the index's kind): query_id, rank, vec_id, score."""
    n_query_blocks = max(1, math.ceil(n_queries / QUERY_ROWS))
    asked = queries.select("vec_id", "vector", "nearest", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_query_blocks)).alias("query_block"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index.n_blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    held = index.rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))).withColumn("query_block", F.col("query_block").cast("long"))
    keys = ["block", "query_block"]
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_search_task(k, share), "query_id long, vec_id long, score double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Neighbours of the rows whose id ``every`` divides, among all other rows."""
    index = build_index(vectors)
    queries = index.rows.filter(F.col("vec_id") % every == 0)
    return search(index, queries, queries.count(), k)
