"""Exact nearest vectors by inner product.

Exact search has to compare every query with every vector; what can be saved
is everything around the arithmetic. Vectors are packed into blocks, a block
of queries meets a block of the corpus once as a matrix product inside a task,
and only the k best rows per query leave the task.

Query blocks meet corpus blocks on a grid: each corpus block has a lane and is
copied to every group of query blocks, each query block has a group and is
copied to every lane, and both sides are joined on the two numbers. The grid's
sides follow from the numbers of blocks. Spark broadcasts a side that is below
its own threshold.

Vectors that are null, empty or hold null or non-finite numbers have no
similarity to anything, and neither have two vectors of unequal length. An
index holds vectors of one length, the given one or else the most frequent;
``unsound_vectors`` lists what is left out. Queries of another length get no hits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspot.functions.vectors import SCORE_DIGITS, as_vector, l2_normalize
from kinspot.operators.topk import top_k
from kinspot.session import written

BLOCK_ROWS = 1024
# Products of two blocks that one task works off, about.
TASK_PRODUCTS = 64
# Query blocks whose k-th best scores a task remembers, and the most that rounding changes in a score and its limit.
KNOWN_BLOCKS = 256
ROUNDING = 2 * 10.0**-SCORE_DIGITS


def sound_vector(vector: Column | str) -> Column:
    """True for vectors that have a length and finite numbers only."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))


def usual_length(embeddings: DataFrame, vec_col: str = "embedding") -> int | None:
    """Most frequent length of the sound vectors, of equally frequent ones the smallest; null without vectors."""
    v = as_vector(vec_col)
    counts = embeddings.where(sound_vector(v)).groupBy(F.size(v).alias("length")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "length").first()
    return first["length"] if first else None


def unsound_vectors(embeddings: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """``doc_id, problem`` of vectors that cannot be searched: null, empty, not finite, or not of length ``dim`` (the usual one)."""
    v = as_vector(vec_col)
    dim = usual_length(embeddings, vec_col) if dim is None else dim
    problem = F.when(v.isNull(), F.lit("null")).when(F.size(v) == 0, F.lit("empty")).when(~sound_vector(v), F.lit("not finite"))
    problem = problem.when(F.size(v) != F.lit(dim), F.lit("wrong length"))
    return embeddings.select(F.col(id_col).alias("doc_id"), problem.alias("problem")).where(F.col("problem").isNotNull())


def build_dense_index(embeddings: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Unit vectors by id; written as Parquet this is the dense index.

    What :func:`unsound_vectors` lists is not in it. Without ``dim`` the
    vectors are looked through once more for their usual length.
    """
    v = as_vector(vec_col)
    dim = usual_length(embeddings, vec_col) if dim is None else dim
    return embeddings.where(sound_vector(v) & (F.size(v) == F.lit(dim))).select(F.col(id_col).alias("doc_id"), l2_normalize(v).alias("unit_vec"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        widths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            alike = batch if (widths == width).all() else batch.take(pa.array(np.flatnonzero(widths == width)))
            for start in range(0, alike.num_rows, BLOCK_ROWS):
                part = alike.slice(start, BLOCK_ROWS)
                vectors = part.column(1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                        pa.ListArray.from_arrays(pa.array([0, len(vectors)], pa.int32()), vectors),
                        pa.array([width], pa.int32()),
                    ],
                    names=["ids", "vectors", "width"],
                )


def pack_blocks(vectors: DataFrame) -> DataFrame:
    """Pack ``(id, unit vector)`` rows into blocks of ids and one flat array, each of vectors of one ``width``."""
    id_col, vec_col = vectors.columns
    id_type = vectors.schema[id_col].dataType.simpleString()
    return vectors.where(sound_vector(vec_col)).mapInArrow(_pack, f"ids array<{id_type}>, vectors array<double>, width int")


def block_topk(k: int, exclude_self: bool):
    """The k best rows per query of rows that hold a block of queries and one of the corpus.

    A task remembers the k-th best score of the queries of its last
    ``KNOWN_BLOCKS`` blocks: of a later block only rows that reach it are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                q_list, d_list = (batch.column(name)[row].values for name in ("q_ids", "ids"))
                q_flat, d_flat = (batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in ("q_vectors", "vectors"))
                q_ids, d_ids = q_list.to_numpy(zero_copy_only=False), d_list.to_numpy(zero_copy_only=False)
                scores = q_flat.reshape(len(q_ids), -1) @ d_flat.reshape(len(d_ids), -1).T
                block = hashlib.blake2b(np.ascontiguousarray(q_flat), digest_size=16).digest(), tuple(q_ids.tolist())
                least = known.pop(block, None)
                if least is None:
                    if exclude_self:
                        allowed = np.asarray(q_ids[:, None] != d_ids[None, :], bool)
                        scores = np.where(allowed, scores, -np.inf)
                    # the k-th best score of each row, less what rounding may add
                    at = max(0, scores.shape[1] - k)
                    least = np.partition(scores, at, axis=1)[:, at] - ROUNDING
                rows, columns = np.divmod(np.flatnonzero(scores >= least[:, None]), len(d_ids))
                if exclude_self:
                    other = np.asarray(q_ids[rows] != d_ids[columns], bool)
                    rows, columns = rows[other], columns[other]
                values = np.round(scores[rows, columns], SCORE_DIGITS) + 0.0
                by_id = np.empty(len(d_ids), np.int64)
                by_id[np.argsort(d_ids, kind="stable")] = np.arange(len(d_ids))
                order = np.lexsort((by_id[columns], -values, rows))
                rows, columns, values = rows[order], columns[order], values[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                kept = place < k
                last = place == k - 1
                least[rows[last]] = np.maximum(least[rows[last]], values[last] - ROUNDING)
                known[block] = least
                if len(known) > KNOWN_BLOCKS:
                    known.pop(next(iter(known)))
                rows, columns = rows[kept], columns[kept]
                yield pa.RecordBatch.from_arrays(
                    [q_list.take(pa.array(rows)), d_list.take(pa.array(columns)), pa.array(values[kept])],
                    names=["query_id", "doc_id", "score"],
                )

    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")


def dense_topk(
    index: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = False, lanes: int | None = None
) -> DataFrame:
    """Exact top-k by inner product: ``query_id, doc_id, score, rank``.

    ``index`` is ``(doc_id, unit_vec)``, ``queries`` is ``(query_id, unit_vec)``;
    ids may be of any type that can be ordered. With ``exclude_self`` a vector
    is not its own neighbour. ``lanes`` overrides the grid with one group.
    """
    blocks = written(
        pack_blocks(queries.select("query_id", "unit_vec")).select(
            F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "width"
        ),
        "query_blocks",
    )
    groups = 1
    if lanes is None:
        n_query, n_corpus = max(1, blocks.count()), max(1, math.ceil(index.count() / BLOCK_ROWS))
        tasks = n_query * n_corpus / TASK_PRODUCTS
        lanes = min(n_corpus, max(1, math.ceil(math.sqrt(tasks * n_corpus / n_query))))
        groups = min(n_query, max(1, math.ceil(tasks / lanes)))
    lane = F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(lanes).cast("bigint"))
    group = F.pmod(F.xxhash64(F.col("q_ids")[0]), F.lit(groups).cast("bigint"))
    corpus = pack_blocks(index.select("doc_id", "unit_vec")).withColumn("lane", lane).withColumn("group", F.explode(_numbers(groups)))
    asked = blocks.withColumn("group", group).withColumn("lane", F.explode(_numbers(lanes)))
    met = corpus.join(asked, ["lane", "group", "width"]).select("q_ids", "q_vectors", "ids", "vectors")
    kinds = (queries.schema["query_id"].dataType.simpleString(), index.schema["doc_id"].dataType.simpleString())
    hits = met.mapInArrow(block_topk(k, exclude_self), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top_k(hits, k)


def max_corpus_similarity(index: DataFrame, items: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Largest similarity of each item ``(query_id, unit_vec)`` to the corpus."""
    best = dense_topk(index, items, k=1, exclude_self=exclude_self)
    return best.select("query_id", F.col("doc_id").alias("nearest_id"), F.col("score").alias("max_similarity"))
