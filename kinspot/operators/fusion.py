"""Fusing and hydrating ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspot.operators.topk import top_k

# --- fixed values -----------------------------------------------------------
RRF_K = 60
DEPTH_FACTOR = 2  # each list is read to this multiple of the final k
# ----------------------------------------------------------------------------


def _share(rank: str, rrf_k: Column) -> Column:
    """Reciprocal of the shifted 0-based rank; nothing for an absent document."""
    return F.coalesce(F.try_divide(F.lit(1.0), rrf_k + F.col(rank) - 1), F.lit(0.0))


def merge_lists(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Union of two ranked lists, with both ranks (null where absent)."""
    left = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    right = sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"))
    return left.join(right, ["query_id", "doc_id"], "full_outer")


def rrf_topk(dense: DataFrame, sparse: DataFrame, k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two lists of depth ``2 k``, cut to ``k``."""
    depth = DEPTH_FACTOR * k
    merged = merge_lists(dense.where(F.col("rank") <= depth), sparse.where(F.col("rank") <= depth))
    score = _share("dense_rank", F.lit(rrf_k)) + _share("sparse_rank", F.lit(rrf_k))
    return top_k(merged.select("query_id", "doc_id", F.round(score, 9).alias("score")), k)


def rrf_topk_sweep(dense: DataFrame, sparse: DataFrame, rrf_ks: Sequence[int], k: int = 10) -> DataFrame:
    """:func:`rrf_topk` for several constants over one pair of lists."""
    depth = DEPTH_FACTOR * k
    merged = merge_lists(dense.where(F.col("rank") <= depth), sparse.where(F.col("rank") <= depth))
    swept = merged.withColumn("rrf_k", F.explode(F.array(*[F.lit(r) for r in rrf_ks])))
    score = _share("dense_rank", F.col("rrf_k")) + _share("sparse_rank", F.col("rrf_k"))
    scored = swept.select("rrf_k", "query_id", "doc_id", F.round(score, 9).alias("score"))
    return top_k(scored, k, by=("rrf_k", "query_id"))


def hydrate(hits: DataFrame, corpus: DataFrame, *columns: str) -> DataFrame:
    """Corpus columns of the hits, with score and rank."""
    return hits.join(corpus.select("doc_id", *columns), "doc_id")


def match_records(hits: DataFrame, *columns: str) -> DataFrame:
    """One row per query with its (at most k) hits as an array in rank order."""
    record = F.struct("rank", "doc_id", *columns, "score")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(record)).alias("matches"))
