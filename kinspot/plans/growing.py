"""Sparse and dense index of a corpus that grows, one segment for each batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kinspot.functions.vectors import HASH_DIM
from kinspot.operators.dense import build_dense_index, dense_topk
from kinspot.operators.embedding import Embedder, embed_column, hash_embed_text, hash_unit_terms
from kinspot.operators.fusion import DEPTH_FACTOR, rrf_topk
from kinspot.operators.segments import SegmentedIndex, add_documents, load_segments, merge_segments, segmented_topk, small_segments
from kinspot.session import written

DENSE = "dense"


def _dense_schema(index: SegmentedIndex) -> str:
    return f"doc_id {index.id_type}, unit_vec array<double>"


def _vectors(texts: DataFrame, id_col: str, embed: Embedder | None, dim: int) -> DataFrame:
    if embed is None:
        return build_dense_index(hash_embed_text(texts, id_col=id_col, dim=dim), dim=dim)
    # written, as its length is looked up: no text is embedded twice
    return build_dense_index(written(embed_column(texts, embed, id_col=id_col), "embedded"))


@dataclass(frozen=True)
class GrowingIndex:
    sparse: SegmentedIndex
    dim: int
    embed: Embedder | None

    @property
    def dense(self) -> DataFrame:
        """``doc_id, unit_vec`` of the documents of now."""
        return self.sparse.beside(DENSE, _dense_schema(self.sparse)).select("doc_id", "unit_vec")

    def sparse_hits(self, queries: DataFrame, k: int) -> DataFrame:
        return written(segmented_topk(self.sparse, queries, k), "sparse_hits")

    def dense_hits(self, queries: DataFrame, k: int) -> DataFrame:
        asked = _vectors(queries, "query_id", self.embed, self.dim).withColumnRenamed("doc_id", "query_id")
        return written(dense_topk(self.dense, asked, k), "dense_hits")

    def hybrid_hits(self, queries: DataFrame, k: int) -> DataFrame:
        depth = DEPTH_FACTOR * k
        return rrf_topk(self.dense_hits(queries, depth), self.sparse_hits(queries, depth), k)


def grow_indexes(
    batch: DataFrame, path: str, removed: DataFrame | None = None, embed: Embedder | None = None, dim: int = HASH_DIM
) -> GrowingIndex:
    """Add a batch ``(doc_id, text)`` of new and changed documents, and take away ``removed`` ones.

    Only texts of the batch are tokenised and embedded.
    """
    # the default embedding counts the terms that the sparse index holds; a model reads texts
    dense = _vectors(batch, "doc_id", embed, dim) if embed else lambda terms: hash_unit_terms(terms, dim)
    index = add_documents(batch, path, removed, beside={DENSE: dense})
    return GrowingIndex(index, dim, embed)


def load_growing(spark: SparkSession, path: str, embed: Embedder | None = None, dim: int = HASH_DIM) -> GrowingIndex:
    return GrowingIndex(load_segments(spark, path), dim, embed)


def tidy_indexes(spark: SparkSession, path: str, most: int = 8, embed: Embedder | None = None, dim: int = HASH_DIM) -> GrowingIndex:
    """Merge the smallest segments so that at most ``most`` are left."""
    index = load_segments(spark, path)
    if names := small_segments(index, most):
        index = merge_segments(spark, path, names, {DENSE: _dense_schema(index)})
    return GrowingIndex(index, dim, embed)
