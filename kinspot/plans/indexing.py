"""Building every index table of a corpus in one job."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspot.functions.vectors import HASH_DIM
from kinspot.operators.dense import build_dense_index, usual_length
from kinspot.operators.embedding import Embedder, embed_column, embed_missing, hash_embed, hash_embed_text
from kinspot.operators.sparse import SparseIndex, build_sparse_index, load_sparse_index
from kinspot.session import new_path, written

#: what a build leaves about itself
ABOUT = "version string, dim int, embedder string"


@dataclass(frozen=True)
class CorpusIndex:
    corpus: DataFrame  # doc_id, text, ...
    sparse: SparseIndex
    dense: DataFrame  # doc_id, unit_vec
    dim: int
    embed: Embedder | None

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        """Unit vectors ``(query_id, unit_vec)`` of query texts, as for the corpus."""
        if self.embed is None:
            vectors = hash_embed_text(queries, id_col="query_id", dim=self.dim)
        else:
            vectors = embed_column(queries, self.embed, id_col="query_id")
        return build_dense_index(vectors, dim=self.dim).withColumnRenamed("doc_id", "query_id")


def build_indexes(
    corpus: DataFrame, path: str | None = None, embed: Embedder | None = None, dim: int = HASH_DIM, embedder: str = "hashed"
) -> CorpusIndex:
    """Sparse and dense index tables of a corpus ``(doc_id, text)``, whose ids must be unique.

    The default embedding hashes the term counts the sparse index has already
    made; with ``embed`` the user's model, known by the name ``embedder``, is
    called for rows whose text has no stored embedding yet. Given a path, the
    build may be repeated on a grown or changed corpus: embeddings stay there
    from build to build, each build's tables are a version of their own, and
    :func:`load_indexes` finds the last version that was finished.
    """
    spark = corpus.sparkSession
    if not corpus.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("doc_id is not unique")
    root = path or new_path(spark, "index")
    version = f"{root}/version-{uuid.uuid4().hex}"
    if path is not None:
        corpus = written(corpus, "corpus", f"{version}/corpus")
    sparse = build_sparse_index(corpus, f"{version}/sparse")
    if embed is None:
        vectors = hash_embed(sparse.counts, dim, sparse.counts.count())
    else:
        vectors = embed_missing(corpus, f"{root}/embeddings-{embedder}", embed).select("doc_id", "embedding")
    width = dim if embed is None else usual_length(vectors) or dim
    dense = written(build_dense_index(vectors, dim=width), "dense", f"{version}/dense")
    about = spark.createDataFrame([(version, width, embedder if embed else "hashed")], ABOUT)
    about.coalesce(1).write.mode("append").parquet(f"{root}/versions/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}")
    return CorpusIndex(corpus=corpus, sparse=sparse, dense=dense, dim=width, embed=embed)


def load_indexes(
    spark: SparkSession, path: str, embed: Embedder | None = None, dim: int | None = None, embedder: str = "hashed"
) -> CorpusIndex:
    """Index tables of the last build at ``path``; ``dim`` and embedder must be those it was built with."""
    about = spark.read.schema(ABOUT).parquet(f"{path}/versions/*").select("*", F.col("_metadata.file_modification_time").alias("at"))
    last = about.orderBy(F.desc("at"), F.desc("version")).first()
    if (embedder if embed else "hashed") != last["embedder"] or dim not in (None, last["dim"]):
        raise ValueError(f"the index was built with {last['embedder']} vectors of {last['dim']} numbers")
    return CorpusIndex(
        corpus=spark.read.parquet(f"{last['version']}/corpus"),
        sparse=load_sparse_index(spark, f"{last['version']}/sparse"),
        dense=spark.read.parquet(f"{last['version']}/dense"),
        dim=last["dim"],
        embed=embed,
    )


def index_sizes(index: CorpusIndex) -> DataFrame:
    """Row count of every index table."""
    tables = {
        "corpus": index.corpus,
        "dense": index.dense,
        "postings": index.sparse.postings,
        "term_stats": index.sparse.term_stats,
        "doc_stats": index.sparse.doc_stats,
    }
    counts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
