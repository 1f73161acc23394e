"""Embedding a text column, and keeping stored embeddings up to date."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspot.functions.vectors import HASH_DIM, hash_bucket
from kinspot.operators.sparse import term_counts
from kinspot.session import table_exists, written

# --- fixed values -----------------------------------------------------------
EMBED_BATCH = 128
#: term counts, and documents, that one task groups, about
TASK_COUNTS, TASK_DOCS = 2_000_000, 5_000
#: terms whose buckets a task remembers, about
KNOWN_TERMS = 1 << 17
#: documents whose vectors are made at once
EMBED_ROWS = 1000
# ----------------------------------------------------------------------------

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def hashed_counts(counts: DataFrame, dim: int = HASH_DIM, n_counts: int | None = None) -> DataFrame:
    """Feature-hashed token counts ``(doc_id, bucket, value)`` of term counts.

    A document without tokens has one row with a null bucket. With the number
    of counts, tasks grow in number and not in size.
    """
    tasks = [] if n_counts is None else [max(1, -(-n_counts // TASK_COUNTS))]
    return (
        counts.select("doc_id", hash_bucket("term", dim).alias("bucket"), "tf")
        .repartition(*tasks, "doc_id")  # serves both the bucket sums and the vectors
        .groupBy("doc_id", "bucket")
        .agg(F.sum("tf").alias("value"))
    )


def _bucket_sums(dim: int):
    """Rows (id, term, tf) into rows (id, buckets, values): the sums of an id's rows in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            terms = batch.column(1).dictionary_encode()
            names = terms.dictionary.to_numpy(zero_copy_only=False).tolist()
            for name in names:
                if name not in known:
                    known[name] = int(hashlib.md5(name.encode()).hexdigest()[:7], 16) % dim
            buckets = np.array([known[name] for name in names] or [0], np.int64)
            if len(known) > KNOWN_TERMS:
                known.clear()
            has_term = terms.is_valid().to_numpy(zero_copy_only=False)
            cells = (ids.indices.to_numpy().astype(np.int64) * dim)[has_term] + buckets[terms.indices.drop_null().to_numpy()]
            # documents are many rows, so the matrix is smaller than the batch, unless all are of a word or two
            found, cell = np.unique(cells, return_inverse=True)
            sums = np.bincount(cell, weights=batch.column(2).to_numpy(zero_copy_only=False)[has_term], minlength=len(found))
            offsets = pa.array(np.searchsorted(found, np.arange(len(ids.dictionary) + 1, dtype=np.int64) * dim).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.dictionary, pa.ListArray.from_arrays(offsets, pa.array((found % dim).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(sums.astype(float))),
                ],
                names=["doc_id", "buckets", "values"],
            )

    return run


def _densify(dim: int):
    """Scatter (id, buckets, values) rows into rows of ``dim`` numbers; values of one bucket are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, values = batch.column(1), batch.column(2)
            rows = np.repeat(np.arange(batch.num_rows), buckets.value_lengths().to_numpy())
            cells = rows * dim + buckets.flatten().to_numpy()
            matrix = np.bincount(cells, weights=values.flatten().to_numpy(), minlength=batch.num_rows * dim)
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * dim, dim, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["doc_id", "embedding"])

    return run


def hash_embed(counts: DataFrame, dim: int = HASH_DIM, n_counts: int | None = None) -> DataFrame:
    """Dense hashed embedding ``(doc_id, embedding)`` from term counts, ``n_counts`` of them where that is known.

    A document without any token gets the zero vector. Counts of a document
    that lie together are added up where they lie, so about one row a document
    is shuffled, not one for each of its terms.
    """
    id_type = counts.schema["doc_id"].dataType.simpleString()
    summed = counts.select("doc_id", "term", "tf").mapInArrow(
        _bucket_sums(dim), f"doc_id {id_type}, buckets array<int>, values array<double>"
    )
    tasks = [] if n_counts is None else [max(1, -(-n_counts // TASK_COUNTS))]
    rows = (
        summed.repartition(*tasks, "doc_id")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("buckets", "values")).alias("parts"))  # of a document, at most dim entries in each
        .select("doc_id", F.flatten("parts.buckets").alias("buckets"), F.flatten("parts.values").alias("values"))
    )
    return rows.mapInArrow(_densify(dim), f"doc_id {id_type}, embedding array<double>")


def _embed_terms(dim: int):
    """Rows (id, terms, tfs) into rows of ``dim`` numbers: the sum of each bucket's counts, scaled to length one.

    The counts are whole numbers, so their squares add up to the same length in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, EMBED_ROWS):
                part = batch.slice(start, EMBED_ROWS)
                terms = part.column(1).flatten().dictionary_encode()
                # most terms are in few documents, so that remembering their buckets costs more than it saves
                digests = b"".join([hashlib.md5(name).digest() for name in terms.dictionary.cast(pa.binary()).to_pylist()])
                buckets = (np.frombuffer(digests, ">u4")[::4] >> 4).astype(np.int64) % dim  # 7 hex digits are 28 bits
                rows = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                cells = rows * dim + buckets[terms.indices.to_numpy()]
                matrix = np.bincount(cells, weights=part.column(2).flatten().to_numpy(), minlength=part.num_rows * dim).astype(float).reshape(-1, dim)
                length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                matrix /= np.where(length == 0, 1.0, length)
                offsets = pa.array(np.arange(0, (part.num_rows + 1) * dim, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))], names=["doc_id", "unit_vec"])

    return run


def hash_unit_terms(nested: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """Unit vectors ``(doc_id, unit_vec)`` of :func:`hash_embed` from rows ``(doc_id, terms, tfs)``, one a document, which stay where they are."""
    id_type = nested.schema["doc_id"].dataType.simpleString()
    return nested.select("doc_id", "terms", "tfs").mapInArrow(_embed_terms(dim), f"doc_id {id_type}, unit_vec array<double>")


def _count_buckets(dim: int):
    """Rows (id, buckets) into rows of ``dim`` numbers: how often each bucket stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = batch.column(1)
            rows = np.repeat(np.arange(batch.num_rows), buckets.value_lengths().to_numpy())
            found = np.bincount(rows * dim + buckets.flatten().to_numpy(), minlength=batch.num_rows * dim)
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.astype(float)))], names=["doc_id", "embedding"])

    return run


def embed_buckets(hashed: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """Dense hashed embedding ``(doc_id, embedding)`` of rows ``(doc_id, buckets)``, a bucket for each term met.

    Rows of one id are added up; null buckets count nothing. One row a
    document is grouped, not one for each of its terms.
    """
    rows = written(hashed.select("doc_id", "buckets"), "buckets")
    tasks = max(1, -(-rows.count() // TASK_DOCS))
    together = rows.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.flatten(F.collect_list("buckets")).alias("buckets"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return together.mapInArrow(_count_buckets(dim), f"doc_id {id_type}, embedding array<double>")


def hash_embed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = HASH_DIM) -> DataFrame:
    """:func:`hash_embed` straight from text."""
    return hash_embed(term_counts(docs, id_col, text_col), dim)


def embed_column(
    docs: DataFrame,
    embed: Embedder,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_size: int = EMBED_BATCH,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Embed a text column with a user's model, ``batch_size`` texts per call.

    The callable runs inside the tasks, so the calls go out in parallel. The
    columns ``keep`` stay beside the embedding. A null text is embedded as the
    empty one. When a call fails, each half of its texts is sent again by
    itself, down to the single texts that fail: these have no embedding, and
    their ``error`` says why.
    """
    keep = list(keep)

    def embedded(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = [list(map(float, v)) for v in embed(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} embeddings of {len(texts)} texts")
            return [(v, None) for v in vectors]
        except Exception as failure:  # noqa: BLE001 - any failure is the text's error
            if len(texts) == 1:
                return [(None, str(failure) or type(failure).__name__)]
            half = len(texts) // 2
            return embedded(texts[:half]) + embedded(texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                vectors, errors = zip(*embedded(part["text"].tolist()), strict=True)
                yield part[["doc_id", *keep]].assign(embedding=vectors, error=errors)

    source = docs.select(F.col(id_col).alias("doc_id"), *keep, _whole(text_col).alias("text"))
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ["doc_id", *keep])
    return source.mapInPandas(run, f"{kinds}, embedding array<double>, error string")


def _whole(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def text_hash(text_col: str = "text") -> Column:
    """What a stored embedding knows its text by; a null text is the empty one."""
    return F.sha2(_whole(text_col), 256)


def missing_embeddings(docs: DataFrame, stored: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents whose current text has no stored embedding.

    ``stored`` has ``doc_id`` and ``text_hash``; a changed text has a new hash
    and is embedded again.
    """
    hashed = docs.withColumn("text_hash", text_hash(text_col))
    return hashed.join(stored.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")


def embed_missing(docs: DataFrame, path: str, embed: Embedder, text_col: str = "text") -> DataFrame:
    """Embed what the table at ``path`` lacks, append it, and return current embeddings.

    A text that fails is a row of the table with its ``error``, has no current
    embedding, and is tried again by the next call.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_hash string, embedding array<double>, error string"
    if not table_exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    known = spark.read.schema(schema).parquet(path).where(F.col("embedding").isNotNull())
    todo = written(missing_embeddings(docs, known, text_col).select("doc_id", "text_hash", text_col), "to_embed")
    if not todo.isEmpty():
        embed_column(todo, embed, text_col=text_col, keep=["text_hash"]).write.mode("append").parquet(path)
    current = docs.select("doc_id", text_hash(text_col).alias("text_hash"))
    known = spark.read.schema(schema).parquet(path).where(F.col("embedding").isNotNull())
    return known.join(current, ["doc_id", "text_hash"], "left_semi").select("doc_id", "text_hash", "embedding")
