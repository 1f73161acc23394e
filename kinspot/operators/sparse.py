"""BM25: the inverted index as tables, and exact top-k over them.

Top-k avoids meeting every document that shares a frequent term with a query.
For each query the terms are ordered by document frequency, and each has an
upper bound on what it can add to any score. A first look at the rarest terms
gives k documents whose full scores set a threshold. The most frequent terms
whose bounds together stay below that threshold cannot lift a document into
the top k by themselves, so only documents holding one of the other terms are
candidates; the frequent terms are looked up for the candidates that can still
reach the threshold. The result is the exact top k; a query whose threshold is
too low to skip anything is scored against all its postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspot.functions.text import token_batches, tokenised, tokenize
from kinspot.functions.vectors import SCORE_DIGITS
from kinspot.operators.topk import top_k
from kinspot.session import new_path, written

# --- fixed values: BM25 parameters -------------------------------------------
K1 = 1.5
B = 0.75
EPSILON = 0.25
# -----------------------------------------------------------------------------

# Postings read per query to find its threshold, the documents scored in full
# for it (times k), and the slack that covers rounding in comparisons with it.
PROBE_ROWS = 20_000
PROBE_FACTOR = 4
SLACK = 1e-5
# Terms are skipped while their bounds stay below this share of the threshold.
# Less than 1 reads more postings, but leaves far fewer candidates to look up.
SKIP_SHARE = 0.8
# Tokens that a task counts at a time, about: what is worked out for them takes many times their own memory.
COUNTED_TOKENS = 1 << 18


@dataclass(frozen=True)
class SparseIndex:
    """Inverted index as tables."""

    counts: DataFrame  # doc_id, dl, term, tf, as from term_counts
    postings: DataFrame  # term, doc_id, tf, dl, saturation
    doc_stats: DataFrame  # doc_id, dl, n_terms
    term_stats: DataFrame  # term, df, idf, max_saturation
    corpus_stats: DataFrame  # n, avgdl, avg_idf, n_terms (one row)


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Term frequencies and length per document: ``doc_id, dl, term, tf``.

    A document without tokens (or without text) keeps one row with a null term
    and ``tf`` 0, so that later steps need no join to find it.

    A document is one row, so its terms are counted where the row is: neither
    texts nor tokens are shuffled.
    """
    texts = tokenised(docs, text_col, id_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lambda batches: _count(token_batches(batches)), f"doc_id {id_type}, dl int, term string, tf bigint")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``COUNTED_TOKENS`` tokens; a document stays whole."""
    for batch in batches:
        ends = np.cumsum(np.nan_to_num(batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + COUNTED_TOKENS, "right")))
            yield batch.slice(start, end - start)
            start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (document, length, term, frequency) of rows (document, tokens)."""
    for batch in _pieces(batches):
        lengths = batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False)
        coded = batch.column("tokens").flatten().dictionary_encode()
        n_terms = max(1, len(coded.dictionary))
        owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), lengths)
        pairs, tf = np.unique(owner * n_terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        empty = np.flatnonzero(lengths == 0)
        rows = np.concatenate((pairs // n_terms, empty))
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(pairs % n_terms)), pa.nulls(len(empty), pa.string())])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(rows)), pa.array(lengths[rows], pa.int32()), terms,
                pa.array(np.concatenate((tf, np.zeros(len(empty), np.int64)))),
            ],
            names=["doc_id", "dl", "term", "tf"],
        )


def build_sparse_index(corpus: DataFrame, path: str | None = None, text_col: str = "text") -> SparseIndex:
    """Write the index tables of a corpus ``(doc_id, text)``."""
    spark = corpus.sparkSession
    root = path or new_path(spark, "sparse")
    counts = written(term_counts(corpus, text_col=text_col), "counts", f"{root}/counts")
    n = corpus.agg(F.count("*")).scalar()
    totals = written(
        counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).select(
            n.alias("n"), F.try_divide("tokens", n).alias("avgdl")
        ),
        "totals",
        f"{root}/totals",
    )
    n, avgdl = totals.select("n").scalar(), totals.select("avgdl").scalar()
    written(
        counts.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.max(_saturation(avgdl)).alias("max_saturation"))
        .withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)),
        "terms",
        f"{root}/terms",
    )
    counts = spark.read.parquet(f"{root}/counts")
    written(counts.where(F.col("term").isNotNull()).groupBy("doc_id", "dl").agg(F.count("term").alias("n_terms")).unionByName(
        counts.where(F.col("term").isNull()).select("doc_id", "dl", F.lit(0).cast("bigint").alias("n_terms"))
    ), "doc_stats", f"{root}/doc_stats")
    terms = spark.read.parquet(f"{root}/terms")
    written(terms.agg(F.avg("raw_idf").alias("avg_idf"), F.count("*").alias("n_terms")), "term_totals", f"{root}/term_totals")
    return load_sparse_index(spark, root)


def _saturation(avgdl: Column) -> Column:
    tf = F.col("tf")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))


def load_sparse_index(spark: SparkSession, root: str) -> SparseIndex:
    counts = spark.read.parquet(f"{root}/counts")
    terms = spark.read.parquet(f"{root}/terms")
    totals = spark.read.parquet(f"{root}/totals")
    avgdl = totals.select("avgdl").scalar()
    term_totals = spark.read.parquet(f"{root}/term_totals")
    avg_idf = term_totals.select("avg_idf").scalar()
    floored = F.when(F.col("raw_idf") < 0, EPSILON * avg_idf).otherwise(F.col("raw_idf"))
    return SparseIndex(
        counts=counts,
        postings=counts.where(F.col("term").isNotNull()).withColumn("saturation", _saturation(avgdl)),
        doc_stats=spark.read.parquet(f"{root}/doc_stats"),
        term_stats=terms.select("term", "df", floored.alias("idf"), "max_saturation"),
        corpus_stats=totals.select(
            "n", "avgdl", avg_idf.alias("avg_idf"), term_totals.select("n_terms").scalar().alias("n_terms")
        ),
    )


def weighted_query_terms(index: SparseIndex, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Terms of each query known to the corpus, weighted by repetition and idf."""
    return (
        queries.select("query_id", F.explode(tokenize(text_col)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
        .join(index.term_stats, "term")
        .withColumn("weight", F.col("qtf") * F.col("idf"))
    )


def _added(terms: DataFrame, postings: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """What each matching posting adds, summed per query and document."""
    return (
        terms.join(postings.select("term", "doc_id", "saturation"), on)
        .groupBy("query_id", "doc_id", *keep)
        .agg(F.sum(F.col("weight") * F.col("saturation")).alias("part"))
    )


def bm25_score_pairs(index: SparseIndex, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """BM25 score of given ``(query_id, doc_id)`` pairs; 0 where no term is shared."""
    terms = weighted_query_terms(index, queries).select("query_id", "term", "weight")
    wanted = written(pairs.select("query_id", "doc_id").distinct(), "pairs")
    needed = written(wanted.join(terms, "query_id"), "pair_terms")
    parts = _added(needed, index.postings, ["term", "doc_id"], [])
    return wanted.join(parts, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.round(F.coalesce("part", F.lit(0.0)), SCORE_DIGITS).alias("score")
    )


def sparse_topk(
    index: SparseIndex,
    queries: DataFrame,
    k: int = 10,
    probe_rows: int = PROBE_ROWS,
) -> DataFrame:
    """Exact BM25 top-k per query: ``query_id, doc_id, score, rank``, by the thresholds described above."""
    terms = written(weighted_query_terms(index, queries), "query_terms")
    return top_k(_scores_above_threshold(index, terms, k, probe_rows), k)


def _scores_above_threshold(index: SparseIndex, query_terms: DataFrame, k: int, probe_rows: int) -> DataFrame:
    """Scores of all documents that can be among a query's top k."""
    rare_first = Window.partitionBy("query_id").orderBy("df", "term")
    before = rare_first.rowsBetween(Window.unboundedPreceding, -1)
    common_first = Window.partitionBy("query_id").orderBy(F.desc("df"), F.desc("term"))
    upto = common_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.greatest(F.col("weight") * F.col("max_saturation"), F.lit(0.0))
    terms = written(
        query_terms.withColumn("probe", F.coalesce(F.sum("df").over(before), F.lit(0)) < probe_rows)
        .withColumn("reach", F.sum(bound).over(upto))
        .select("query_id", "term", "weight", "probe", "reach"),
        "bounded_terms",
    )

    # threshold: the k-th best full score among the best documents by rare terms
    by_rare = _added(terms.where("probe"), index.postings, ["term"], [])
    probed = top_k(by_rare, PROBE_FACTOR * k, "part")
    probed_terms = written(
        probed.select("query_id", "doc_id").join(terms.select("query_id", "term", "weight"), "query_id"),
        "probe_terms",
    )
    thresholds = (
        top_k(_added(probed_terms, index.postings, ["term", "doc_id"], []), k, "part")
        .groupBy("query_id")
        .agg(F.count("*").alias("found"), F.min("part").alias("least"))
        .where(F.col("found") >= k)
        .select("query_id", (F.col("least") - SLACK).alias("threshold"))
    )
    below = F.col("reach") < SKIP_SHARE * F.col("threshold")
    planned = written(
        terms.join(thresholds, "query_id", "left").select(
            "query_id",
            "term",
            "weight",
            "threshold",
            F.coalesce(below, F.lit(False)).alias("skipped"),
            # the most that the skipped terms of the query can add together
            F.coalesce(
                F.max(F.when(below, F.col("reach"))).over(Window.partitionBy("query_id")), F.lit(0.0)
            ).alias("rest"),
        ),
        "planned_terms",
    )

    # candidates by the other terms, then the skipped terms for those in reach
    in_reach = F.col("threshold").isNull() | (F.col("part") + F.col("rest") >= F.col("threshold"))
    candidates = written(
        _added(planned.where(~F.col("skipped")), index.postings, ["term"], ["threshold", "rest"])
        .where(in_reach)
        .select("query_id", "doc_id", "part"),
        "candidates",
    )
    skipped = planned.where("skipped").select("query_id", "term", "weight")
    lookups = written(candidates.select("query_id", "doc_id").join(skipped, "query_id"), "lookups")
    return (
        candidates.unionByName(_added(lookups, index.postings, ["term", "doc_id"], []))
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    )
