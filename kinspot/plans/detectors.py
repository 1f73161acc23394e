"""The four detectors, each over a whole table of queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspot.operators.answers import ask_once
from kinspot.operators.containment import sample_verdicts
from kinspot.operators.dense import dense_topk
from kinspot.operators.fusion import DEPTH_FACTOR, hydrate, match_records, rrf_topk
from kinspot.operators.judge import (
    CONTAINMENT_THRESHOLD,
    Judge,
    ask_judge,
    build_prompts,
    judge_containment,
    number_sample,
    pair_containment,
    parse_verdicts,
    sample_rows,
)
from kinspot.operators.parts import BUDGET, QUERY_BUDGET, judge_in_parts
from kinspot.operators.sparse import sparse_topk
from kinspot.plans.indexing import CorpusIndex
from kinspot.session import written

# --- fixed values: defaults ---------------------------------------------------
SIMILARITY_THRESHOLD = 0.8
TOP_K = 5
MAX_CONTEXT = 5000
# ------------------------------------------------------------------------------


def as_queries(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A query table of a few texts given by hand."""
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def _records(hits: DataFrame, corpus: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Hits per query as an array, with the corpus columns asked for."""
    return match_records(hydrate(hits, corpus, *columns) if columns else hits, *columns)


def detect_threshold(
    queries: DataFrame, hits: DataFrame, threshold: float = SIMILARITY_THRESHOLD, k: int = TOP_K,
    corpus: DataFrame | None = None, columns: Sequence[str] = (),
) -> DataFrame:
    """Match when the best similarity reaches the threshold.

    ``hits`` is a dense ranked list of depth ``k`` or more. Queries without a
    hit stay, with a negative verdict. ``matches`` holds the hits, with the
    ``columns`` of ``corpus`` (name, path).
    """
    best = hits.where(F.col("rank") <= k)
    verdicts = best.groupBy("query_id").agg(F.max("score").alias("max_similarity"))
    return (
        queries.select("query_id")
        .join(verdicts, "query_id", "left")
        .join(_records(best, corpus, columns), "query_id", "left")
        .select(
            "query_id",
            F.lit("embedding").alias("method"),
            F.coalesce(F.col("max_similarity") >= threshold, F.lit(False)).alias("is_match"),
            "max_similarity",
            F.lit(float(threshold)).alias("threshold"),
            "matches",
        )
    )


def judge_contexts(
    index: CorpusIndex, queries: DataFrame, hits: DataFrame, method: str, judge: Judge | None = None,
    threshold: float = CONTAINMENT_THRESHOLD, columns: Sequence[str] = (), answers: str | None = None, model: str = "judge",
) -> DataFrame:
    """Verdicts for queries from their ranked contexts ``(query_id, doc_id, rank, score)``.

    Without a judge the built-in containment rule decides; a judge gets the
    assembled prompts. With a path of ``answers`` a prompt that the ``model``
    has answered before is not sent again. ``matches`` holds the contexts with their scores and
    the ``columns`` of the corpus; it is null where contexts have no score.
    """
    if judge is None:
        judged = pair_containment(queries, hits.select("query_id", "doc_id", "rank"), index.sparse.postings)
        verdicts = judge_containment(queries, judged, threshold)
    else:
        contexts = written(hits.select("query_id", "doc_id", "rank"), "hits").join(
            index.corpus.select("doc_id", "text"), "doc_id"
        )
        prompts = written(build_prompts(queries, contexts), "prompts")
        # written, so that no prompt is sent to the judge twice
        asked = ask_judge(prompts, judge) if answers is None else ask_once(prompts, judge, answers, model)
        verdicts = parse_verdicts(written(asked, "answers")).join(prompts.select("query_id", "context_size"), "query_id")
    if "score" in hits.columns:
        found = _records(hits.select("query_id", "doc_id", "rank", "score"), index.corpus, columns)
        verdicts = verdicts.join(found, "query_id", "left")
    return _verdict_rows(verdicts, method)


def detect_sampled_context(
    index: CorpusIndex, queries: DataFrame, n: int = MAX_CONTEXT, seed: int = 42, judge: Judge | None = None, budget: int = BUDGET,
    query_budget: int = QUERY_BUDGET,
) -> DataFrame:
    """Every query against the same sample of ``n`` corpus rows.

    A judge is asked about as many parts of the sample as its ``budget`` of tokens makes necessary.
    """
    sample = written(number_sample(sample_rows(index.corpus.select("doc_id"), n, seed)), "sample")
    size = sample.agg(F.count("*").cast("int")).scalar()
    if judge is None:
        verdicts = sample_verdicts(queries, sample, index.sparse.postings).withColumn("context_size", size)
        return _verdict_rows(verdicts, "sampled_context")
    references = sample.join(index.corpus.select("doc_id", "text"), "doc_id").select("rank", "text")
    verdicts = judge_in_parts(queries, references, judge, budget, query_budget)
    return _verdict_rows(verdicts.withColumn("context_size", size), "sampled_context")


def _verdict_rows(verdicts: DataFrame, method: str) -> DataFrame:
    no_matches = "array<struct<rank:int,doc_id:bigint,score:double>>"
    for name, kind in (("explanation", "string"), ("error", "string"), ("elapsed", "double"), ("matches", no_matches)):
        if name not in verdicts.columns:
            verdicts = verdicts.withColumn(name, F.lit(None).cast(kind))
    return verdicts.select(
        "query_id", F.lit(method).alias("method"), "is_match", "confidence", "explanation", "context_size",
        "matched_references", "matches", "error", "elapsed",
    )


def dense_hits(index: CorpusIndex, queries: DataFrame, k: int) -> DataFrame:
    return written(dense_topk(index.dense, index.embed_queries(queries), k), "dense_hits")


def sparse_hits(index: CorpusIndex, queries: DataFrame, k: int) -> DataFrame:
    return written(sparse_topk(index.sparse, queries, k), "sparse_hits")


def hybrid_hits(index: CorpusIndex, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Rank-fused list of depth ``k`` from dense and sparse lists of depth ``2 k``."""
    depth = DEPTH_FACTOR * k
    return rrf_topk(dense_hits(index, queries, depth), sparse_hits(index, queries, depth), k)


def detect_dense_context(
    index: CorpusIndex, queries: DataFrame, k: int = TOP_K, judge: Judge | None = None, columns: Sequence[str] = ()
) -> DataFrame:
    """Dense retrieval, then the judge."""
    return judge_contexts(index, queries, dense_hits(index, queries, k), "dense_context", judge, columns=columns)


def detect_hybrid_context(
    index: CorpusIndex, queries: DataFrame, k: int = TOP_K, judge: Judge | None = None, columns: Sequence[str] = ()
) -> DataFrame:
    """Hybrid retrieval, then the judge."""
    return judge_contexts(index, queries, hybrid_hits(index, queries, k), "hybrid_context", judge, columns=columns)
