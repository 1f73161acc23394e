"""Evaluating the four detectors over one labelled set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspot.operators import evaluate as ev
from kinspot.operators.judge import Judge
from kinspot.plans import detectors as dt
from kinspot.plans.indexing import CorpusIndex
from kinspot.session import written

# --- fixed values -----------------------------------------------------------
SAMPLED_CONTEXT = 100
# ----------------------------------------------------------------------------


def evaluate_detector(
    detect: Callable[..., DataFrame], labelled: DataFrame, method: str, **options: object
) -> DataFrame:
    """Predictions of any detector over a labelled set ``(case_id, code, label)``.

    ``detect`` takes a query table ``(query_id, text)`` and the options, and
    returns verdicts by ``query_id``.
    """
    queries = labelled.select(F.col("case_id").alias("query_id"), F.col("code").alias("text"))
    cases = labelled.select("case_id", F.col("label").alias("y_true"))
    return ev.predict(cases, detect(queries, **options), method)


def full_evaluation(
    index: CorpusIndex,
    queries: DataFrame,
    cases: DataFrame,
    judge: Judge | None = None,
    dense: DataFrame | None = None,
    hybrid: DataFrame | None = None,
) -> DataFrame:
    """Predictions of all four detectors for every case, in one long table.

    The dense list is retrieved once and serves both detectors that use it;
    lists already at hand may be passed in.
    """
    k = dt.TOP_K
    if dense is None:
        dense = dt.dense_hits(index, queries, dt.DEPTH_FACTOR * k)
    if hybrid is None:
        sparse = dt.sparse_hits(index, queries, dt.DEPTH_FACTOR * k)
        hybrid = written(dt.rrf_topk(dense, sparse, k), "hybrid_hits")
    verdicts = {
        "embedding": dt.detect_threshold(queries, dense),
        "sampled_context": dt.detect_sampled_context(index, queries, SAMPLED_CONTEXT, judge=judge),
        "dense_context": dt.judge_contexts(index, queries, dense.where(F.col("rank") <= k), "dense_context", judge),
        "hybrid_context": dt.judge_contexts(index, queries, hybrid, "hybrid_context", judge),
    }
    return _union([ev.predict(cases, v, m) for m, v in verdicts.items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(predictions: DataFrame) -> DataFrame:
    """Confusion counts, metrics and times per method."""
    counts = ev.confusion(predictions, "method")
    times = ev.timing(predictions, "method")
    return counts.join(ev.metrics_of(counts, "method"), "method").join(times, "method")


def tradeoff(predictions: DataFrame) -> DataFrame:
    """F1 and mean time per method."""
    f1 = ev.metrics(predictions, "method").select("method", "f1")
    return f1.join(ev.timing(predictions, "method").select("method", "avg_time"), "method")
