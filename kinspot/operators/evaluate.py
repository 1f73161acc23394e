"""Scoring detectors: predictions, confusion counts, metrics, errors, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
METRICS = ("accuracy", "precision", "recall", "f1")
DEFAULT_CONFIDENCE = 0.5
K_VALUES = (3, 5, 10)
THRESHOLDS = (0.7, 0.8, 0.9)
RRF_K_VALUES = (30, 60, 90)
EXAMPLES_PER_ERROR = 3
# ----------------------------------------------------------------------------


def predict(cases: DataFrame, verdicts: DataFrame, method: str) -> DataFrame:
    """Predictions of one detector for every labelled case ``(case_id, y_true)``.

    A case without verdict, or whose verdict carries an error, counts as
    predicted 0 with confidence 0 and no time, and keeps its error. Confidence
    falls back to the largest similarity, then to one half.
    """
    present = set(verdicts.columns)

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)

    answers = verdicts.select(
        F.col("query_id").alias("case_id"),
        "is_match",
        optional("confidence", "double"),
        optional("max_similarity", "double"),
        optional("elapsed", "double"),
        optional("error", "string"),
        F.lit(True).alias("_answered"),
    )
    joined = cases.select("case_id", "y_true").join(answers, "case_id", "left")
    error = F.when(F.col("_answered").isNull(), F.lit("no verdict")).otherwise(F.col("error"))
    failed = error.isNotNull()
    confidence = F.coalesce("confidence", "max_similarity", F.lit(DEFAULT_CONFIDENCE))
    return joined.select(
        F.lit(method).alias("method"),
        "case_id",
        F.col("y_true").cast("int").alias("y_true"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce(F.col("is_match").cast("int"), F.lit(0))).alias("y_pred"),
        F.when(failed, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.when(~failed, F.col("elapsed")).alias("elapsed"),
        error.alias("error"),
    )


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """TP, TN, FP and FN per group, in one map-side combined aggregate."""
    true, pred = F.col("y_true"), F.col("y_pred")
    return predictions.groupBy(*by).agg(
        F.count_if((true == 1) & (pred == 1)).alias("tp"),
        F.count_if((true == 0) & (pred == 0)).alias("tn"),
        F.count_if((true == 0) & (pred == 1)).alias("fp"),
        F.count_if((true == 1) & (pred == 0)).alias("fn"),
    )


def metrics_of(counts: DataFrame, *by: str, digits: int | None = 6) -> DataFrame:
    """Accuracy, precision, recall and F1 of confusion counts; 0 for a zero divisor."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))

    def ratio(top: Column, bottom: Column) -> Column:
        value = F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
        return value if digits is None else F.round(value, digits)

    return counts.select(
        *by,
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def metrics(predictions: DataFrame, *by: str) -> DataFrame:
    return metrics_of(confusion(predictions, *by), *by)


def timing(predictions: DataFrame, *by: str) -> DataFrame:
    """Mean and total time of the cases that succeeded, and the number that failed."""
    return predictions.groupBy(*by).agg(
        F.round(F.avg(F.when(F.col("error").isNull(), F.col("elapsed"))), 6).alias("avg_time"),
        F.round(F.sum(F.when(F.col("error").isNull(), F.col("elapsed"))), 6).alias("total_time"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )


def error_type() -> Column:
    return F.when((F.col("y_true") == 0) & (F.col("y_pred") == 1), F.lit("FP")).when(
        (F.col("y_true") == 1) & (F.col("y_pred") == 0), F.lit("FN")
    )


def error_cases(predictions: DataFrame, kind: str | None = None) -> DataFrame:
    """Wrongly predicted cases, of one kind (``FP`` or ``FN``) or of both."""
    wrong = predictions.withColumn("error_type", error_type()).where(F.col("error_type").isNotNull())
    return wrong if kind is None else wrong.where(F.col("error_type") == kind)


def error_report(predictions: DataFrame, examples: int = EXAMPLES_PER_ERROR) -> DataFrame:
    """Number of errors per method and kind, with the first few cases of each."""
    wrong = error_cases(predictions)
    first = Window.partitionBy("method", "error_type").orderBy("case_id")
    shown = (
        wrong.withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= examples)  # cut per partition before the shuffle
        .groupBy("method", "error_type")
        .agg(F.array_sort(F.collect_list("case_id")).alias("examples"))
    )
    counts = wrong.groupBy("method", "error_type").agg(F.count("*").alias("n_cases"))
    return counts.join(shown, ["method", "error_type"])


def long_metrics(scores: DataFrame, *by: str) -> DataFrame:
    """One row per group and metric."""
    return scores.unpivot(list(by), list(METRICS), "metric", "value")


def metrics_by_method(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Transposed table: one row per metric, one column per method."""
    return long_metrics(scores, "method").groupBy("metric").pivot("method", list(methods)).agg(F.first("value"))


def rank_methods(scores: DataFrame) -> DataFrame:
    """Rank of every method on every metric, best first."""
    best = Window.partitionBy("metric").orderBy(F.desc("value"))
    return long_metrics(scores, "method").withColumn("position", F.rank().over(best))


def sweep_threshold(best: DataFrame, cases: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Metrics per threshold from the best score per case ``(query_id, max_similarity)``."""
    scored = cases.join(best.withColumnRenamed("query_id", "case_id"), "case_id", "left")
    swept = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.coalesce(F.col("max_similarity") >= F.col("threshold"), F.lit(False))
    return metrics(swept.withColumn("y_pred", hit.cast("int")), "threshold")


def sweep_k(judged: DataFrame, cases: DataFrame, threshold: float, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """Metrics per list depth from one retrieval at the largest depth.

    ``judged`` is ``(query_id, rank, containment)``.
    """
    swept = judged.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    return metrics(_predict_swept(swept, cases, "k", ks, threshold), "k")


def sweep_fused(judged: DataFrame, cases: DataFrame, threshold: float, rrf_ks: Sequence[int]) -> DataFrame:
    """Metrics per fusion constant from ``(rrf_k, query_id, containment)``."""
    return metrics(_predict_swept(judged, cases, "rrf_k", rrf_ks, threshold), "rrf_k")


def _predict_swept(judged: DataFrame, cases: DataFrame, param: str, values: Sequence[int], threshold: float) -> DataFrame:
    best = judged.groupBy(param, F.col("query_id").alias("case_id")).agg(F.max("containment").alias("confidence"))
    every = cases.withColumn(param, F.explode(F.array(*[F.lit(v) for v in values])))
    hit = F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    return every.join(best, ["case_id", param], "left").withColumn("y_pred", hit.cast("int"))
