"""Best rows per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, score: str = "score", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Keep the ``k`` best rows per query with a 1-based ``rank``.

    Ties go to the smaller ``doc_id``. The plain ``rank <= k`` filter lets
    Spark cut every partition to k rows per query before the shuffle, so no
    task sees more than k rows per query and upstream partition.
    """
    best_first = Window.partitionBy(*by).orderBy(F.desc(score), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
