"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Rows kept for evaluation: the crc32 of the id as text leaves 1 divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id``, ``label`` of the rows to learn from; of repeated rows the larger label counts, nulls do not."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label")).dropna()
    return known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
