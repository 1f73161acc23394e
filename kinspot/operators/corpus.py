"""Corpus rows by token count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspot.functions.text import MAX_TOKENS, MIN_TOKENS, in_token_band, tokenize


def token_band(docs: DataFrame, text_col: str = "text", low: int = MIN_TOKENS, high: int = MAX_TOKENS) -> DataFrame:
    """Rows whose token count lies in the band, with the count as ``token_count``.

    The count passes through a generator, because a plain filter on it would be
    pushed below the projection and tokenise every text twice.
    """
    counted = docs.withColumn("token_count", F.explode_outer(F.array(F.size(tokenize(text_col)))))
    return counted.where(in_token_band(F.col("token_count"), low, high))
