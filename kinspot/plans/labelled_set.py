"""Building a labelled set from originals and a table of candidate texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspot.operators import labelset as ls
from kinspot.operators.rounds import Generator, candidate_rounds
from kinspot.plans.indexing import CorpusIndex
from kinspot.session import written


def build_labelled_set(
    originals: DataFrame, candidates: DataFrame, index: CorpusIndex, threshold: float = ls.MAX_SIMILARITY
) -> DataFrame:
    """First valid candidate per original and label, with the scores behind it; candidates as in :func:`score_candidates`."""
    return ls.first_valid(score_candidates(originals, candidates, index, threshold))


def generate_labelled_set(
    originals: DataFrame, generator: Generator, index: CorpusIndex, threshold: float = ls.MAX_SIMILARITY, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The labelled set and every attempt behind it; the generator is asked only where nothing valid was found before."""
    attempts = candidate_rounds(originals, generator, lambda made: score_candidates(originals, made, index, threshold), path=path)
    return ls.first_valid(attempts.drop("error")), attempts


def score_candidates(
    originals: DataFrame, candidates: DataFrame, index: CorpusIndex, threshold: float = ls.MAX_SIMILARITY
) -> DataFrame:
    """Candidates with their scores and whether they are valid.

    ``originals`` is ``(src_id, code)``, ``candidates`` is ``(src_id, label,
    attempt, code)``. Copies (label 1) are checked by syntax structure and
    shared words, unrelated texts (label 0) by similarity to their original and
    then to the whole corpus of ``index``. The scores of the other label are
    null.
    """
    cases = written(
        candidates.join(originals.select("src_id", F.col("code").alias("original_ref")), "src_id").withColumn(
            "case_id", F.md5(F.to_json(F.struct("src_id", "label", "attempt")))
        ),
        "cases",
    )
    copies, others = cases.where("label = 1"), cases.where("label = 0")

    def structure(df: DataFrame, key: str, name: str) -> DataFrame:
        vectors = ls.structure_vectors(ls.fingerprints(df, key, "code"))
        return vectors.select(F.col("doc_id").alias(key), F.col("embedding").alias(name))

    positive = ls.validate_positive(
        copies.select("case_id", "src_id", F.col("original_ref").alias("original"), F.col("code").alias("generated"))
        .join(structure(originals, "src_id", "original_vec"), "src_id")
        .join(structure(copies, "case_id", "generated_vec"), "case_id")
    ).select("case_id", "is_valid", F.col("structure_similarity").alias("ast_similarity"), "token_jaccard")

    def meaning(df: DataFrame, key: str, name: str) -> DataFrame:
        vectors = index.embed_queries(df.select(F.col(key).alias("query_id"), F.col("code").alias("text")))
        return vectors.select(F.col("query_id").alias(key), F.col("unit_vec").alias(name))

    negative = ls.validate_negative(
        others.select("case_id", "src_id")
        .join(meaning(originals, "src_id", "original_vec"), "src_id")
        .join(meaning(others, "case_id", "generated_vec"), "case_id"),
        index.dense,
        threshold,
    )
    return cases.join(ls.ragged_union(positive, negative), "case_id").drop("case_id")
