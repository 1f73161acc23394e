"""Building and validating labelled sets."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspot.functions.text import token_jaccard
from kinspot.functions.vectors import HASH_DIM, cosine, hash_bucket
from kinspot.operators.dense import max_corpus_similarity
from kinspot.operators.embedding import embed_buckets
from kinspot.session import written

# --- fixed values: thresholds and attempts ------------------------------------
MIN_STRUCTURE = 0.75
MIN_JACCARD = 0.1
MAX_SIMILARITY = 0.6
REJECTED_SIMILARITY = 1.0
MAX_ATTEMPTS = {1: 3, 0: 5}  # label -> candidates tried per original
# ------------------------------------------------------------------------------


def valid_positive(structure: Column, jaccard: Column) -> Column:
    """A copy: close in structure and sharing some words."""
    return (structure >= MIN_STRUCTURE) & (jaccard >= MIN_JACCARD)


def validate_negative(
    pairs: DataFrame, index: DataFrame, threshold: float = MAX_SIMILARITY
) -> DataFrame:
    """Check that generated items resemble neither their original nor the corpus.

    ``pairs`` has ``case_id`` and the unit vectors ``original_vec`` and
    ``generated_vec``; ``index`` is ``(doc_id, unit_vec)``. Only items that
    pass the first check meet the corpus.
    """
    checked = written(
        pairs.select(
            "case_id",
            F.round(F.aggregate(
                F.zip_with("original_vec", "generated_vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
            ), 6).alias("original_similarity"),
            "generated_vec",
        ),
        "checked_pairs",
    )
    passed = checked.where(F.col("original_similarity") <= threshold)
    nearest = max_corpus_similarity(
        index, passed.select(F.col("case_id").alias("query_id"), F.col("generated_vec").alias("unit_vec"))
    ).select(F.col("query_id").alias("case_id"), "max_similarity")
    largest = F.coalesce("max_similarity", F.lit(REJECTED_SIMILARITY))
    return checked.join(nearest, "case_id", "left").select(
        "case_id",
        "original_similarity",
        largest.alias("max_corpus_similarity"),
        ((F.col("original_similarity") <= threshold) & (largest <= threshold)).alias("is_valid"),
    )


def first_valid(candidates: DataFrame) -> DataFrame:
    """Earliest valid candidate per original and label, within the allowed attempts.

    ``candidates`` has ``src_id, label, attempt, is_valid`` and payload
    columns. An aggregate, not a window: candidates combine before the shuffle.
    """
    payload = [c for c in candidates.columns if c not in ("src_id", "label", "is_valid")]
    allowed = reduce(
        lambda acc, item: acc.when(F.col("label") == item[0], F.lit(item[1])),
        list(MAX_ATTEMPTS.items())[1:],
        F.when(F.col("label") == list(MAX_ATTEMPTS)[0], F.lit(list(MAX_ATTEMPTS.values())[0])),
    )
    # a condition inside the aggregate, not a filter: a filter would be pushed
    # down to the scores and compute them a second time
    usable = F.when(F.col("is_valid") & (F.col("attempt") <= allowed), F.col("attempt"))
    return (
        candidates.groupBy("src_id", "label")
        .agg(F.min_by(F.struct(*payload), usable).alias("_best"))
        .where(F.col("_best").isNotNull())
        .select("src_id", "label", "_best.*")
    )


def candidate_stats(originals: DataFrame, accepted: DataFrame) -> DataFrame:
    """Originals with and without an accepted candidate, per label."""
    every = originals.select("src_id").withColumn("label", F.explode(F.array(*[F.lit(v) for v in MAX_ATTEMPTS])))
    found = accepted.select("src_id", "label", F.lit(1).alias("ok"))
    return (
        every.join(found, ["src_id", "label"], "left")
        .groupBy("label")
        .agg(F.count_if(F.col("ok").isNotNull()).alias("n_success"), F.count_if(F.col("ok").isNull()).alias("n_fail"))
    )


def ragged_union(*parts: DataFrame) -> DataFrame:
    """Union by name; columns a part lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def node_types(source: str) -> list[str] | None:
    """Syntax node types of one source text in pre-order; None if it does not parse."""
    try:
        stack = [ast.parse(source)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    while stack:
        node = stack.pop()
        out.append(type(node).__name__)
        stack.extend(reversed(list(ast.iter_child_nodes(node))))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Structural fingerprint ``(doc_id, node_types)`` of program texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "node_types": frame["text"].map(node_types)})

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(run, f"doc_id {id_type}, node_types array<string>")


def structure_vectors(prints: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """Hashed counts of node-type trigrams ``(doc_id, embedding)``."""
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("node_types") - 3, F.lit(0))),
        lambda i: F.array_join(F.slice("node_types", i + 1, F.lit(3)), " "),
    )
    buckets = F.when(F.col("node_types").isNotNull(), F.transform(grams, lambda gram: hash_bucket(gram, dim)))
    return embed_buckets(prints.select("doc_id", buckets.alias("buckets")), dim)


def structure_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the structure vectors of ``(left_id, right_id)`` pairs."""
    left = vectors.select(F.col("doc_id").alias("left_id"), F.col("embedding").alias("_a"))
    right = vectors.select(F.col("doc_id").alias("right_id"), F.col("embedding").alias("_b"))
    return (
        pairs.join(left, "left_id")
        .join(right, "right_id")
        .select(*pairs.columns, F.round(cosine(F.col("_a"), F.col("_b")), 6).alias("structure_similarity"))
    )


def validate_positive(pairs: DataFrame) -> DataFrame:
    """Scores and verdict for pairs with texts and vectors of both sides.

    ``pairs`` has ``original, generated`` texts and ``original_vec,
    generated_vec``; its other columns pass through.
    """
    structure = F.round(cosine(F.col("original_vec"), F.col("generated_vec")), 6)
    shared = F.round(token_jaccard("original", "generated"), 6)
    scored = pairs.withColumn("structure_similarity", structure).withColumn("token_jaccard", shared)
    return scored.withColumn(
        "is_valid", valid_positive(F.col("structure_similarity"), F.col("token_jaccard"))
    ).drop("original", "generated", "original_vec", "generated_vec")
