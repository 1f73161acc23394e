"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinspot.llm import (
    chat, clustering, decontaminate, fill_in_middle, mixing, neardup, packing, permutation_index, quality, secret_scan, token_store, toxicity, url_filter,
)

#: fixed by the contract: verdict, host, begin of the path
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: fixed by the contract: a conversation that says what the template uses for marks
ODD_CONVERSATION, ODD_TEXT = -7, "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary; the package that holds them is needed by two queries only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85).drop("text_key")


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_index(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.withColumnRenamed("id", "doc_id").drop("key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.neighbours(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))
    odd = spark.range(1).select(F.lit(ODD_CONVERSATION).cast("long").alias("conv_id"), F.inline(turns), F.lit(ODD_TEXT).alias("text"))
    return chat.conversation_report(own.unionByName(odd))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_report(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1, scale=64, width=64)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"), mixing.WEIGHTS, share=1.5, epochs=2, seed=7)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transformation_report(_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_index": op2_token_index,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_contamination": op5_contamination,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_neighbours": op8_neighbours,
    "op9_packing": op9_packing,
    "op10_chat": op10_chat,
    "op11_clusters": op11_clusters,
    "op12_mixing": op12_mixing,
    "op13_fill_in_middle": op13_fill_in_middle,
}
