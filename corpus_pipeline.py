"""A training corpus from raw documents, one table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinspot.llm import decontaminate, neardup, packing, secret_scan, toxicity
from kinspot.llm.stage import stored

#: SQL cannot train a classifier, scan for novelty or pack; tests compare each stage with a brute-force version
ORACLE_SQL = None


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until ``docs`` has no such column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7; it learns from the stage's own documents.

    Rows without text are empty texts, rows without id are scored like others.
    """
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = unused(docs, "own_score")  # a column of the documents that is called like the score
    scored = toxicity.score_toxicity(docs.withColumnRenamed("toxicity_score", own), model)
    return scored.filter(F.col("toxicity_score") < toxicity.CUT).drop("toxicity_score").withColumnRenamed(own, "toxicity_score").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one of the smallest id.

    Rows without id are kept. Rows that share an id are judged each by its own
    text; of rows of equal id and text one stays.
    """
    judged = stored(neardup.near_duplicates(docs, k=5, percent=80).select(F.col("doc_id").alias("judged_id"), "text_key", "kept"), "judged-duplicates")
    gone = judged.filter("NOT kept AND judged_id IS NOT NULL").select("judged_id", "text_key").distinct()
    repeated = judged.filter("judged_id IS NOT NULL").groupBy("judged_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").select("judged_id", "text_key")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))

    def same(pairs: DataFrame):
        return (docs["doc_id"].cast("long") == pairs["judged_id"]) & (key == pairs["text_key"])

    kept = docs.join(gone, same(gone), "left_anti")
    place = unused(docs, "place")
    # equal rows are looked for only where an id and a text come twice
    alike = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns)))
    first = kept.join(repeated, same(repeated), "left_semi").withColumn(place, alike).filter(F.col(place) == 1).select(*docs.columns)
    return kept.join(repeated, same(repeated), "left_anti").select(*docs.columns).unionByName(first)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows of 13 words.

    Rows are judged by their own texts, also where they share an id or have none; rows without words stay.
    """
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = judged.filter("contaminated").select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__key"])
    return docs.join(bad, same, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in the place of each secret."""
    return secret_scan.mask_secrets(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids: one row per piece with its ids.

    A null text is its end id alone; rows that share an id are documents each.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each reads what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
