"""Asking a model once: a stored table of answers that later runs look up.

An answer is known by the hash of its prompt and the name of the model. Equal
prompts of a run are asked once; prompts that the table holds are not asked at
all. What is missing is asked in slices, each appended when it is done, so a
job that fails keeps the slices before. A prompt that failed is a row with its
error, and is asked again by the next run.

Two runs may ask the same prompt at the same time and both append. Then one
answer counts for everybody from then on: the one asked first, and of equally
early ones the smaller. Rows are never changed or taken away.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspot.operators.judge import Judge, ask_judge
from kinspot.session import table_exists, written

ANSWERS = "key string, model string, response string, error string, elapsed double, asked_at timestamp, run string"
#: prompts that are asked before their answers are appended
SLICE_PROMPTS = 10_000


def answer_key(text: Column | str) -> Column:
    """What an answer is known by; a null text is the empty one."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def answer_table(spark: SparkSession, path: str) -> DataFrame:
    """All rows at ``path``, failures and second answers included; the table is made if there is none."""
    if not table_exists(spark, path):
        spark.createDataFrame([], ANSWERS).write.mode("ignore").parquet(path)
    return spark.read.schema(ANSWERS).parquet(path)


def settled_answers(rows: DataFrame, model: str) -> DataFrame:
    """One row per key that has an answer: ``key, response, elapsed``."""
    first = F.min(F.struct("asked_at", "response", "elapsed"))
    return rows.where((F.col("model") == model) & F.col("error").isNull()).groupBy("key").agg(first.alias("a")).select("key", "a.response", "a.elapsed")


def ask_once(prompts: DataFrame, judge: Judge, path: str, model: str, batch_size: int = 16, slice_prompts: int = SLICE_PROMPTS) -> DataFrame:
    """Answers to ``(query_id, prompt)``: ``query_id, response, error, elapsed``, from the table at ``path`` where it has them.

    ``elapsed`` is the time the answer took when it was asked.
    """
    spark = prompts.sparkSession
    keyed = written(prompts.select("query_id", F.coalesce("prompt", F.lit("")).alias("prompt"), answer_key("prompt").alias("key")), "keyed_prompts")
    known = settled_answers(answer_table(spark, path), model).select("key")
    # equal prompts are equal rows
    missing = written(keyed.select("key", "prompt").distinct().join(known, "key", "left_anti"), "missing_prompts")
    run = uuid.uuid4().hex
    slices = max(1, -(-missing.count() // slice_prompts))
    for i in range(slices):
        part = missing.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == i)
        asked = ask_judge(part.select(F.col("key").alias("query_id"), "prompt"), judge, batch_size)
        rows = asked.select(
            F.col("query_id").alias("key"), F.lit(model).alias("model"), "response", "error", "elapsed",
            F.current_timestamp().alias("asked_at"), F.lit(run).alias("run"),
        )
        rows.write.mode("append").parquet(path)
    table = answer_table(spark, path)
    failed = table.where((F.col("run") == run) & F.col("error").isNotNull()).groupBy("key").agg(F.min("error").alias("error"))
    answers = settled_answers(table, model).join(failed, "key", "full").select(
        "key", "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"), "elapsed"
    )
    return keyed.select("query_id", "key").join(answers, "key", "left").select("query_id", "response", "error", "elapsed")


def merge_answers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of several answer tables, as one table to settle."""
    return reduce(DataFrame.unionByName, (answer_table(spark, p) for p in paths)).distinct()
