"""Judging a context that is too large for one prompt: part by part, and merged.

References are dealt to parts by the running sum of their tokens, so that a
prompt never holds more than a budget; a part is assembled once, as a row of a
table. Every query is asked about every part: blocks of queries meet parts on
a grid, as blocks of vectors do in :mod:`kinspot.operators.dense`, and the
prompts are put together inside the task, right before they go to the judge.
What is written grows with the queries, the references and the answers, never
with queries times texts. The answers of a query are merged by an aggregate.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspot.functions.text import TOKEN_PATTERN, WHITESPACE, tokenize
from kinspot.operators.judge import (
    PROMPT_HEAD, PROMPT_TAIL, REFERENCE_SEPARATOR, Judge, answer_each, parse_verdicts, prompt_text, reference_text,
)
from kinspot.operators.ordered import DEFAULT_SPAN, running_sum
from kinspot.session import written

#: tokens of a prompt, and those of a query in it, at most
BUDGET, QUERY_BUDGET = 100_000, 20_000
#: queries of a block, about, and how often a part or a block is copied at most
BLOCK_QUERIES, COPIES = 64, 32
#: a token with the blanks around it, so that tokens joined are the text again
TOKEN_AND_BLANKS = rf"(?:\A[{WHITESPACE}]+)?(?:{TOKEN_PATTERN})[{WHITESPACE}]*"
#: tokens of ASCII text
TOKEN_ASCII = r"\w+|[^\w\s]"
#: tokens of a reference besides its text: its head, two fences and a separator
AROUND = 24


def _tokens(text: Column | str) -> Column:
    return F.size(tokenize(text))


def deal_parts(references: DataFrame, room: int, span: int = DEFAULT_SPAN) -> DataFrame:
    """Parts of ``references`` (rank, text): ``part, ranks, references``, of at most ``room`` tokens each.

    A reference of more than half the room is cut into pieces, which count as
    references of the same rank. So a part begins wherever the running sum
    passes a multiple of half the room. Null texts are empty.
    """
    half = room // 2
    most = half - AROUND
    if most < 1:
        raise ValueError(f"no room for a reference in {room} tokens")
    text = references.select("rank", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", _tokens("text"))
    units = F.regexp_extract_all("text", F.lit(TOKEN_AND_BLANKS), F.lit(0))
    starts = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int"))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("text").alias("text")))
    cut = F.transform(starts, lambda i: F.struct(i.alias("piece"), F.array_join(F.slice(units, i * most + 1, F.lit(most)), "").alias("text")))
    pieces = text.select("rank", F.inline(F.when(F.col("n") <= most, whole).otherwise(cut)))
    place = pieces.select("rank", "piece", "text").withColumn("n", _tokens("text") + AROUND)
    summed = running_sum(place, [], "rank", {"upto": F.col("n").cast("bigint")}, span, then=["piece"])
    dealt = summed.withColumn("part", F.floor((F.col("upto") - F.col("n")) / half))
    rows = dealt.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("rank", "piece", "text"))).alias("refs"))  # of one prompt
    listed = F.transform("refs", lambda r, i: reference_text(i + 1, r["text"]))
    return rows.select("part", F.col("refs.rank").alias("ranks"), F.array_join(listed, REFERENCE_SEPARATOR).alias("references"))


def ask_parts(queries: DataFrame, parts: DataFrame, judge: Judge, batch_size: int = 16) -> DataFrame:
    """``query_id, part, ranks, response, error, elapsed`` of every query ``(query_id, text)`` about every part."""
    n_blocks, n_parts = max(1, math.ceil(queries.count() / BLOCK_QUERIES)), max(1, parts.count())
    groups, lanes = min(n_blocks, COPIES), min(n_parts, COPIES)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    query = F.struct("query_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = queries.groupBy(block.alias("block")).agg(F.collect_list(query).alias("queries"))  # about BLOCK_QUERIES
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = blocks.withColumn("group", (F.col("block") % groups).cast("int")).withColumn("lane", numbers(lanes))
    held = parts.withColumn("lane", (F.col("part") % lanes).cast("int")).withColumn("group", numbers(groups))
    met = held.join(asked, ["lane", "group"]).select("part", "ranks", "references", "queries")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                for start in range(0, len(row.queries), batch_size):
                    some = row.queries[start : start + batch_size]
                    prompts = [prompt_text(q["text"], row.references) for q in some]
                    begun = time.perf_counter()
                    answers = answer_each(judge, prompts)
                    out = pd.DataFrame(answers, columns=["response", "error"], dtype=object)
                    out = out.assign(query_id=[q["query_id"] for q in some], part=row.part, ranks=[row.ranks] * len(some))
                    yield out.assign(elapsed=(time.perf_counter() - begun) / len(some))[["query_id", "part", "ranks", "response", "error", "elapsed"]]

    id_type = queries.schema["query_id"].dataType.simpleString()
    rank_type = parts.schema["ranks"].dataType.simpleString()
    return met.mapInPandas(run, f"query_id {id_type}, part bigint, ranks {rank_type}, response string, error string, elapsed double")


def merge_parts(answers: DataFrame) -> DataFrame:
    """One verdict for each query from its answers about the parts.

    A query matches if it matches in any part; its confidence is the largest
    one and the explanation goes with it, a match before all others. Numbers of
    references become ranks; a number that the part does not have is left out.
    A failed part matters only if no other part matches. Times are added up.
    """
    parsed = parse_verdicts(answers)
    ranks = F.transform("matched_references", lambda i: F.when(i >= 1, F.get("ranks", i - 1)))
    best = F.struct(F.coalesce(F.col("is_match"), F.lit(False)), F.coalesce("confidence", F.lit(-1.0)), -F.col("part"))
    verdicts = parsed.withColumn("ranks", F.filter(ranks, lambda r: r.isNotNull())).groupBy("query_id").agg(
        F.coalesce(F.bool_or("is_match"), F.lit(False)).alias("is_match"),
        F.max("confidence").alias("confidence"),
        F.max_by("explanation", best).alias("explanation"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranks")))).alias("matched_references"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("part"))).alias("error"),
        F.sum("elapsed").alias("elapsed"),
    )
    failed = F.col("error").isNotNull() & ~F.col("is_match")
    return verdicts.select(
        "query_id", F.when(~failed, F.col("is_match")).alias("is_match"), F.when(~failed, F.col("confidence")).alias("confidence"),
        F.when(~failed, F.col("explanation")).alias("explanation"), "matched_references", F.when(failed, F.col("error")).alias("error"), "elapsed",
    )


def judge_in_parts(
    queries: DataFrame, references: DataFrame, judge: Judge, budget: int = BUDGET, query_budget: int = QUERY_BUDGET, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Verdicts of all ``queries`` (query_id, text) about the same ``references`` (rank, text).

    No prompt has more than ``budget`` tokens. A query of more than
    ``query_budget`` is an error row. Without references a query is asked once.
    """
    head = len(re.findall(TOKEN_ASCII, PROMPT_HEAD + PROMPT_TAIL)) + AROUND
    parts = written(deal_parts(references, budget - query_budget - head, span), "parts")
    if parts.isEmpty():
        parts = queries.sparkSession.createDataFrame([(0, [], "")], parts.schema)
    long = _tokens(F.coalesce("text", F.lit(""))) > query_budget
    answers = written(ask_parts(written(queries.where(~long).select("query_id", "text"), "asked"), parts, judge), "part_answers")
    none = {"is_match": "boolean", "confidence": "double", "explanation": "string", "matched_references": "array<int>"}
    refused = queries.where(long).select(
        "query_id", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()],
        F.lit(f"query of more than {query_budget} tokens").alias("error"), F.lit(None).cast("double").alias("elapsed"),
    )
    return merge_parts(answers).unionByName(refused)
