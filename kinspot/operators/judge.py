"""Contexts, prompts, judges and verdicts."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspot.functions.text import strip_fences, tokenize, whole_json
from kinspot.operators.ordered import running_sum
from kinspot.session import written

# --- fixed values: prompt and answer formats ---------------------------------
REFERENCE_SEPARATOR = "\n\n---\n\n"
REFERENCE_HEAD = "REFERENCE "
PROMPT_HEAD = "You are a code plagiarism detector. Analyze if the QUERY code is plagiarized from any REFERENCE code."
PROMPT_TAIL = """Determine:
1. Is the query plagiarized? (YES/NO)
2. If yes, which reference(s)?
3. Plagiarism confidence (0.0-1.0)
4. Brief explanation

Return JSON:
{
  "is_plagiarized": true/false,
  "confidence": 0.0-1.0,
  "matched_references": [1, 2, ...],
  "explanation": "brief reason"
}"""
CONTAINMENT_THRESHOLD = 0.8
FALLBACK_EXPLANATION = "Parse error"
FENCE_OPEN, FENCE_CLOSE = "\n```python\n", "\n```"
# -----------------------------------------------------------------------------

# Leading hash digits counted by sample_rows; at most 16 ** 3 counts.
SAMPLE_DIGITS = 3

Judge = Callable[[list[str]], Sequence[str]]


def sample_rows(corpus: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Exactly ``n`` rows (or all), reproducible: the smallest seeded hashes.

    A count per leading hash digits tells which hashes can be among the
    smallest ``n``, so that little more than ``n`` rows are ordered.
    """
    key = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))
    keyed = corpus.withColumn("sample_key", key)
    lead = F.substring("sample_key", 1, SAMPLE_DIGITS)
    counts = corpus.select(key.alias("sample_key")).groupBy(lead.alias("lead")).agg(F.count("*").alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("lead")))
    last = running.where(F.col("upto") >= n).agg(F.min("lead")).scalar()
    return keyed.where(lead <= F.coalesce(last, F.lit("g"))).orderBy("sample_key", id_col).limit(n)


def number_sample(sample: DataFrame) -> DataFrame:
    """Give a sample its 1-based ``rank`` in sample order, the order of the context."""
    counted = running_sum(sample, [], "sample_key", {"rank": F.lit(1).cast("bigint")}, then=["doc_id"])
    return counted.withColumn("rank", F.col("rank").cast("int")).drop("sample_key")


def reference_text(number: Column, text: Column) -> Column:
    """One reference of a prompt."""
    return F.concat(F.lit(REFERENCE_HEAD), number.cast("string"), F.lit(":" + FENCE_OPEN), F.coalesce(text, F.lit("")), F.lit(FENCE_CLOSE))


def prompt_text(query: str, references: str) -> str:
    """The prompt about a query and its joined references."""
    return f"{PROMPT_HEAD}\n\nQUERY CODE:{FENCE_OPEN}{query}{FENCE_CLOSE}\n\nREFERENCE CODES:\n{references}\n\n{PROMPT_TAIL}"


def build_prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompt per query from ``(query_id, rank, text)`` contexts in rank order.

    A query has at most k contexts, which bounds the collected array. A query
    without contexts gets a prompt without references. Null texts, of queries
    and of references, are empty ones.
    """
    blocks = (
        contexts.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("refs"))
        .select(
            "query_id",
            F.size("refs").alias("context_size"),
            F.array_join(
                F.transform("refs", lambda r, i: reference_text(i + 1, r["text"])),
                REFERENCE_SEPARATOR,
            ).alias("references"),
        )
    )
    mark, other = "\0query\0", "\0references\0"
    before, between, after = re.split(f"{mark}|{other}", prompt_text(mark, other))
    prompt = F.concat(
        F.lit(before), F.coalesce("text", F.lit("")), F.lit(between), F.coalesce("references", F.lit("")), F.lit(after)
    )
    return queries.join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("context_size", F.lit(0)).alias("context_size"), prompt.alias("prompt")
    )


def answer_each(judge: Judge, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt; when a call fails, each half of its prompts is sent again by itself."""
    try:
        answers = list(judge(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
        return [(answer, None) for answer in answers]
    except Exception as failure:  # noqa: BLE001 - any failure is the case's error
        if len(prompts) == 1:
            return [(None, str(failure) or type(failure).__name__)]
        half = len(prompts) // 2
        return answer_each(judge, prompts[:half]) + answer_each(judge, prompts[half:])


def ask_judge(prompts: DataFrame, judge: Judge, batch_size: int = 16) -> DataFrame:
    """Send prompts to a user's judge from inside the tasks.

    Returns ``query_id, response, error, elapsed``. When a call fails, each
    half of its prompts is sent again by itself, down to the single prompts
    that fail, which keep their error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                texts = part["prompt"].tolist()
                begun = time.perf_counter()
                answers = answer_each(judge, texts)
                elapsed = (time.perf_counter() - begun) / len(texts)
                out = pd.DataFrame(answers, columns=["response", "error"], dtype=object)
                yield out.assign(query_id=part["query_id"].to_numpy(), elapsed=elapsed)

    source = prompts.select("query_id", "prompt")
    id_type = source.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, response string, error string, elapsed double"
    return source.mapInPandas(lambda frames: (f[["query_id", "response", "error", "elapsed"]] for f in run(frames)), schema)


def parse_verdicts(responses: DataFrame, response: str = "response") -> DataFrame:
    """Read judge answers into ``is_match, confidence, matched_references, explanation, error``.

    Each field is read by itself, so a reference list of another type spoils
    nothing. Text that is not one JSON value gives the fallback verdict; JSON
    that is no object or lacks a field is an error row, and so is a row that
    already has an ``error``. A null field is lacking. Any value of
    ``is_plagiarized`` but false, 0 and the empty text counts as yes. Numbers may stand in quotes.
    """
    failed = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    rows = responses.withColumn("_json", whole_json(strip_fences(response)))
    rows = rows.withColumn("_answer", F.try_variant_get("_json", "$", "map<string,variant>"))
    value = {name: F.try_element_at("_answer", F.lit(name)) for name in ("is_plagiarized", "confidence", "matched_references", "explanation")}
    match, kind = value["is_plagiarized"], F.schema_of_variant(value["is_plagiarized"])
    yes = (
        F.when(kind == "BOOLEAN", F.try_variant_get(match, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(match, "$", "string") != "")
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(match, "$", "double") != 0)
        .when(kind != "VOID", F.lit(True))
    )
    confidence = F.try_variant_get(value["confidence"], "$", "double")
    explanation = F.try_variant_get(value["explanation"], "$", "string")
    bad = F.col("_json").isNull()
    incomplete = yes.isNull() | confidence.isNull() | explanation.isNull()

    def field(found: Column, fallback: Column) -> Column:
        return F.when(failed.isNull(), F.when(bad, fallback).otherwise(F.when(~incomplete, found)))

    none = F.array().cast("array<int>")
    references = F.coalesce(F.try_variant_get(value["matched_references"], "$", "array<int>"), none)
    problem = F.when(~bad, F.when(F.col("_answer").isNull(), F.lit("not an object")).when(incomplete, F.lit("missing field")))
    return rows.select(
        *[c for c in responses.columns if c not in (response, "error")],
        field(yes, F.lit(False)).alias("is_match"),
        field(confidence, F.lit(0.0)).alias("confidence"),
        F.coalesce(field(references, none), none).alias("matched_references"),
        field(explanation, F.lit(FALLBACK_EXPLANATION)).alias("explanation"),
        F.coalesce(failed, problem).alias("error"),
    )


def pair_containment(queries: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Add to ``(query_id, doc_id, ...)`` pairs the share of query tokens the document holds.

    ``counts`` has one row per document and distinct term. Query tokens are
    looked up by (term, doc_id), so no document is read whole and a term that
    is in every document is spread over all of them.
    """
    wanted = written(pairs.select("query_id", "doc_id").distinct().join(query_words(queries), "query_id"), "pair_terms")
    shared = (
        wanted.join(counts.select("term", "doc_id"), ["term", "doc_id"])
        .groupBy("query_id", "doc_id")
        .agg(F.count("*").alias("n_shared"))
    )
    sizes = queries.select("query_id", F.size(F.array_distinct(tokenize("text"))).alias("n_query_terms"))
    return (
        pairs.join(shared, ["query_id", "doc_id"], "left")
        .join(sizes, "query_id")
        .select(*pairs.columns, _share().alias("containment"))
    )


def query_words(queries: DataFrame) -> DataFrame:
    """Distinct tokens of every query: ``query_id, term``."""
    return queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))


def _share() -> Column:
    return F.round(F.coalesce(F.try_divide("n_shared", "n_query_terms"), F.lit(0.0)), 6)


def judge_containment(
    queries: DataFrame, judged: DataFrame, threshold: float = CONTAINMENT_THRESHOLD
) -> DataFrame:
    """Built-in judge: a query matches when one context holds enough of its tokens.

    ``judged`` has ``query_id, rank, containment``; queries without contexts
    get a negative verdict.
    """
    hit = F.col("containment") >= threshold
    verdicts = judged.groupBy("query_id").agg(
        F.max("containment").alias("confidence"),
        F.count("*").alias("context_size"),
        F.array_sort(F.collect_list(F.when(hit, F.col("rank")))).alias("matched_references"),
    )
    return queries.select("query_id").join(verdicts, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("confidence") >= threshold, F.lit(False)).alias("is_match"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("context_size", F.lit(0)).cast("int").alias("context_size"),
        F.coalesce("matched_references", F.array().cast("array<int>")).alias("matched_references"),
    )
