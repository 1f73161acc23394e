"""Rounds of generated candidates: a generator is asked only where nothing valid has been found.

A round gives every original that is still without a valid candidate of a
label one more attempt. The generator runs in the tasks, its results are
checked, and the round is a written table: what was generated, how it was
judged, and why it failed. The number of rounds is the largest number of
attempts that a label allows; a round without open originals ends the loop.

Candidates are as large as their originals, and there are several of each. A
candidate lies on disk once: in the table of its round, which takes the place
of what was generated. Texts and their verdicts are not shuffled at one time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspot.operators.labelset import MAX_ATTEMPTS
from kinspot.session import drop_table, new_path, written, written_small

#: of (code, label, attempt) of some originals: one candidate text each, or None
Generator = Callable[[list[tuple[str, int, int]]], Sequence[str | None]]
#: of candidates ``(src_id, label, attempt, code)``: the same rows with ``is_valid`` and any scores
Check = Callable[[DataFrame], DataFrame]

GENERATE_BATCH = 16
#: characters of candidates that leave a task at once, about: a frame of each call would cost more than most calls
YIELDED_CHARS = 1 << 22
NOTHING = "nothing generated"


def generate(todo: DataFrame, generator: Generator, batch_size: int = GENERATE_BATCH) -> DataFrame:
    """``src_id, label, attempt, code, error`` for rows ``(src_id, label, attempt, original)``.

    When a call fails, its originals are sent again one by one; those that
    fail have no code and an error.
    """

    def one_by_one(asked: list[tuple[str, int, int]]) -> list[tuple[str | None, str | None]]:
        try:
            texts = list(generator(asked))
            if len(texts) != len(asked):
                raise ValueError(f"{len(texts)} candidates for {len(asked)} originals")
            return [(t, None if t is not None else NOTHING) for t in texts]
        except Exception as failure:  # noqa: BLE001 - any failure is the attempt's error
            if len(asked) == 1:
                return [(None, str(failure) or type(failure).__name__)]
            return [r for a in asked for r in one_by_one([a])]

    def rows(part: pd.DataFrame, made: list[tuple[str | None, str | None]]) -> pd.DataFrame:
        out = pd.DataFrame(made, columns=["code", "error"], dtype=object)
        return out.assign(**{c: part[c].to_numpy() for c in ("src_id", "label", "attempt")})[["src_id", "label", "attempt", "code", "error"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = list(zip(frame["original"], frame["label"].tolist(), frame["attempt"].tolist()))
            first, made, held = 0, [], 0
            for start in range(0, len(asked), batch_size):
                new = one_by_one(asked[start : start + batch_size])
                made += new
                held += sum(len(text or "") for text, _ in new)
                if held >= YIELDED_CHARS:
                    yield rows(frame.iloc[first : first + len(made)], made)
                    first, made, held = first + len(made), [], 0
            if made:
                yield rows(frame.iloc[first:], made)

    source = todo.select("src_id", "label", "attempt", "original")
    kind = source.schema["src_id"].dataType.simpleString()
    return source.mapInPandas(run, f"src_id {kind}, label int, attempt int, code string, error string")


def candidate_rounds(
    originals: DataFrame, generator: Generator, check: Check, attempts: Mapping[int, int] = MAX_ATTEMPTS, path: str | None = None, batch_size: int = GENERATE_BATCH
) -> DataFrame:
    """Every attempt made: ``src_id, label, attempt, code, error, is_valid`` and the scores of ``check``.

    ``originals`` is ``(src_id, code)`` with unique ids; null codes are empty
    texts. A failed attempt counts as one and is not valid.
    :func:`kinspot.operators.labelset.first_valid` picks the accepted ones.
    """
    spark = originals.sparkSession
    root = path or new_path(spark, "rounds")
    own = written_small(originals.select("src_id", F.coalesce("code", F.lit("")).alias("original")), "originals", f"{root}/originals")
    labels = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(most).alias("most")) for label, most in attempts.items()])
    still_open = own.select("src_id", F.inline(labels))
    rounds: list[DataFrame] = []
    for attempt in range(1, max(attempts.values()) + 1):
        wanted = still_open.where(F.col("most") >= attempt).select("src_id", "label", F.lit(attempt).alias("attempt"))
        if wanted.isEmpty():
            break
        # written before it is checked, so that nothing is generated twice
        made = written_small(generate(wanted.join(own, "src_id"), generator, batch_size), "generated", f"{root}/generated-{attempt}")
        checked = check(made.where(F.col("code").isNotNull()).drop("error"))
        scores = [c for c in checked.columns if c not in ("src_id", "label", "attempt", "code")]
        verdicts = written_small(checked.select("src_id", "label", *scores), "verdicts", f"{root}/verdicts-{attempt}")
        judged = made.join(verdicts, ["src_id", "label"], "left")
        judged = judged.select(*made.columns, *[F.coalesce(F.col(c), F.lit(False)).alias(c) if c == "is_valid" else F.col(c) for c in scores])
        rounds.append(written_small(judged, "round", f"{root}/round-{attempt}"))
        drop_table(spark, f"{root}/generated-{attempt}")
        found = rounds[-1].where("is_valid").select("src_id", "label")
        still_open = written(still_open.join(found, ["src_id", "label"], "left_anti"), "open", f"{root}/open-{attempt}")
    return reduce(DataFrame.unionByName, rounds) if rounds else _no_attempts(own, check)


def _no_attempts(own: DataFrame, check: Check) -> DataFrame:
    none = own.select("src_id", F.lit(1).alias("label"), F.lit(1).alias("attempt"), F.col("original").alias("code")).where("false")
    return check(none).withColumn("error", F.lit(None).cast("string"))
