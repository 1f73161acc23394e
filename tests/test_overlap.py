"""Overlap of words, and candidates that leave a task."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kinspot.functions.text import token_jaccard, token_jaccards, whitespace_tokens
from kinspot.operators import rounds


def test_word_overlaps_by_hand(spark):
    rows = [("a b c", ["c\x1cb　a", "a  d", "", None]), ("", ["", "x"]), (None, ["x", None])]
    df = spark.createDataFrame(rows, "text string, others array<string>")
    found = [r[0] for r in df.select(token_jaccards("text", F.col("others"))).collect()]
    assert found == [[1.0, 0.25, 0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]
    pair = df.select(token_jaccard("text", F.col("others")[1])).collect()
    assert [r[0] for r in pair] == [0.25, 0.0, 0.0]


def test_words_are_split_at_every_white_space(spark):
    space = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    text = "".join(f"w{i}{c}" for i, c in enumerate(space)) + "\x00x​y"
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(whitespace_tokens("text")).collect()] == [text.split(), [], None]


def test_candidates_leave_a_task_in_few_frames():
    class Rows:
        schema = {"src_id": SimpleNamespace(dataType=LongType())}

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            self.run = run
            return self

    asked, sizes = Rows(), []

    def generator(some):
        sizes.append(len(some))
        return [None if text == "t5" else text + "!" for text, _, _ in some]

    rounds.generate(asked, generator, batch_size=16)
    frame = pd.DataFrame({"src_id": range(1000), "label": 1, "attempt": 1, "original": [f"t{i}" for i in range(1000)]})
    frames = list(asked.run(iter([frame])))
    assert len(frames) == 1 and sizes == [16] * 62 + [8]
    made = pd.concat(frames)
    assert made["src_id"].tolist() == list(range(1000))
    assert made["code"].tolist()[4:7] == ["t4!", None, "t6!"] and made["error"].tolist()[4:7] == [None, rounds.NOTHING, None]
