import re
import sys

import pytest
from pyspark.sql import functions as F

from kinspot.functions import text as tx

SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text",
    ["", "x = a + a", "def f(a_1):\n\treturn a_1**2", "é\u00a0b\u2003c\x1cd\x85e", "".join(f"a{s}b" for s in SPACES), "😀 x😀"],
)
def test_tokenize_is_the_documented_pattern(spark, text):
    assert one(spark, tx.tokenize("t"), t=text) == re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", text)


def test_whitespace_tokens_split_like_python(spark):
    text = " lead" + "".join(f"w{i}{s}" for i, s in enumerate(SPACES)) + "w1 w1"
    assert set(one(spark, tx.whitespace_tokens("t"), t=text)) == set(text.split())
    assert one(spark, tx.whitespace_tokens("t"), t="") == []


@pytest.mark.parametrize(
    ("a", "b", "expected"), [("a b c", "b  c d", 0.5), ("", "", 0.0), ("a a", "a", 1.0), ("a", "", 0.0)]
)
def test_token_jaccard(spark, a, b, expected):
    assert one(spark, tx.token_jaccard("a", "b"), a=a, b=b) == pytest.approx(expected)


def test_strip_fences(spark):
    assert one(spark, tx.strip_fences("t"), t=" \u00a0```json\n{}\n```\n ") == "{}"
    assert one(spark, tx.strip_fences("t"), t="```python\nx = 1\n```") == "x = 1"
    assert one(spark, tx.strip_fences("t"), t="a ``` b") == "a  b"


@pytest.mark.parametrize(
    ("url", "tail"),
    [("https://h.org/u/repo.git", "repo"), ("https://h.org/u/repo//", "repo"), ("plain", "plain"), ("", "")],
)
def test_path_tail(spark, url, tail):
    assert one(spark, tx.path_tail("u"), u=url) == tail


def test_token_band_includes_both_ends(spark):
    df = spark.createDataFrame([(n,) for n in (29, 30, 8000, 8001)], ["n"])
    assert [r.n for r in df.where(tx.in_token_band(F.col("n"))).collect()] == [30, 8000]


def test_containment(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], ["a"])], "q array<string>, d array<string>")
    assert [r.x for r in df.select(tx.containment(F.col("q"), F.col("d")).alias("x")).collect()] == [0.5, 0.0]


def test_tokens_of_whole_tables_are_those_of_the_expression(spark, monkeypatch, capsys):
    from kinspot.operators.sparse import term_counts

    spaces = "".join(f"{c}x{i}" for i, c in enumerate(tx.SPACES + " "))
    texts = [None, "", spaces, "é_x9 q\x00z­​﻿😀😀 a-b", "a_1" * 50, " \t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    docs = docs.unionByName(spark.sql("SELECT -1L AS doc_id, CAST(X'61FF62C328E282' AS STRING) AS text"))
    monkeypatch.setattr(tx, "BATCH_CHARS", 3)
    want = docs.select("doc_id", tx.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    got = tx.tokenised(docs).mapInArrow(tx.token_batches, "doc_id bigint, tokens array<string>")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    term_counts(docs).explain()  # an expression takes some four times as long for the tokens of a table
    assert "regexp_extract_all" not in capsys.readouterr().out
