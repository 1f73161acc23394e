import json

import pytest
from pyspark.sql import functions as F

from kinspot.operators import evaluate as ev
from kinspot.plans import detectors as dt
from kinspot.plans.evaluation import evaluate_detector, full_evaluation, report
from kinspot.plans.indexing import build_indexes, load_indexes
from kinspot.plans.labelled_set import build_labelled_set
from kinspot.session import shared_dir, table_exists

TEXTS = ["alpha beta gamma delta", "one two three four five", "red green blue", "alpha beta gamma epsilon", ""]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(0, "alpha beta gamma delta", 1), (1, "one two three nine", 1), (2, "nothing of this", 0), (3, "", 0)]
    return spark.createDataFrame(rows, "case_id bigint, code string, label int")


def test_saved_indexes_give_the_same_verdicts(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    queries = dt.as_queries(spark, ["gamma beta", "blue red", "unknown"])
    built = build_indexes(corpus, path)
    loaded = load_indexes(spark, path)
    with pytest.raises(ValueError, match="vectors of"):
        load_indexes(spark, path, dim=3)
    for detect in (dt.detect_hybrid_context, dt.detect_dense_context, dt.detect_sampled_context):
        a = sorted(detect(built, queries).collect())
        assert a == sorted(detect(loaded, queries).collect())
        assert [r.is_match for r in a] == [True, True, False]


def test_user_embedding(spark, corpus):
    def letters(texts):
        return [[float(t.count(c)) for c in "aeiourgb "] for t in texts]

    index = build_indexes(corpus, embed=letters)
    best = dt.dense_hits(index, dt.as_queries(spark, ["red green blue"]), 1).first()
    assert (best.doc_id, best.score) == (2, 1.0)


def test_judge_failures_become_error_rows(spark, corpus, labelled):
    index = build_indexes(corpus)

    def judge(prompts):
        if any("QUERY CODE:\n```python\none two" in p for p in prompts):
            raise RuntimeError("model is down")
        answer = {"is_plagiarized": True, "confidence": 0.9, "matched_references": [1], "explanation": "same"}
        return [json.dumps(answer) for _ in prompts]

    got = evaluate_detector(lambda q, **o: dt.detect_hybrid_context(index, q, **o), labelled, "m", k=2, judge=judge)
    rows = {r.case_id: r for r in got.collect()}
    assert rows[1].error == "model is down" and rows[1].y_pred == 0 and rows[1].elapsed is None
    assert rows[0].y_pred == 1 and rows[0].confidence == 0.9 and rows[0].elapsed >= 0 and rows[0].error is None
    assert ev.timing(got, "method").first().n_errors == 1


def test_full_evaluation_covers_every_method_and_case(spark, corpus, labelled):
    index = build_indexes(corpus)
    queries = labelled.select(F.col("case_id").alias("query_id"), F.col("code").alias("text"))
    cases = labelled.select("case_id", F.col("label").alias("y_true"))
    scores = {r.method: r for r in report(full_evaluation(index, queries, cases)).collect()}
    assert set(scores) == {"embedding", "sampled_context", "dense_context", "hybrid_context"}
    for row in scores.values():
        assert row.tp + row.tn + row.fp + row.fn == 4 and row.fp == 0 and row.tp >= 1
    assert scores["hybrid_context"].recall == 0.5  # three of four tokens is below the containment cut


def test_labelled_set(spark):
    add = "def add(a, b):\n    total = a + b\n    return total"
    loop = "def loop(n):\n    for i in range(n):\n        print(i)"
    originals = spark.createDataFrame([(1, add), (2, loop)], "src_id bigint, code string")
    renamed = add.replace("total", "s").replace("a + b", "a  +  b")
    unrelated = "class Queue: pass ; x = {} ; y = [] ; import os, sys"
    rows = [
        (1, 1, 1, "not ( python"), (1, 1, 2, renamed), (1, 1, 3, add), (2, 1, 1, "import os"), (2, 1, 4, loop),
        (1, 0, 1, add), (1, 0, 2, loop), (1, 0, 3, unrelated), (2, 0, 1, add),
    ]
    candidates = spark.createDataFrame(rows, "src_id bigint, label int, attempt int, code string")
    index = build_indexes(originals.select(F.col("src_id").alias("doc_id"), F.col("code").alias("text")))
    got = {(r.src_id, r.label): r for r in build_labelled_set(originals, candidates, index).collect()}
    assert set(got) == {(1, 1), (1, 0)}
    copy, other = got[1, 1], got[1, 0]
    assert (copy.attempt, copy.code, copy.original_ref, copy.ast_similarity) == (2, renamed, add, 1.0)
    assert copy.token_jaccard >= 0.1 and copy.original_similarity is None
    assert (other.attempt, other.code) == (3, unrelated)
    assert other.original_similarity <= 0.6 and other.max_corpus_similarity <= 0.6 and other.ast_similarity is None


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_table_exists(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/there")
    assert table_exists(spark, f"{tmp_path}/there") and not table_exists(spark, f"file://{tmp_path}/elsewhere")
