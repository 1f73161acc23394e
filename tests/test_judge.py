import hashlib

import pytest

from kinspot.operators.containment import sample_verdicts
from kinspot.operators.fusion import rrf_topk, rrf_topk_sweep
from kinspot.operators.judge import build_prompts, judge_containment, number_sample, pair_containment, parse_verdicts
from kinspot.operators.judge import sample_rows
from kinspot.operators.sparse import term_counts


def ranked(spark, *ids):
    return spark.createDataFrame(
        [(1, d, rank) for rank, d in enumerate(ids, 1)], "query_id bigint, doc_id bigint, rank int"
    )


def test_rank_fusion_fixture(spark):
    p, q, r, s = 1, 2, 3, 4
    got = rrf_topk(ranked(spark, p, q, r), ranked(spark, q, s), 10).orderBy("rank").collect()
    assert [(x.doc_id, round(x.score, 6)) for x in got] == [(q, 0.033060), (p, 0.016667), (s, 0.016393), (r, 0.016129)]
    swept = rrf_topk_sweep(ranked(spark, p, q, r), ranked(spark, q, s), [30, 60], 10)
    assert swept.where("rrf_k = 60").count() == 4
    assert swept.where("rrf_k = 30 AND rank = 1").first().score == pytest.approx(1 / 31 + 1 / 30)


def test_list_depth_is_twice_k(spark):
    # document 3 is third in one list: out of reach for k = 1, best of both for k = 2
    dense, sparse = ranked(spark, 1, 2, 3), ranked(spark, 3)
    assert [r.doc_id for r in rrf_topk(dense, sparse, 1).collect()] == [1]
    assert [r.doc_id for r in rrf_topk(dense, sparse, 2).orderBy("rank").collect()] == [3, 1]


def test_verdict_parsing(spark):
    answers = {
        1: '```json\n{"is_plagiarized": true, "confidence": 0.9, "matched_references": [1], "explanation": "x"}\n```',
        2: "garbage",
        3: '{"is_plagiarized": true}',
        4: '{"is_plagiarized": "yes", "confidence": 1, "matched_references": [], "explanation": ""}',
        5: '{"is_plagiarized": false, "confidence": 0, "explanation": "no list"}',
        6: "",
    }
    df = spark.createDataFrame(list(answers.items()), "query_id int, response string")
    got = {r.query_id: tuple(r)[1:] for r in parse_verdicts(df).collect()}
    fallback = (False, 0.0, [], "Parse error", None)
    assert got[1] == (True, 0.9, [1], "x", None)
    assert got[2] == got[6] == fallback
    assert got[4] == (True, 1.0, [], "", None)  # fields are read one by one, and any text but the empty one is a yes
    assert got[3][0] is None and got[3][4] == "missing field"
    assert got[5] == (False, 0.0, [], "no list", None)


def test_prompts_number_references_in_rank_order(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "r")], "query_id bigint, text string")
    contexts = spark.createDataFrame([(1, 5, "second"), (1, 2, "first")], "query_id bigint, rank int, text string")
    got = {r.query_id: r for r in build_prompts(queries, contexts).collect()}
    assert got[1].context_size == 2 and got[2].context_size == 0
    body = got[1].prompt.split("REFERENCE CODES:\n")[1]
    assert body.startswith("REFERENCE 1:\n```python\nfirst\n```\n\n---\n\nREFERENCE 2:\n```python\nsecond\n```\n\nDetermine:")
    assert "QUERY CODE:\n```python\nq\n```" in got[1].prompt


@pytest.mark.parametrize("n", [0, 1, 30, 499, 500, 900])
def test_sample_is_the_smallest_seeded_hashes(spark, n):
    ids = list(range(500))
    order = sorted(ids, key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").repartition(4)
    assert {r.doc_id for r in sample_rows(df, n, seed=7).collect()} == set(order[:n])
    if n == 30:
        numbered = number_sample(sample_rows(df, n, seed=7)).orderBy("rank").collect()
        assert [r.doc_id for r in numbered] == order[:30]


def test_containment_judge(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x"), (3, "z")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a b c d e"), (2, "nothing here"), (3, "a")], "query_id bigint, text string")
    counts = term_counts(docs)
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 3)], "query_id bigint, doc_id bigint, rank int")
    judged = pair_containment(queries, pairs, counts)
    assert {(r.doc_id, r.containment) for r in judged.collect()} == {(1, 0.8), (2, 0.2), (3, 0.0)}
    verdicts = {r.query_id: r for r in judge_containment(queries, judged).collect()}
    assert verdicts[1].is_match and verdicts[1].matched_references == [2] and verdicts[1].context_size == 3
    assert not verdicts[2].is_match and verdicts[2].confidence == 0.0 and verdicts[2].context_size == 0
    sample = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "doc_id bigint, rank int")
    shared = sample_verdicts(queries, sample, counts)
    assert {(r.query_id, r.confidence, tuple(r.matched_references)) for r in shared.collect()} == {(1, 0.8, (1,)), (2, 0.0, ()), (3, 1.0, (1, 2))}


def test_sample_verdicts_equal_containment_of_every_pair(spark, monkeypatch):
    import random

    from kinspot.operators import containment
    from kinspot.operators.sparse import term_counts

    monkeypatch.setattr(containment, "BLOCK_SAMPLE", 7)
    monkeypatch.setattr(containment, "BLOCK_QUERIES", 5)
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(25)}" for _ in range(rng.randrange(14)))
    docs, queries = [(i, text()) for i in range(40)] + [(40, None)], [(i, text()) for i in range(30)] + [(30, None), (31, "unknown words")]
    sample = [(d, r + 1) for r, (d, _) in enumerate(docs)]
    counts = term_counts(spark.createDataFrame(docs, "doc_id bigint, text string"))
    for threshold in (0.8, 0.5):
        got = containment.sample_verdicts(
            spark.createDataFrame(queries, "query_id bigint, text string"), spark.createDataFrame(sample, "doc_id bigint, rank int"), counts, threshold
        ).collect()
        held = {r: set((t or "").split()) for (_, t), (_, r) in zip(docs, sample)}
        assert len(got) == len(queries)
        for r in got:
            own = set((dict(queries)[r.query_id] or "").split())
            share = {rank: round(len(own & words) / len(own), 6) if own else 0.0 for rank, words in held.items()}
            assert r.confidence == max(share.values()) and r.matched_references == sorted(k for k, s in share.items() if s >= threshold)
            assert r.is_match == (r.confidence >= threshold)
