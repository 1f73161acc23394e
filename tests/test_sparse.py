import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinspot.operators.sparse import bm25_score_pairs, build_sparse_index, sparse_topk, term_counts

CORPUS = [(1, "x = a + a"), (2, "x = b"), (3, "y = b - c"), (4, "return c")]


def docs_of(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} bigint, text string")


def brute_force(docs, queries, k):
    """BM25 by the formula, over every document; only documents sharing a term."""
    tokens = {d: t.split() for d, t in docs}
    n = len(tokens)
    avgdl = sum(map(len, tokens.values())) / n
    df = Counter(w for t in tokens.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: floor if r < 0 else r for w, r in raw.items()}
    out = set()
    for q, text in queries:
        scored = []
        for d, t in tokens.items():
            tf = Counter(t)
            shared = [w for w in text.split() if w in tf]
            if shared:
                score = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in shared)
                scored.append((-round(score, 6), d))
        out |= {(q, d, rank) for rank, (_, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_hand_fixture(spark):
    index = build_sparse_index(docs_of(spark, CORPUS))
    stats = index.corpus_stats.first()
    assert (stats.n, stats.avgdl, round(stats.avg_idf, 6)) == (4, 3.75, 0.376577)
    terms = {r.term: (r.df, round(r.idf, 6)) for r in index.term_stats.collect()}
    assert terms["="] == (3, 0.094144) and terms["a"] == (1, 0.847298) and terms["x"] == (2, 0.0)
    queries = docs_of(spark, [(7, "x = a a")], "query_id")
    expected = {1: 2.268440, 2: 0.103455, 3: 0.081865}
    top = sparse_topk(index, queries, 10).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in top] == [(1, 1), (2, 2), (3, 3)]
    assert {r.doc_id: r.score for r in top} == pytest.approx(expected)
    pairs = spark.createDataFrame([(7, 1), (7, 4)], "query_id bigint, doc_id bigint")
    assert {r.doc_id: r.score for r in bm25_score_pairs(index, queries, pairs).collect()} == {1: 2.26844, 4: 0.0}


def zipf_texts(rng, n, length, vocabulary):
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [
        (i, " ".join(f"w{w}" for w in rng.choices(range(vocabulary), weights, k=rng.randint(1, length)))) for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_thresholds_give_the_exact_top_k(spark, seed):
    rng = random.Random(seed)
    docs = zipf_texts(rng, 300, 60, 150)
    # copies and one hot word that a third of all tokens are
    docs += [(300 + i, docs[i][1]) for i in range(40)]
    docs = [(d, t + " hot" * (len(t.split()) // 2)) for d, t in docs]
    queries = zipf_texts(rng, 25, 12, 150) + [(25, "hot hot"), (26, "absent"), (27, docs[3][1])]
    index = build_sparse_index(docs_of(spark, docs))
    asked = docs_of(spark, queries, "query_id")
    expected = brute_force(docs, queries, 5)
    for probe in (1, 50, 10**6):
        got = sparse_topk(index, asked, 5, probe_rows=probe).collect()
        assert {(r.query_id, r.doc_id, r.rank) for r in got} == expected, probe


def test_negative_floor_is_exact_too(spark):
    docs = [(i, "a b" + (" c" if i < 2 else "")) for i in range(6)]
    queries = [(0, "a c"), (1, "a")]
    index = build_sparse_index(docs_of(spark, docs))
    expected = brute_force(docs, queries, 2)
    got = sparse_topk(index, docs_of(spark, queries, "query_id"), 2).collect()
    assert {(r.query_id, r.doc_id, r.rank) for r in got} == expected


def test_empty_documents_count(spark):
    index = build_sparse_index(docs_of(spark, [(1, "a b"), (2, ""), (3, " \n")]))
    assert index.corpus_stats.first().n == 3
    assert index.corpus_stats.first().avgdl == pytest.approx(2 / 3)
    assert {(r.doc_id, r.dl, r.n_terms) for r in index.doc_stats.collect()} == {(1, 2, 2), (2, 0, 0), (3, 0, 0)}
    assert index.postings.where(F.col("term").isNull()).count() == 0


def test_texts_and_tokens_are_not_shuffled(spark, capsys):
    term_counts(docs_of(spark, CORPUS)).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_null_text_is_empty(spark):
    got = term_counts(docs_of(spark, [(1, None), (2, "a a")])).collect()
    assert {tuple(r) for r in got} == {(1, 0, None, 0), (2, 2, "a", 2)}


def test_terms_are_counted_in_pieces_of_bounded_size(monkeypatch):
    import pyarrow as pa

    from kinspot.operators import sparse

    texts = [["a", "b", "a"], [], ["c"] * 50, ["a"], [], ["b", "c"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "tokens"])
    monkeypatch.setattr(sparse, "COUNTED_TOKENS", 4)
    pieces = list(sparse._count(iter([batch, batch.slice(0, 0)])))
    assert len(pieces) > 2 and max(p.num_rows for p in pieces) <= 5
    got = sorted((tuple(r.values()) for p in pieces for r in p.to_pylist()), key=repr)
    want = [(i, len(t), w, t.count(w)) for i, t in enumerate(texts) for w in set(t)] + [(i, 0, None, 0) for i, t in enumerate(texts) if not t]
    assert got == sorted(want, key=repr)
