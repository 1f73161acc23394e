import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspot.functions.vectors import cosine, l2_normalize
from kinspot.operators.dense import build_dense_index, dense_topk, max_corpus_similarity, unsound_vectors
from kinspot.operators.embedding import embed_column, embed_missing, hash_embed_text


def vectors(spark, matrix, key="doc_id", start=0):
    rows = [(i + start, list(map(float, v))) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, unit_vec array<double>")


def expected(queries, corpus, k, exclude_self=False):
    scores = np.round(queries @ corpus.T, 6)
    out = set()
    for q, row in enumerate(scores):
        order = sorted((-s, d) for d, s in enumerate(row) if not (exclude_self and d == q))[:k]
        out |= {(q, d, rank) for rank, (_, d) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("lanes", [None, 3])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_topk_matches_numpy(spark, lanes, exclude_self):
    rng = np.random.default_rng(5)
    corpus = rng.integers(-2, 3, (257, 4)).astype(float)  # many equal scores
    hits = dense_topk(
        vectors(spark, corpus).repartition(5), vectors(spark, corpus[:40], "query_id"), 7, exclude_self, lanes
    )
    assert {(r.query_id, r.doc_id, r.rank) for r in hits.collect()} == expected(corpus[:40], corpus, 7, exclude_self)


def test_fewer_vectors_than_k_are_not_padded(spark):
    corpus = np.eye(3)
    assert dense_topk(vectors(spark, corpus), vectors(spark, corpus, "query_id"), 10).count() == 9
    alone = dense_topk(vectors(spark, corpus[:1]), vectors(spark, corpus[:1], "query_id"), 10, exclude_self=True)
    assert alone.count() == 0


def test_max_similarity(spark):
    best = max_corpus_similarity(vectors(spark, np.eye(3)), vectors(spark, [[0, 0.6, 0.8]], "query_id")).first()
    assert (best.nearest_id, best.max_similarity) == (2, 0.8)


def test_normalize_and_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(l2_normalize(F.col("a")).alias("u"), cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0].u == pytest.approx([0.6, 0.8]) and rows[0].c == pytest.approx(0.96)
    assert rows[1].u == [0.0, 0.0] and rows[1].c == 0.0


def test_hash_embedding_counts_tokens(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.embedding for r in hash_embed_text(docs).collect()}
    assert sum(got[1]) == 3 and max(got[1]) == 2 and got[2] == [0.0] * 256
    unit = build_dense_index(hash_embed_text(docs)).where("doc_id = 1").first().unit_vec
    assert sum(x * x for x in unit) == pytest.approx(1)


def test_embed_column_calls_in_batches(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(10)], "doc_id bigint, text string").coalesce(1)
    got = embed_column(docs, lambda texts: [[len(t), len(texts)] for t in texts], batch_size=4).collect()
    assert {r.doc_id: r.embedding for r in got} == {i: [i, 4.0 if i < 8 else 2.0] for i in range(10)}


def test_embed_missing_embeds_new_and_changed_texts_once(spark, tmp_path):
    path = str(tmp_path / "embeddings")
    make = lambda tag: lambda texts: [[float(len(t)), tag] for t in texts]
    docs = spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id bigint, text string")
    assert {tuple(r.embedding) for r in embed_missing(docs, path, make(1.0)).collect()} == {(1, 1), (2, 1)}
    changed = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, "c")], "doc_id bigint, text string")
    got = {r.doc_id: r.embedding for r in embed_missing(changed, path, make(2.0)).collect()}
    assert got == {1: [1, 1], 2: [3, 2], 3: [1, 2]}
    assert spark.read.parquet(path).count() == 4


def test_unsound_vectors_are_listed_and_cost_no_other_row(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [nan, 1.0]), (2, [0.6, 0.8]), (3, None), (4, [None, 1.0]), (5, [float("inf"), 0.0])]
    corpus = spark.createDataFrame(rows, "doc_id bigint, unit_vec array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in rows], "query_id bigint, unit_vec array<double>")
    got = {(r.query_id, r.doc_id) for r in dense_topk(corpus, queries, 3).collect()}
    assert got == {(q, d) for q in (0, 2) for d in (0, 2)}
    listed = unsound_vectors(corpus.unionByName(spark.createDataFrame([(6, [1.0])], corpus.schema)), vec_col="unit_vec", dim=2)
    assert {tuple(r) for r in listed.collect()} == {(1, "not finite"), (3, "null"), (4, "not finite"), (5, "not finite"), (6, "wrong length")}


def test_ids_of_any_type(spark):
    corpus = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [0.5])], "doc_id string, unit_vec array<double>")
    got = dense_topk(corpus, corpus.withColumnRenamed("doc_id", "query_id"), 1, exclude_self=True).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {("a", "b"), ("b", "a"), ("c", "a")}


def test_later_blocks_give_only_rows_that_can_be_among_the_best():
    import numpy as np
    import pyarrow as pa

    from kinspot.operators.dense import block_topk

    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(60, 2)), 1)  # many equal scores
    vectors /= np.maximum(1, np.linalg.norm(vectors, axis=1))[:, None]
    asked, blocks = vectors[:20], [range(0, 25), range(25, 28), range(28, 60), range(0, 25)]
    name = ["q_ids", "q_vectors", "ids", "vectors"]

    def met(rows):
        values = [list(range(20)), asked.ravel().tolist(), [100 - i for i in rows], vectors[list(rows)].ravel().tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=name)

    out = [b.to_pylist() for b in block_topk(3, False)(iter([met(r) for r in blocks]))]
    assert len(out[3]) == len(out[0]) - sum(r not in out[3] for r in out[0]) and len(out[2]) < 60  # not three for every query again
    best: dict[int, dict[int, float]] = {}
    for r in (r for part in out for r in part):
        best.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    for q in range(20):
        want = sorted((-round(float(asked[q] @ vectors[i]), 6) + 0.0, 100 - i) for i in range(60))[:3]
        assert [(d, -s + 0.0) for s, d in want] == sorted(best[q].items(), key=lambda x: (-x[1], x[0]))[:3]
