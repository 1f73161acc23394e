"""Search by regions beside brute force, and how many regions it reads."""

import numpy as np
import pytest

from kinspot.operators import regions as rg
from test_dense import expected, vectors


def clustered(n, width=16, centres=60, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(centres, width))
    around /= np.linalg.norm(around, axis=1, keepdims=True)
    x = around[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def got(search):
    return {(r.query_id, r.doc_id, r["rank"]) for r in search.hits.collect()}


def some(spark, corpus, n):
    return vectors(spark, corpus[:n], "query_id")


@pytest.mark.parametrize("exclude_self", [False, True])
def test_clustered_vectors_read_few_regions(spark, exclude_self):
    corpus = clustered(4000)
    index = rg.build_regions(vectors(spark, corpus).repartition(4))
    search = rg.region_search(index, some(spark, corpus, 80), 6, exclude_self)
    assert got(search) == expected(corpus[:80], corpus, 6, exclude_self)
    n = index.regions.count()
    assert n > 40 and search.read.count() < 80 * n / 2
    per_query = search.read.groupBy("query_id").count().toPandas()["count"]
    assert len(per_query) == 80 and per_query.median() < n / 4


def test_spread_out_vectors_are_exact(spark):
    rng = np.random.default_rng(4)
    corpus = rng.normal(size=(1500, 24))
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    index = rg.build_regions(vectors(spark, corpus))
    assert got(rg.region_search(index, some(spark, corpus, 30), 5)) == expected(corpus[:30], corpus, 5)


@pytest.mark.parametrize("probe", [1, 3])
def test_vectors_of_any_length_ties_and_zeros(spark, probe):
    rng = np.random.default_rng(9)
    corpus = rng.integers(-2, 3, (900, 4)).astype(float)  # many equal scores, zero vectors, lengths 0 to 4
    index = rg.build_regions(vectors(spark, corpus), regions=25)
    assert got(rg.region_search(index, some(spark, corpus, 60), 7, probe=probe)) == expected(corpus[:60], corpus, 7)


def test_a_third_of_equal_vectors_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(rg, "BLOCK_ROWS", 64)
    corpus = np.concatenate((clustered(1200, 8), np.tile(clustered(1, 8, seed=3), (600, 1))))
    index = rg.build_regions(vectors(spark, corpus))
    assert index.blocks.selectExpr("max(size(ids)) AS n").first().n <= 64
    assert index.regions.selectExpr("sum(n) AS n").first().n == len(corpus)
    queries = np.concatenate((corpus[:20], corpus[-3:]))
    search = rg.region_search(index, vectors(spark, queries, "query_id"), 9)
    assert got(search) == expected(queries, corpus, 9)


def test_small_and_odd_tables(spark):
    corpus = np.eye(3)
    index = rg.build_regions(vectors(spark, corpus))
    assert got(rg.region_search(index, some(spark, corpus, 3), 10)) == expected(corpus, corpus, 10)
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [float("nan"), 0.0, 1.0]), (3, [0.0, 1.0, 0.0]), (4, [])], "query_id bigint, unit_vec array<double>")
    assert {q for q, _, _ in got(rg.region_search(index, odd, 2))} == {3}
    none = rg.build_regions(vectors(spark, corpus).where("false"))
    assert rg.region_search(none, some(spark, corpus, 3), 2).hits.count() == 0
    zeros = rg.build_regions(vectors(spark, np.zeros((5, 3))))
    assert got(rg.region_search(zeros, some(spark, corpus, 2), 2)) == {(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2)}
    ragged = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0])], "doc_id bigint, unit_vec array<double>")
    with pytest.raises(ValueError, match="vectors of 1 to 2"):
        rg.build_regions(ragged)
