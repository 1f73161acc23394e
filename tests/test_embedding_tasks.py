"""Tasks of hashed embeddings grow in number, not in size."""

from __future__ import annotations

from kinspot.operators import embedding
from kinspot.operators.labelset import structure_vectors


def test_counts_are_grouped_by_as_many_tasks_as_they_need(spark):
    counts = spark.createDataFrame([(i, 1, "a", 2) for i in range(20)], "doc_id bigint, dl int, term string, tf bigint")
    many = embedding.hashed_counts(counts, n_counts=9 * embedding.TASK_COUNTS)
    assert many.rdd.getNumPartitions() == 9
    assert {r["value"] for r in many.collect()} == {2} and many.count() == 20


def test_structure_of_repeated_and_broken_programs(spark, monkeypatch):
    monkeypatch.setattr(embedding, "TASK_DOCS", 1)
    rows = [(1, ["A", "B", "C", "A", "B", "C"]), (1, ["A", "B", "C"]), (2, None), (3, ["A"]), (None, ["A"])]
    vectors = structure_vectors(spark.createDataFrame(rows, "doc_id bigint, node_types array<string>"))
    assert vectors.rdd.getNumPartitions() == len(rows)
    found = {r["doc_id"]: r["embedding"] for r in vectors.collect()}
    assert {k: sum(v) for k, v in found.items()} == {1: 5.0, 2: 0.0, 3: 1.0, None: 1.0}  # ABC BCA CAB ABC, and ABC once more
    assert max(found[1]) >= 3.0 and all(len(v) == embedding.HASH_DIM for v in found.values())


def test_counts_of_a_document_are_added_up_before_the_shuffle(spark, capsys):
    rows = [(1, 3, "a", 2), (2, 1, "b", 1), (1, 3, "b", 1), (3, 0, None, 0), (None, 1, "a", 4), (1, 9, "a", 5)]
    counts = spark.createDataFrame(rows, "doc_id bigint, dl int, term string, tf bigint").coalesce(1)
    embedded = embedding.hash_embed(counts, n_counts=2 * embedding.TASK_COUNTS)
    embedded.explain()
    shuffled = capsys.readouterr().out.split("Exchange")
    assert len(shuffled) == 2 and "MapInArrow" in shuffled[1] and "HashAggregate" not in shuffled[1]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # documents lie in several batches
    found = {r["doc_id"]: r["embedding"] for r in embedded.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: sorted(x for x in v if x) for k, v in found.items()} == {1: [1.0, 7.0], 2: [1.0], 3: [], None: [4.0]}
    assert found[1].index(7.0) == found[None].index(4.0) and found[1].index(1.0) == found[2].index(1.0)
