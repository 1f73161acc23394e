"""Registered queries beside their SQL, classifiers on held-out labels, and the pipeline stage by stage."""

from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from kinspot.llm import quality, toxicity
from kinspot.llm.labelled import held_out, training_labels
from kinspot.llm.oracles import ORACLES
from kinspot.llm.queries import QUERIES

from . import cases

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    ok, note = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.fixture(scope="module")
def larger():
    if not Path(LARGER).is_dir():
        pytest.skip("larger test tables are not here")
    return LARGER


def on_held_out(spark, folder, name, label):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES[name](spark, folder).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((rows.score >= 0) & (rows.score <= 1)).all()
    return rows.predicted[rows[label] == 1].mean(), rows.predicted[rows[label] == 0].mean()


def test_toxicity_on_held_out_labels(spark, larger):
    caught, wronged = on_held_out(spark, larger, "op3_toxicity", "toxic")
    assert caught > 0.8 and wronged < 0.02


def test_quality_on_held_out_labels(spark, larger):
    caught, wronged = on_held_out(spark, larger, "op6_quality", "quality")
    assert caught > 0.97 and wronged < 0.03


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_which_labels_are_learnt(spark):
    import zlib

    rows = [(i, i % 2, None if i == 5 else (i // 2) % 2) for i in range(60)] + [(None, 1, 1), (8, 1, 1)]
    got = {r.doc_id: r.label for r in training_labels(labelled(spark, rows), "toxic").collect()}
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1 and i != 5]
    assert got == {i: 1 if i == 8 and 8 in free else (i // 2) % 2 for i in free}
    ids = spark.createDataFrame([(i,) for i in (1, 2, None)], "doc_id long")
    assert [r.h for r in ids.select(held_out(F.col("doc_id")).alias("h")).collect()] == [zlib.crc32(b"1") % 3 == 1, zlib.crc32(b"2") % 3 == 1, False]


@pytest.mark.parametrize("labels", [[], [(i, 1, 0) for i in range(20)], [(i, i % 2, i % 2) for i in range(20)]])
def test_classifiers_of_odd_cases(spark, labels):
    """No labels, labels of one kind, few labels: every row gets one score, equal texts the same."""
    table, known = cases.docs(spark).drop("score"), labelled(spark, labels)
    for judge in (toxicity.toxicity, quality.quality):
        rows = judge(table, known).collect()
        assert len(rows) == len(cases.DOCS) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1 and judge(cases.empty(spark), known).count() == 0
    model = toxicity.train_toxicity(table, known)
    assert toxicity.score_toxicity(cases.docs(spark), model).columns == [*cases.docs(spark).columns, "toxicity_score"]


def test_thresholds_come_from_the_whole_calibration_fold(spark, monkeypatch):
    """Many times the sample, documents over TRAIN_WORDS included."""
    monkeypatch.setattr(toxicity, "PER_CLASS", 60)
    rng = np.random.default_rng(8)
    calm, rude, rows = [f"calm{i}" for i in range(60)], [f"rude{i}" for i in range(6)], []
    for i in range(3000):
        words = list(rng.choice(calm, 20 if i % 30 else toxicity.TRAIN_WORDS + 1))
        if rng.random() < (0.8 if i % 2 else 0.03):
            words[5] = rng.choice(rude)
        rows.append((i, "the and of " + " ".join(words), i % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.train_toxicity(table.drop("toxic"), table.select("doc_id", "toxic"))
    fold = table.filter((F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0) & ~held_out(F.col("doc_id"))).toPandas()
    scores = np.concatenate([model.net.probability(w, s) for _, _, w, s in toxicity._codes(pa.array(fold["text"]))])
    bins, at = np.unique(np.floor(scores * toxicity.BINS + 0.5), return_inverse=True)
    y = fold["toxic"].to_numpy()
    clean, toxic = np.bincount(at, y == 0, len(bins)), np.bincount(at, y == 1, len(bins))
    want = np.clip(toxicity.best_threshold(bins, clean, toxic), toxicity.LOWEST, toxicity.HIGHEST)
    assert len(fold) > 300 and (fold["text"].str.count(" ") > toxicity.TRAIN_WORDS).sum() > 5
    assert abs(model.thresholds[1] - want) < 2 / toxicity.BINS
    assert (scores[y == 0] >= model.thresholds[1]).mean() <= toxicity.WRONGED


def test_isotonic_is_the_nearest_monotone_fit():
    rng = np.random.default_rng(2)
    for _ in range(20):
        v, w = rng.random(6), rng.integers(1, 5, 6).astype(float)
        got = quality.isotonic(v, w)
        assert (np.diff(got) >= 0).all()
        best = min(((w * (v - np.sort(c)) ** 2).sum() for c in rng.random((4000, 6))), default=0)
        assert (w * (v - got) ** 2).sum() <= best + 1e-9


# --- pipeline ------------------------------------------------------------------------


def test_pipeline_stages_on_the_test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = texts(docs)
    outs = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        outs[name], docs = (texts(docs), texts(out)), out
    kept, after = outs["toxicity"]
    assert after.items() <= kept.items() and kept == before
    had, left = outs["near_duplicates"]
    labels = cases.near_duplicates(list(had.items()), 5, 80)
    assert left == {i: t for i, t in had.items() if labels[i][1] == i}
    had, left = outs["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = dict(zip(had, cases.contamination(list(had.items()), items)))
    assert left == {i: t for i, t in had.items() if not judged[i][4]} and len(left) < len(had)
    had, left = outs["secrets"]
    assert left.keys() == had.keys() and not any(cases.base_spans(t) for t in left.values())
    assert all(left[i] == t for i, t in had.items() if not cases.base_spans(t) and "[SECRET]" not in left[i])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == left.keys() and all(r.n == r["all"] for r in pieces)


@pytest.mark.parametrize("rows", [cases.DOCS, []])
def test_pipeline_stages_on_odd_cases(spark, sf_dir, rows):
    table = cases.docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf_dir)
        n = out.count()
        assert name == "packing" or out.columns == table.columns
        assert n == 0 if not rows else n > 0
        if rows and name == "near_duplicates":
            ids = [r.doc_id for r in out.collect()]
            assert ids.count(None) == 2 and ids.count(1) == 1 and 7 not in ids and 9 not in ids and {2, 3, 4, 5, 8} <= set(ids)
        if rows and name == "secrets":
            assert n == len(rows)


def test_duplicates_stage_keeps_texts_of_one_id_apart(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, "another clean text of the same id"), (2, long + " end"), (3, "clean"), (3, "clean"), (3, "other"), (4, None), (4, ""), (None, long), (None, long)]
    out = corpus_pipeline.drop_near_duplicates(spark, cases.docs(spark, rows).selectExpr("*", "1 AS place", "2 AS text_key", "3 AS judged_id"), sf_dir)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, long), (1, rows[1][1]), (3, "clean"), (3, "other"), (4, None), (4, ""), (None, long), (None, long)], key=str)


def test_toxicity_stage_keeps_a_column_of_the_scores_name(spark, sf_dir):
    table = cases.docs(spark).selectExpr("*", "'mine' AS toxicity_score", "1 AS own_score")
    out = corpus_pipeline.drop_toxic(spark, table, sf_dir)
    assert out.columns == table.columns and {r.toxicity_score for r in out.collect()} == {"mine"}


def test_registered_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
