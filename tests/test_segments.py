"""The growing index beside brute force, and what it reads and writes."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from kinspot.operators import segments as sg
from kinspot.plans.growing import grow_indexes, load_growing, tidy_indexes
from kinspot.session import written
from test_sparse import brute_force, zipf_texts

QUERY_TERMS = 6


def table(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} bigint, text string")


def some_queries(rng, n, vocabulary):
    return [(q, " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(QUERY_TERMS))) for q in range(n)]


def found(hits):
    return {(r.query_id, r.doc_id, r["rank"]) for r in hits.collect()}


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """3,000 documents in regions of some 40, so that there is something to leave out."""
    rng, old = random.Random(3), sg.REGION_DOCS
    sg.REGION_DOCS = 40
    docs = zipf_texts(rng, 3000, 60, 800)
    index = sg.add_documents(table(spark, docs).repartition(3), str(tmp_path_factory.mktemp("segments") / "index"))
    yield docs, index
    sg.REGION_DOCS = old


@pytest.mark.parametrize("probe", [1, 4])
def test_topk_equals_brute_force(spark, larger, probe):
    docs, index = larger
    queries = some_queries(random.Random(5), 25, 800) + [(90, "w0 w0 w1"), (91, "nothing known"), (92, ""), (93, None), (94, "w799")]
    got = sg.segmented_topk(index, table(spark, queries, "query_id"), 7, probe_regions=probe)
    assert found(got) == brute_force(docs, [(q, t or "") for q, t in queries], 7)


def test_bounds_hold_at_any_mean_length(spark, larger):
    _, index = larger
    each = index.blocks().select("term", "region", "max_tf", "least_ratio", F.inline("postings"))
    for mean in (1.0, index.avgdl, 500.0):
        true, bound = sg._saturation(F.col("tf"), F.col("dl") / F.col("tf"), mean), sg._saturation(F.col("max_tf"), F.col("least_ratio"), mean)
        assert each.where(true > bound + 1e-12).isEmpty()
    formula = F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / index.avgdl))
    assert each.where(F.abs(formula - sg._saturation(F.col("tf"), F.col("dl") / F.col("tf"), index.avgdl)) > 1e-9).isEmpty()


def scans(df):
    """Metrics of the scans of a finished plan."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            out.append({name: node.metrics().apply(name).value() for name in ("numFiles", "numOutputRows")})
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


def test_few_terms_read_few_lanes_and_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "LANE_POSTINGS", 1_000)
    monkeypatch.setattr(sg, "REGION_DOCS", 20)
    docs = zipf_texts(random.Random(8), 2000, 40, 3000)
    index = sg.add_documents(table(spark, docs), str(tmp_path / "index"))
    every = scans(index.blocks().select("term", "region", "postings"))
    read = {"numFiles": 0, "numOutputRows": 0}
    for q in range(10):
        terms = spark.createDataFrame([(f"w{40 + 7 * q}",), (f"w{900 + q}",), (f"w{2000 + q}",)], "term string")
        for scan in scans(sg._blocks_of(index, terms).select("term", "region", "postings")):
            read = {name: n + scan[name] for name, n in read.items()}
    whole = {name: 10 * sum(s[name] for s in every) for name in read}
    assert whole["numFiles"] > 200 and all(read[name] < whole[name] / 10 for name in read)


def test_regions_out_of_reach_are_not_read(spark, larger, monkeypatch):
    """A query with a rare term leaves most regions of its frequent terms alone."""
    docs, index = larger
    met = []
    scored = sg._region_scores
    monkeypatch.setattr(sg, "_region_scores", lambda i, b, w, a, regions: met.append(regions.count()) or scored(i, b, w, a, regions))
    rare = Counter(w for _, t in docs for w in set(t.split()))
    word = next(w for w, n in sorted(rare.items()) if 12 <= n <= 20)
    queries = [(1, f"w0 w1 {word}")]
    assert found(sg.segmented_topk(index, table(spark, queries, "query_id"), 3)) == brute_force(docs, queries, 3)
    regions = index.blocks().where(F.col("term").isin("w0", "w1", word)).select("region").distinct().count()
    assert sum(met) < regions / 2


def batches():
    rng = random.Random(11)
    first = zipf_texts(rng, 300, 30, 120)
    second = [(i, t + " w3 w3 fresh") for i, t in first[::7]] + [(1000 + i, t) for i, t in zipf_texts(rng, 80, 50, 150)]
    third = [(i, "w1 w2 again") for i, _ in first[::14]] + [(2000, ""), (2001, None)]
    return first, (second, [i for i, _ in first[3::10]] + [77_777]), (third, [1000, 1001, 2000])


def test_batches_equal_one_build(spark, tmp_path):
    path, now = str(tmp_path / "grown"), {}
    queries = some_queries(random.Random(2), 20, 150) + [(50, "fresh again w1")]
    asked = table(spark, queries, "query_id")
    (first, (second, gone), (third, gone_too)) = batches()
    for rows, removed in ((first, []), (second, gone), (third, gone_too)):
        # ids that a batch both removes and brings stay
        now = {i: t for i, t in now.items() if i not in removed} | dict(rows)
        index = sg.add_documents(table(spark, rows), path, table(spark, [(i, "") for i in removed]).select("doc_id"))
        docs = [(i, t or "") for i, t in now.items()]
        assert (index.n, index.tokens) == (len(now), sum(len(t.split()) for _, t in docs))
        assert found(sg.segmented_topk(index, asked, 6)) == brute_force(docs, queries, 6)
    loaded = sg.load_segments(spark, path)
    assert loaded == index and len(loaded.segments) == 3
    df = Counter(w for t in now.values() for w in set((t or "").split()))
    assert {r.term: r.df for r in loaded.term_stats().collect()} == df and loaded.n_terms == len(df)
    some = sg.merge_segments(spark, path, [s.name for s in loaded.segments[:2]])
    assert len(some.segments) == 2 and found(sg.segmented_topk(some, asked, 6)) == brute_force(docs, queries, 6)
    one = sg.merge_segments(spark, path)
    assert len(one.segments) == 1 and one.marks == () and one.segments[0].docs == len(now)
    assert found(sg.segmented_topk(one, asked, 6)) == brute_force(docs, queries, 6)
    assert math.isclose(one.avg_idf, loaded.avg_idf) and one.n_terms == loaded.n_terms


def test_a_batch_costs_what_the_batch_holds(spark, tmp_path):
    path = str(tmp_path / "grown")
    sg.add_documents(table(spark, zipf_texts(random.Random(1), 2000, 40, 400)), path)
    index = sg.add_documents(table(spark, [(5, "w1 w2"), (9000, "w3")]), path)
    old, new = (spark.read.parquet(f"{path}/segments/{s.name}/blocks").select(F.size("postings").alias("n")).agg(F.sum("n")).first()[0] for s in index.segments)
    assert new == 3 and old > 10_000
    marks = f"{path}/marks/{index.marks[0]}"
    assert spark.read.parquet(f"{marks}/gone").count() == 1 and spark.read.parquet(f"{marks}/lost").count() < 41


def test_a_batch_reads_only_lanes_of_documents_that_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "LANE_DOCS", 50)
    path = str(tmp_path / "grown")
    index = sg.add_documents(table(spark, zipf_texts(random.Random(1), 2000, 10, 400)), path)
    asked = []
    forward = sg.SegmentedIndex.forward
    monkeypatch.setattr(sg.SegmentedIndex, "forward", lambda self, lanes=None: asked.append(lanes) or forward(self, lanes))
    sg.add_documents(table(spark, [(5, "w1 w2"), (9, "w3"), (9000, "w4")]), path)
    assert index.segments[0].doc_lanes >= 32 and [len(v) for v in asked[0].values()] in ([1], [2])


def test_second_writer_of_a_version_fails(spark, tmp_path):
    path = str(tmp_path / "grown")
    index = sg.add_documents(table(spark, [(1, "a b")]), path)
    sg.add_documents(table(spark, [(2, "a c")]), path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sg._commit(index)
    with pytest.raises(ValueError, match="not unique"):
        sg.add_documents(table(spark, [(3, "a"), (3, "b")]), path)


def test_empty_batches_and_string_ids(spark, tmp_path):
    path = str(tmp_path / "none")
    none = sg.add_documents(table(spark, []), path)
    asked = table(spark, [(1, "a b")], "query_id")
    assert none.n == 0 and sg.segmented_topk(none, asked, 3).count() == 0
    index = sg.add_documents(table(spark, [(1, "a b"), (2, "")]), path)
    assert found(sg.segmented_topk(index, asked, 3)) == {(1, 1, 1)}
    gone = sg.add_documents(table(spark, []), path, table(spark, [(1, ""), (2, "")]))
    assert gone.n == 0 and sg.segmented_topk(gone, asked, 3).count() == 0
    named = sg.add_documents(spark.createDataFrame([("x", "a b"), ("y", "a")], "doc_id string, text string"), str(tmp_path / "named"))
    assert {(r.doc_id, r["rank"]) for r in sg.segmented_topk(named, asked, 3).collect()} == {("x", 1), ("y", 2)}


def test_growing_index_serves_sparse_and_dense(spark, tmp_path):
    path, calls = str(tmp_path / "both"), spark.sparkContext.accumulator(0)

    def letters(texts):
        calls.add(len(texts))
        return [[float(t.count(c)) + 0.01 for c in "abcde"] for t in texts]

    grow_indexes(table(spark, [(i, f"a{'b' * i} x{i}") for i in range(30)]), path, embed=letters)
    assert calls.value == 30
    grow_indexes(table(spark, [(3, "dd dd"), (40, "cc cc cc")]), path, removed=table(spark, [(4, "")]), embed=letters)
    assert calls.value == 32
    index = load_growing(spark, path, embed=letters)
    assert sorted(r.doc_id for r in index.dense.collect()) == sorted({*range(30), 40} - {4})
    asked = table(spark, [(1, "dd"), (2, "cc"), (3, "x4 x7")], "query_id")
    best = {r.query_id: r.doc_id for r in index.dense_hits(asked, 1).collect()}
    assert best[1] == 3 and best[2] == 40
    assert {r.doc_id for r in index.sparse_hits(asked, 5).where("query_id = 3").collect()} == {7}
    before = found(index.hybrid_hits(asked, 4))
    grow_indexes(table(spark, [(50, "ee")]), path, embed=letters)
    tidy = tidy_indexes(spark, path, most=2, embed=letters)
    assert len(tidy.sparse.segments) == 2 and found(tidy.hybrid_hits(asked.where("query_id < 3"), 4)) >= {b for b in before if b[0] < 3 and b[2] == 1}
    assert sorted(r.doc_id for r in tidy.dense.collect()) == sorted({*range(30), 40, 50} - {4})


def test_a_region_gives_a_query_its_best_documents_only(spark, larger, tmp_path, monkeypatch):
    _, index = larger
    made, write = {}, sg.written
    monkeypatch.setattr(sg, "written", lambda df, name, path=None: made.update({name: write(df, name, path)}) or made[name])
    queries = [(q, f"w0 w1 w{q}") for q in range(8)]
    hits = sg.segmented_topk(index, table(spark, queries, "query_id"), 2, probe_regions=3).count()
    held = {r.region: r.n for r in index.blocks().where("term = 'w0'").select("region", "n").collect()}
    assert hits == 16 and max(held.values()) > 10
    assert 0 < made["probe_scores"].count() < 8 * 3 * 6  # not every document with a word that is in all of them

    monkeypatch.setattr(sg, "SLOT_QUERIES", 3)
    docs = [(i, f"a {'b ' * (i % 5)}c{i % 7}") for i in range(300)]
    sg.add_documents(table(spark, docs), str(tmp_path / "i"))
    grown = sg.add_documents(table(spark, [(i, "d") for i in range(0, 300, 3)]), str(tmp_path / "i"), removed=table(spark, [(7, "")]))
    now = [(i, "d" if i % 3 == 0 else t) for i, t in docs if i != 7]
    asked = [(q, f"a b b c{q} d") for q in range(9)]
    assert found(sg.segmented_topk(grown, table(spark, asked, "query_id"), 5)) == brute_force(now, asked, 5)


def test_a_batch_is_tokenised_once(spark, tmp_path, monkeypatch):
    """Vectors come from the counted terms, and are those of the texts."""
    from kinspot.operators.embedding import hash_embed_text
    from kinspot.plans import growing

    docs = table(spark, [(i, t) for i, t in zipf_texts(random.Random(5), 40, 30, 200)] + [(100, ""), (101, None), (102, " a a é 中")])

    def fail(*_, **__):
        raise AssertionError("texts are tokenised again")

    monkeypatch.setattr(growing, "hash_embed_text", fail)
    index = grow_indexes(docs, str(tmp_path / "index"))
    want = growing.build_dense_index(hash_embed_text(docs), dim=index.dim)
    assert sorted(map(tuple, index.dense.collect())) == sorted(map(tuple, want.collect()))


def test_documents_are_written_by_tasks_of_few_postings(spark, tmp_path, monkeypatch):
    """One task for 50,000 documents held tens of millions of postings, and so did each that read its file."""
    monkeypatch.setattr(sg, "TASK_POSTINGS", 1_000)
    index = sg.add_documents(table(spark, zipf_texts(random.Random(6), 200, 60, 800)), str(tmp_path / "index"))
    root = tmp_path / "index" / "segments" / index.segments[0].name
    assert len(list((root / "forward").rglob("*.parquet"))) > 4
    blocks = index.blocks().selectExpr("sum(n) AS n", "sum(size(postings)) AS held", "count_if(max_tf != array_max(transform(postings, x -> x.tf))) AS wrong").first()
    assert blocks["n"] == blocks["held"] == index.forward().selectExpr("sum(size(terms))").first()[0] and blocks["wrong"] == 0


def test_texts_are_moved_and_terms_are_written_once(spark, tmp_path, monkeypatch, capsys):
    """Terms lay in a table of their own, went through a sampled sort to the forward table, and their postings through shuffles as rows."""
    made, plans, write = [], [], DataFrameWriter.parquet

    def parquet(self, path, *args, **options):
        self._df.explain()
        plans.append((path.rsplit("/", 1)[-1], capsys.readouterr().out))
        return write(self, path, *args, **options)

    monkeypatch.setattr(sg, "written", lambda df, name, path=None: made.append(name) or written(df, name, path))
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(sg, "TASK_POSTINGS", 1_000)
    path = str(tmp_path / "index")
    sg.add_documents(table(spark, zipf_texts(random.Random(6), 200, 60, 800)), path)
    sg.add_documents(table(spark, [(5, "w1 w2")]), path)
    sg.merge_segments(spark, path)
    assert not {"document_terms", "merged"} & set(made)
    plan = dict(plans[:2])
    assert set(plan) == {"forward", "docs"} and "rangepartitioning" not in plan["forward"]
    assert plan["forward"].index("MapInArrow") < plan["forward"].index("Exchange")  # above it
    blocks = next(text for name, text in plans if name == "blocks")
    assert blocks.index("arrays_zip") < blocks.index("Exchange")


def test_unit_vectors_of_terms_are_those_of_their_counts(spark):
    from kinspot.operators.dense import build_dense_index
    from kinspot.operators.embedding import hash_embed, hash_unit_terms

    rows = [(1, 9, ["a", "é", "w7"], [7, 1, 1]), (2, 0, [], []), (3, 2, ["中"], [2]), (4, 3, ["b", "a"], [1, 2])]
    nested = spark.createDataFrame(rows, "doc_id bigint, dl int, terms array<string>, tfs array<bigint>").coalesce(1)
    pairs = nested.select("doc_id", "dl", F.inline_outer(F.arrays_zip("terms", "tfs"))).toDF("doc_id", "dl", "term", "tf")
    for dim in (3, 256):
        want = build_dense_index(hash_embed(pairs.fillna({"tf": 0}), dim), dim=dim)
        assert sorted(map(tuple, hash_unit_terms(nested, dim).collect())) == sorted(map(tuple, want.collect()))
