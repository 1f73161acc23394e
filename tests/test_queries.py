"""Every query of the library against its SQL, and the shape of its plan; tests/llm has those of the optional part."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    ok, note = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 40 and sum(r.is_match for r in rows) > 0


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_topk_cuts_before_the_shuffle(spark, sf_dir):
    from checks.data import test_data
    from kinspot.operators.dense import dense_topk
    from kinspot.operators.sparse import sparse_topk

    d = test_data(spark, sf_dir)
    for hits in (
        sparse_topk(d.index.sparse, d.queries, 5),
        dense_topk(d.vectors, d.vectors.withColumnRenamed("doc_id", "query_id"), 5),
    ):
        assert "WindowGroupLimit" in plan(hits)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["filter_optional"](spark, sf_dir))
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "c_nationkey" not in text.split("ReadSchema: ")[1].split("\n")[0]
