"""Containment of every query's tokens in every row of one sample, without a row for each pair.

The sample's terms are numbered, a block of sampled rows is a list of term
numbers for each row, and blocks of queries meet blocks of the sample on a
grid, as blocks of vectors do in :mod:`kinspot.operators.dense`. Inside the
task a query's terms are looked up in the block's sorted terms and counted by
row. What leaves it is one row for each query and block: the best count, and
the rows that hold enough of the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspot.operators.judge import CONTAINMENT_THRESHOLD, query_words
from kinspot.session import written

#: queries and sampled rows of a block, about, and how often a block is copied at most
BLOCK_QUERIES, BLOCK_SAMPLE, COPIES = 256, 1024, 32
#: what rounding to six places can add to a share
ROUNDED = 1e-6


def _met(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ranks = np.array([r["rank"] for r in row.sample], np.int32)
                sizes = [len(r["terms"]) for r in row.sample]
                terms = np.concatenate([np.asarray(r["terms"], np.int64) for r in row.sample])
                order = np.argsort(terms, kind="stable")
                terms, owner = terms[order], np.repeat(np.arange(len(ranks)), sizes)[order]
                out = []
                for query in row.queries:
                    own = np.asarray(query["terms"], np.int64)
                    low, high = np.searchsorted(terms, own, "left"), np.searchsorted(terms, own, "right")
                    at = np.repeat(high - np.cumsum(high - low), high - low) + np.arange(int((high - low).sum()))
                    shared = np.bincount(owner[at], minlength=len(ranks))
                    enough = np.flatnonzero(shared >= (threshold - ROUNDED) * query["size"]) if query["size"] else []
                    out.append((query["query_id"], int(shared.max()), [{"rank": ranks[i], "n_shared": int(shared[i])} for i in enough]))
                yield pd.DataFrame(out, columns=["query_id", "best", "hits"])

    return run


def sample_verdicts(queries: DataFrame, sample: DataFrame, counts: DataFrame, threshold: float = CONTAINMENT_THRESHOLD) -> DataFrame:
    """``query_id, is_match, confidence, matched_references`` of all ``queries`` against one sample ``(doc_id, rank)``.

    A query matches when one sampled row holds enough of its distinct tokens;
    ``counts`` has one row per document and distinct term. Queries without
    tokens match nothing.
    """
    held = written(sample.select("doc_id", "rank").join(counts.select("doc_id", "term"), "doc_id").where("term IS NOT NULL").select("rank", "term"), "sample_terms")
    numbers = written(held.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "sample_term_numbers")
    rows = held.join(numbers, "term").groupBy("rank").agg(F.collect_list("number").alias("terms"))  # of one document
    asked = query_words(queries).join(numbers, "term", "left").groupBy("query_id").agg(
        F.count("*").alias("size"), F.collect_list("number").alias("terms")  # of one query
    )
    asked = written(asked, "numbered_queries")
    n_sample, n_queries = sample.count(), asked.count()
    sample_blocks, query_blocks = max(1, math.ceil(n_sample / BLOCK_SAMPLE)), max(1, math.ceil(n_queries / BLOCK_QUERIES))
    lanes, groups = min(sample_blocks, COPIES), min(query_blocks, COPIES)
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_sample = rows.groupBy((F.col("rank") % sample_blocks).alias("block")).agg(F.collect_list(F.struct("rank", "terms")).alias("sample"))
    of_queries = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("block")).agg(
        F.collect_list(F.struct("query_id", "size", "terms")).alias("queries")
    )
    of_sample = of_sample.select("sample", (F.col("block") % lanes).cast("int").alias("lane")).withColumn("group", numbered(groups))
    of_queries = of_queries.select("queries", (F.col("block") % groups).cast("int").alias("group")).withColumn("lane", numbered(lanes))
    id_type = queries.schema["query_id"].dataType.simpleString()
    met = of_sample.join(of_queries, ["lane", "group"]).select("sample", "queries").mapInPandas(
        _met(threshold), f"query_id {id_type}, best bigint, hits array<struct<rank:int,n_shared:bigint>>"
    )
    best = met.groupBy("query_id").agg(F.max("best").alias("best"), F.flatten(F.collect_list("hits")).alias("hits"))
    share = lambda n: F.round(F.coalesce(F.try_divide(n, F.col("size")), F.lit(0.0)), 6)
    judged = asked.select("query_id", "size").join(best, "query_id", "left")
    hits = F.filter("hits", lambda h: share(h["n_shared"]) >= threshold)
    verdicts = judged.select(
        "query_id", share(F.coalesce("best", F.lit(0))).alias("confidence"), F.array_sort(F.transform(hits, lambda h: h["rank"])).alias("matched_references")
    )
    return queries.select("query_id").join(verdicts, "query_id", "left").select(
        "query_id",
        F.coalesce(F.col("confidence") >= threshold, F.lit(False)).alias("is_match"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("matched_references", F.array().cast("array<int>")).alias("matched_references"),
    )
