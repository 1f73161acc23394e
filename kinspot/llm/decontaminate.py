"""Benchmark passages in training documents, by a distributed positional inverted index.

Only DataFrame functions are used. Benchmark items are cut into windows of
``WINDOW`` consecutive words (a shorter item is one window). The document
frequencies of the benchmark's terms are counted over all documents; each
window is led by its rarest term and has a second one to intersect with, and a
window with a term that no document holds is dropped. The index stores the
postings (term, document, position) of these terms. A window is searched by
its rarest term's list, moved back by the term's offset in the window, and
intersected with the second list moved likewise; what is left is compared word
by word with the document.

A document is known by its id and the hash of its text, so rows that share an
id are judged by their own texts, and equal rows get equal results. Null and
empty texts have no words and are clean; null or wordless items have no
windows; items without id are searched but not listed. An empty benchmark
finds nothing, and no documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kinspot.llm.stage import stored

WINDOW = 13
#: fixed by the contract: what lies between words, after A-Z are lower-cased
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS)
    return F.array_remove(cut, "")


def _keyed(docs: DataFrame) -> DataFrame:
    """``id``, ``key`` (hash of the text) and text of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["key"] == right["key"])


@dataclass(frozen=True)
class PositionalIndex:
    """``postings`` (term, id, key, position), the windows they were kept for, and the items of each window."""

    postings: DataFrame
    windows: DataFrame
    items: DataFrame


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item_id``, ``terms``: every window of every item."""
    cut = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    return cut.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("terms"))


def build_index(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> PositionalIndex:
    """Postings of the two rarest terms of every benchmark window that can occur in ``docs``."""
    of_items = stored(item_windows(benchmark, width).distinct(), "item-windows")
    distinct = of_items.select("terms").distinct().withColumn("window", F.monotonically_increasing_id())
    distinct = stored(distinct, "windows")
    terms = distinct.select(F.explode("terms").alias("term")).distinct()
    held = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    frequency = stored(held.join(terms, "term").groupBy("term").agg(F.count("*").alias("documents")), "document-frequencies")

    placed = distinct.select("window", F.size("terms").alias("width"), F.posexplode("terms").alias("offset", "term")).join(frequency, "term")
    ranked = placed.groupBy("window", "width").agg(F.sort_array(F.collect_list(F.struct("documents", "term", "offset"))).alias("r"))  # of one window
    ranked = ranked.filter(F.size("r") == F.col("width"))
    first, others = F.col("r")[0], F.filter("r", lambda x: x["term"] != F.col("r")[0]["term"])
    led = ranked.select("window", first["term"].alias("term"), first["offset"].alias("offset"), F.get(others, F.lit(0)).alias("s"))
    led = led.select("window", "term", "offset", F.col("s.term").alias("second_term"), F.col("s.offset").alias("second_offset"))
    windows = stored(led.join(distinct, "window"), "led-windows")

    leads = windows.select("term").union(windows.select("second_term")).dropna().distinct()
    listed = _keyed(docs).select("id", "key", F.posexplode(words(F.col("text"))).alias("position", "term"))
    postings = stored(listed.join(leads, "term").select("term", "id", "key", "position"), "postings")
    return PositionalIndex(postings, windows, of_items.join(distinct, "terms").select("window", "item_id"))


def _candidates(index: PositionalIndex) -> DataFrame:
    """Places where the two rarest terms of a window stand as far apart as in it: id, key, start, window."""
    led = index.postings.join(index.windows.select("window", "term", "offset", "second_term", "second_offset"), "term")
    led = led.withColumn("start", F.col("position") - F.col("offset")).filter("start >= 0")
    plain = led.filter("second_term IS NULL").select("id", "key", "start", "window")
    led = led.filter("second_term IS NOT NULL").withColumn("second_at", F.col("start") + F.col("second_offset"))
    second = index.postings.select(F.col("term").alias("second_term"), "id", "key", F.col("position").alias("second_at"))
    same = _same_document(led, second) & (led["second_term"] == second["second_term"]) & (led["second_at"] == second["second_at"])
    return led.join(second, same, "left_semi").select("id", "key", "start", "window").union(plain)


def exact_matches(index: PositionalIndex, docs: DataFrame) -> DataFrame:
    """Occurrences of whole windows: id, key, start (words before it), length, window."""
    found = stored(_candidates(index).distinct(), "window-candidates")
    # texts of the documents with candidates only, however many places each has; never a broadcast, as their number
    # grows with the documents (on large inputs Spark sends a Bloom filter ahead of such a shuffle)
    named = found.select("id", "key").distinct().hint("merge")
    texts = _keyed(docs)
    texts = texts.join(named, _same_document(texts, named), "left_semi").dropDuplicates(["id", "key"])
    texts = texts.select("id", "key", words(F.col("text")).alias("w"))
    at = found.join(index.windows.select("window", "terms"), "window")
    both = at.join(texts, _same_document(at, texts)).filter(F.slice("w", F.col("start") + 1, F.size("terms")) == F.col("terms"))
    return stored(both.select(at["id"], at["key"], "start", F.size("terms").alias("length"), "window"), "window-matches")


def near_matches(index: PositionalIndex, within: int) -> DataFrame:
    """Places where the two rarest terms of a window stand within ``within`` words, in any order.

    Returns id, key, window, position and second_position. Positions are
    matched by blocks of ``within`` words and their neighbours, so frequent
    terms of a long document do not meet in all pairs.
    """
    led = index.postings.join(index.windows.filter("second_term IS NOT NULL").select("window", "term", "second_term"), "term")
    led = led.withColumn("block", F.explode(F.array(*(F.floor(F.col("position") / within) + i for i in (-1, 0, 1)))))
    second = index.postings.select(F.col("term").alias("second_term"), "id", "key", F.col("position").alias("second_position"))
    second = second.withColumn("block", F.floor(F.col("second_position") / within))
    same = _same_document(led, second) & (led["second_term"] == second["second_term"]) & (led["block"] == second["block"])
    near = F.abs(led["position"] - second["second_position"]) <= within
    return led.join(second, same & near).select(led["id"], led["key"], "window", "position", "second_position").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Words hit by benchmark windows, the items found, and whether a twentieth of the words or more are hit.

    Returns id, key (hash of the text), n_words, n_hit, n_items, items_sha256
    and contaminated, one row per row of ``docs`` (doc_id, text).
    """
    index = build_index(docs, benchmark, width)
    matches = exact_matches(index, docs)
    hit = matches.select("id", "key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("position"))
    hits = hit.distinct().groupBy("id", "key").agg(F.count("*").alias("n_hit"))
    of_documents = matches.select("id", "key", "window").join(index.items, "window").select("id", "key", "item_id").distinct()
    items = of_documents.groupBy("id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = stored(hits.join(items, _same_document(hits, items)).select(hits["id"], hits["key"], "n_hit", "items"), "contaminated-documents")
    counted = _keyed(docs).select("id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    whole = counted.join(found, _same_document(counted, found), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        counted["id"], counted["key"], "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
