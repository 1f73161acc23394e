"""One registered query per operator, each over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.data import FUNCTION, METHOD, TestData, fill, test_data
from kinspot.functions.text import (
    path_tail,
    strip_fences,
    token_jaccard,
    token_jaccards,
    tokenize,
    whitespace_tokens,
)
from kinspot.functions.vectors import as_vector, cosine, l2_normalize
from kinspot.operators import evaluate as ev
from kinspot.operators import labelset as ls
from kinspot.operators import replay as rp
from kinspot.operators import transcript as tr
from kinspot.operators.corpus import token_band
from kinspot.operators.dense import build_dense_index, max_corpus_similarity, unsound_vectors
from kinspot.operators.dense import dense_topk as topk_by_blocks
from kinspot.operators.embedding import TASK_DOCS, embed_column, embed_missing, hash_embed_text, hashed_counts, missing_embeddings
from kinspot.operators.fusion import hydrate, match_records, rrf_topk_sweep
from kinspot.operators.judge import build_prompts, judge_containment, pair_containment, parse_verdicts, sample_rows
from kinspot.operators.answers import answer_key, answer_table, ask_once
from kinspot.operators.rounds import candidate_rounds as run_rounds
from kinspot.operators.regions import build_regions, region_search
from kinspot.operators.segments import segmented_topk
from kinspot.operators.timeline import tables_as_of as tables_at
from kinspot.operators.sparse import bm25_score_pairs, term_counts
from kinspot.plans import detectors as dt
from kinspot.plans import evaluation as pe
from kinspot.plans.growing import grow_indexes
from kinspot.plans.indexing import build_indexes, index_sizes, load_indexes
from kinspot.session import new_path, written
from kinspot.sources import tables as tb
from kinspot.sources.changed_files import scan_changed_files as scan_changed
from kinspot.sources.code_files import extract_functions, scan_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[TestData], DataFrame]) -> Callable[[TestData], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(test_data(spark, sf_dir))
    return build


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def joined(c: Column | str, sep: str = " ") -> Column:
    return F.array_join(c, sep)


# --- sources, sinks, corpus ---------------------------------------------------------


@query
def corpus_roundtrip(d: TestData) -> DataFrame:
    path = new_path(d.spark, "corpus")
    tb.write_corpus(d.documents, path)
    back = tb.read_corpus(d.spark, path, schema="doc_id bigint, text string, lang string, source string, n_chars bigint")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query
def corpus_csv_roundtrip(d: TestData) -> DataFrame:
    path = new_path(d.spark, "corpus_csv")
    tb.write_corpus(d.documents, path, "csv")
    back = tb.read_corpus(
        d.spark, path, "csv", "doc_id bigint, text string, lang string, source string, n_chars bigint"
    )
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query
def label_counts(d: TestData) -> DataFrame:
    path = new_path(d.spark, "labelled")
    cases = d.table("labels").join(d.documents, "doc_id").select(
        F.col("text").alias("code"), F.col("quality").alias("label")
    )
    tb.write_labelled(cases, path)
    return tb.label_counts(tb.read_labelled(d.spark, path))


@query
def metrics_csv_roundtrip(d: TestData) -> DataFrame:
    path = new_path(d.spark, "metrics")
    tb.write_metrics(ev.metrics(d.label_predictions, "method"), path)
    schema = "method string, accuracy double, precision double, recall double, f1 double"
    return d.spark.read.schema(schema).option("header", True).csv(path)


@query
def embed_missing_only(d: TestData) -> DataFrame:
    labelled = d.documents.join(d.table("labels"), "doc_id")
    known = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("old "), "text"))
    stored = labelled.select("doc_id", F.sha2(known, 256).alias("text_hash"))
    return missing_embeddings(d.documents, stored).select("doc_id")


def _letter_counts(texts: list[str]) -> list[list[float]]:
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


@query
def embed_incremental(d: TestData) -> DataFrame:
    path = new_path(d.spark, "embeddings")
    old = d.documents.join(d.table("labels"), "doc_id", "left_semi")
    embed_missing(old, path, _letter_counts)
    current = embed_missing(d.documents, path, _letter_counts)
    return current.select("doc_id", *[F.col("embedding")[i].alias(f"n_{c}") for i, c in enumerate("aeiou")])


@query
def extract_functions_from_modules(d: TestData) -> DataFrame:
    return extract_functions(d.modules).select("id", "code", "file_path", "function_name", "token_count")


@query
def scan_source_files(d: TestData) -> DataFrame:
    path = new_path(d.spark, "sources")
    _write_modules(d.modules, f"{path}/deep/er", 64)
    return extract_functions(scan_files(d.spark, path)).select("code", "function_name", "token_count")


#: modules of one source file, about and at most; a parser holds the tree of a whole file
FILE_MODULES = 1250


def _write_modules(modules: DataFrame, path: str, files: int) -> None:
    """Modules as ``files`` source files or more, of several modules each; one line per row keeps the text as it is."""
    files = max(files, -(-modules.count() // FILE_MODULES))
    lines = modules.repartition(files, "p_partkey").select(F.explode(F.split("content", "\n")).alias("line"))
    (
        lines.write.mode("overwrite").option("extension", "py").option("sep", "\x01").option("quote", "\x02").option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


@query
def scan_changed_files(d: TestData) -> DataFrame:
    """A second scan after half of the files were written anew with other modules, of other sizes."""
    path, store = new_path(d.spark, "sources"), new_path(d.spark, "parsed")
    _write_modules(d.modules, f"{path}/one", 16)
    _write_modules(d.modules.select("p_partkey", F.replace("content", F.lit("total"), F.lit("amount")).alias("content")), f"{path}/two", 16)
    scan_changed(d.spark, path, store).count()
    renamed = d.modules.select("p_partkey", F.replace("content", F.lit("make_"), F.lit("build_up_")).alias("content"))
    _write_modules(renamed, f"{path}/two", 12)
    return scan_changed(d.spark, path, store).select("code", "function_name", "token_count")


@query
def token_band_filter(d: TestData) -> DataFrame:
    return token_band(d.documents.select("doc_id", "text")).select("doc_id", "token_count")


@query
def corpus_union(d: TestData) -> DataFrame:
    docs = d.documents.select(F.lit("documents").alias("part"), F.col("doc_id").alias("key"), "text")
    items = d.table("benchmark").select(F.lit("benchmark").alias("part"), F.col("item_id").alias("key"), "text")
    return tb.union_corpora(docs, items).select("part", "key", F.md5("text").alias("text_md5"))


@query
def tokenize_text(d: TestData) -> DataFrame:
    tokens = d.documents.select("doc_id", tokenize("text").alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.md5(joined("t")).alias("tokens_md5"))


@query
def whitespace_words(d: TestData) -> DataFrame:
    words = d.documents.select("doc_id", whitespace_tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_words"), F.md5(joined(F.array_sort("w"))).alias("words_md5"))


@query
def strip_code_fences(d: TestData) -> DataFrame:
    fenced = d.documents.select(
        "doc_id", F.concat(F.lit(" \n```json\n"), "text", F.lit("\n``` \n```python x```\t")).alias("t")
    )
    return fenced.select("doc_id", F.md5(strip_fences("t")).alias("text_md5"))


@query
def url_tail(d: TestData) -> DataFrame:
    return d.table("pages").select(
        "page_id",
        path_tail("url").alias("tail"),
        path_tail(F.concat("url", F.lit(".git//"))).alias("repo_tail"),
    )


# --- embeddings and vectors ---------------------------------------------------------


def _long(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    return vectors.select(key, F.posexplode(vec).alias("bucket", "value")).where(F.col("value") != 0)


@query
def hash_embed(d: TestData) -> DataFrame:
    hashed = hashed_counts(term_counts(d.documents))
    return hashed.where(F.col("bucket").isNotNull()).select("doc_id", "bucket", "value")


@query
def hash_embed_vectors(d: TestData) -> DataFrame:
    long = _long(hash_embed_text(d.queries, "query_id"), "doc_id", "embedding")
    return long.select(F.col("doc_id").alias("query_id"), "bucket", F.col("value").cast("bigint").alias("value"))


@query
def embed_batch(d: TestData) -> DataFrame:
    embedded = embed_column(d.documents, _letter_counts)
    return embedded.select("doc_id", *[F.col("embedding")[i].alias(f"n_{c}") for i, c in enumerate("aeiou")])


@query
def l2_normalize_vectors(d: TestData) -> DataFrame:
    scaled = d.unit_embeddings.select("vec_id", F.transform("v", lambda x: x * 3 + 1).alias("v"))
    unit = scaled.select("vec_id", l2_normalize(F.col("v")).alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("pos", "x")).select("vec_id", "pos", r6("x").alias("x"))


@query
def cosine_pairs(d: TestData) -> DataFrame:
    left = d.unit_embeddings.select("vec_id", F.col("v").alias("a"))
    right = d.unit_embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"))
    return left.join(right, "vec_id").select("vec_id", r6(cosine(F.col("a"), F.col("b"))).alias("similarity"))


@query
def max_similarity_to_corpus(d: TestData) -> DataFrame:
    items = d.vectors.withColumnRenamed("doc_id", "query_id")
    return max_corpus_similarity(d.vectors, items, exclude_self=True)


@query
def dense_index(d: TestData) -> DataFrame:
    return _long(d.index.dense, "doc_id", "unit_vec").select("doc_id", "bucket", r6("value").alias("value"))


@query
def build_all_indexes(d: TestData) -> DataFrame:
    return index_sizes(d.index)


# --- sparse index and retrieval -------------------------------------------------------


@query
def bm25_postings(d: TestData) -> DataFrame:
    p = d.index.sparse.postings
    return p.select("term", "doc_id", "tf", "dl", r6("saturation").alias("saturation"))


@query
def bm25_term_stats(d: TestData) -> DataFrame:
    t = d.index.sparse.term_stats
    return t.select("term", "df", r6("idf").alias("idf"), r6("max_saturation").alias("max_saturation"))


@query
def bm25_corpus_stats(d: TestData) -> DataFrame:
    return d.index.sparse.corpus_stats.select("n", r6("avgdl").alias("avgdl"), r6("avg_idf").alias("avg_idf"), "n_terms")


@query
def bm25_doc_stats(d: TestData) -> DataFrame:
    return d.index.sparse.doc_stats


@query
def bm25_rescore_pairs(d: TestData) -> DataFrame:
    return bm25_score_pairs(d.index.sparse, d.queries, d.dense)


@query
def dense_topk(d: TestData) -> DataFrame:
    return d.neighbours


@query
def dense_topk_regions(d: TestData) -> DataFrame:
    items = d.vectors.withColumnRenamed("doc_id", "query_id")
    return region_search(build_regions(d.vectors), items, d.K, exclude_self=True).hits


@query
def dense_topk_regions_text(d: TestData) -> DataFrame:
    return region_search(build_regions(d.index.dense), d.index.embed_queries(d.queries), 2 * d.K).hits


@query
def dense_topk_ragged(d: TestData) -> DataFrame:
    """Vectors of two other lengths, empty ones and nulls among the embeddings are left out."""
    length = F.when(F.col("vec_id") % 7 == 0, 63).when(F.col("vec_id") % 11 == 0, 1).when(F.col("vec_id") % 13 == 0, 0).otherwise(64)
    cut = F.when(F.col("vec_id") % 17 != 0, F.slice(as_vector("embedding"), F.lit(1), length))
    index = build_dense_index(d.embeddings.select("vec_id", cut.alias("embedding")), "vec_id")
    return topk_by_blocks(index, d.vectors.withColumnRenamed("doc_id", "query_id"), d.K)


@query
def unsound_embeddings(d: TestData) -> DataFrame:
    length = F.when(F.col("vec_id") % 7 == 0, 63).when(F.col("vec_id") % 13 == 0, 0).otherwise(64)
    vector = F.transform(F.slice(as_vector("embedding"), F.lit(1), length), lambda x: F.when(F.col("vec_id") % 19 != 0, x))
    return unsound_vectors(d.embeddings.select("vec_id", F.when(F.col("vec_id") % 17 != 0, vector).alias("embedding")), "vec_id")


@query
def dense_topk_text(d: TestData) -> DataFrame:
    return d.dense


@query
def sparse_topk(d: TestData) -> DataFrame:
    return d.sparse


@query
def sparse_topk_thresholds(d: TestData) -> DataFrame:
    from kinspot.operators.sparse import sparse_topk as topk

    return topk(d.index.sparse, d.queries, d.K, probe_rows=50)


@query
def sparse_topk_blocks(d: TestData) -> DataFrame:
    return segmented_topk(d.segments, d.queries, d.K)


@query
def index_grow(d: TestData) -> DataFrame:
    """Three batches: some documents come later, some texts change once or twice, foreign ids come and go."""
    path = new_path(d.spark, "growing")
    docs = d.documents.select("doc_id", "text", "lang")
    foreign = docs.where("doc_id % 4 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.reverse("text").alias("text"))
    first = docs.where("doc_id % 3 <> 2").select("doc_id", "text").unionByName(foreign)
    grow_indexes(first, path)
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    second = docs.where("doc_id % 3 = 2 OR doc_id % 5 = 0").select("doc_id", changed.alias("text"))
    grow_indexes(second, path, removed=foreign.select("doc_id"))
    again = F.concat("text", F.lit(" "), "lang")
    grown = grow_indexes(docs.where("doc_id % 7 = 0").select("doc_id", again.alias("text")), path)
    sparse, dense = grown.sparse_hits(d.queries, d.K), grown.dense_hits(d.queries, d.K)
    return sparse.withColumn("kind", F.lit("sparse")).unionByName(dense.withColumn("kind", F.lit("dense")))


@query
def hybrid_rrf_topk(d: TestData) -> DataFrame:
    return dt.rrf_topk(d.dense, d.sparse, d.K)


@query
def hydrate_hits(d: TestData) -> DataFrame:
    return hydrate(d.sparse, d.documents, "lang", "source").select("query_id", "rank", "doc_id", "lang", "source", "score")


def _matches_text(c: str) -> Column:
    one = lambda m: F.concat_ws(":", m["rank"].cast("string"), m["doc_id"].cast("string"))
    return joined(F.transform(c, one))


@query
def match_record_lists(d: TestData) -> DataFrame:
    hits = hydrate(d.hybrid, d.documents, "lang")
    found = match_records(hits, "lang")
    return found.select(
        "query_id", _matches_text("matches").alias("matches"), joined(F.col("matches.lang")).alias("langs")
    )


# --- detection ----------------------------------------------------------------------


def _flat(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "query_id", "method", "is_match", r6("confidence").alias("confidence"), "context_size",
        joined(F.transform("matched_references", lambda x: x.cast("string"))).alias("matched_references"), "error",
        _matches_text("matches").alias("matches"),
    )


@query
def detect_threshold(d: TestData) -> DataFrame:
    items = d.vectors.select(F.col("doc_id").alias("query_id"))
    found = dt.detect_threshold(items, d.neighbours, threshold=0.45)
    return found.withColumn("matches", _matches_text("matches"))


@query
def detect_threshold_text(d: TestData) -> DataFrame:
    return dt.detect_threshold(d.queries, d.dense).withColumn("matches", _matches_text("matches"))


@query
def detect_sampled_context(d: TestData) -> DataFrame:
    return _flat(dt.detect_sampled_context(d.index, d.queries, n=100))


@query
def detect_dense_context(d: TestData) -> DataFrame:
    return _flat(dt.judge_contexts(d.index, d.queries, d.dense.where(F.col("rank") <= 5), "dense_context"))


@query
def detect_hybrid_context(d: TestData) -> DataFrame:
    return _flat(dt.detect_hybrid_context(d.index, d.queries))


@query
def build_judge_prompts(d: TestData) -> DataFrame:
    contexts = d.hybrid.join(d.documents.select("doc_id", "text"), "doc_id")
    prompts = build_prompts(d.queries, contexts)
    return prompts.select("query_id", "context_size", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query
def judge_by_containment(d: TestData) -> DataFrame:
    return pair_containment(d.queries, d.hybrid.select("query_id", "doc_id", "rank"), d.index.sparse.postings)


@query
def parse_judge_answers(d: TestData) -> DataFrame:
    n = F.col("doc_id").cast("string")
    good = F.concat(
        F.lit('{"is_plagiarized": true, "confidence": 0.'), n,
        F.lit(', "matched_references": [1, '), n, F.lit('], "explanation": "copy of '), n, F.lit('"}'),
    )
    kind = F.col("doc_id") % 12
    refs_of = lambda refs: F.lit(f'{{"is_plagiarized": true, "confidence": 0.5, "matched_references": {refs}, "explanation": "s"}}')
    response = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == 1, good)
        .when(kind == 2, F.col("text"))
        .when(kind == 3, F.lit('{"is_plagiarized": true}'))
        .when(kind == 4, F.lit('{"is_plagiarized": "yes", "confidence": 1.0, "explanation": "x"}'))
        .when(kind == 5, F.lit(' {"is_plagiarized": false, "confidence": 0.25, "explanation": "none"} '))
        .when(kind == 6, refs_of('["1", "2"]'))
        .when(kind == 7, refs_of('"1, 2"'))
        .when(kind == 8, refs_of("[1.0, 2.0]"))
        .when(kind == 9, F.lit('{"is_plagiarized": true, "confidence": "0.9", "explanation": "s"}'))
        .when(kind == 10, F.concat(good, F.lit(" I hope this helps.")))
        .otherwise(F.lit("[1]"))
    )
    parsed = parse_verdicts(d.documents.select("doc_id", response.alias("response")))
    refs = joined(F.transform("matched_references", lambda x: x.cast("string")))
    return parsed.withColumn("matched_references", refs)


def _verbatim_judge(prompts: list[str]) -> list[str]:
    answers = []
    for prompt in prompts:
        asked, references = prompt.split("\n\nREFERENCE CODES:\n", 1)
        text = asked.split("QUERY CODE:\n```python\n", 1)[1].rsplit("\n```", 1)[0]
        held = [i + 1 for i, ref in enumerate(references.split("\n\n---\n\n")) if text in ref]
        answer = {"is_plagiarized": bool(held), "confidence": float(bool(held)), "matched_references": held}
        answers.append("```json\n" + json.dumps({**answer, "explanation": "verbatim"}) + "\n```")
    return answers


@query
def judge_with_callable(d: TestData) -> DataFrame:
    return _flat(dt.judge_contexts(d.index, d.queries, d.hybrid, "verbatim", judge=_verbatim_judge))


@query
def detect_sampled_context_parts(d: TestData) -> DataFrame:
    """A sample of more documents than a prompt can hold."""
    return _flat(dt.detect_sampled_context(d.index, d.queries, n=1000, judge=_verbatim_judge))


@query
def judge_answers_once(d: TestData) -> DataFrame:
    """Every prompt asked under three ids, in two runs; the number of answers stored for it stays one."""
    path = new_path(d.spark, "answers")
    contexts = d.hybrid.join(d.documents.select("doc_id", "text"), "doc_id")
    prompts = written(build_prompts(d.queries, contexts).select("query_id", "prompt"), "once_prompts")
    ask_once(prompts, _verbatim_judge, path, "verbatim").count()
    thrice = prompts.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    copies = thrice.select((F.col("query_id") * 3 + F.col("copy")).alias("query_id"), "prompt")
    verdicts = parse_verdicts(ask_once(copies, _verbatim_judge, path, "verbatim"))
    stored = answer_table(d.spark, path).groupBy("key").agg(F.count("*").alias("n_answers"))
    keyed = copies.select("query_id", answer_key("prompt").alias("key"))
    refs = joined(F.transform("matched_references", lambda x: x.cast("string")))
    return verdicts.join(keyed, "query_id").join(stored, "key").select(
        "query_id", "is_match", "confidence", refs.alias("matched_references"), "error", "n_answers"
    )


@query
def rebuild_indexes(d: TestData) -> DataFrame:
    """A second build on one path: some texts changed, and as many documents new."""
    path = new_path(d.spark, "rebuilt")
    embed = lambda texts: [[float(len(t)), 100.0] for t in texts]
    build_indexes(d.documents.select("doc_id", "text"), path, embed=embed, embedder="length")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    new = d.documents.select((-F.col("doc_id") - 1).alias("doc_id"), F.concat_ws(" ", "lang", "source").alias("text"))
    build_indexes(d.documents.select("doc_id", text.alias("text")).unionByName(new), path, embed=embed, embedder="length")
    served = load_indexes(d.spark, path, embed=embed, embedder="length")
    embedded = d.spark.read.parquet(f"{path}/embeddings-length").groupBy("doc_id").agg(F.count("*").alias("n_embedded"))
    return (
        served.dense.select("doc_id", r6(F.col("unit_vec")[0]).alias("first_number"))
        .join(served.sparse.doc_stats.select("doc_id", "dl"), "doc_id")
        .join(embedded, "doc_id")
    )


# --- labelled sets ------------------------------------------------------------------


def _next_docs(d: TestData) -> DataFrame:
    right = d.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.documents.select("doc_id", "text").join(right, "doc_id")


@query
def token_jaccard_pairs(d: TestData) -> DataFrame:
    return _next_docs(d).select("doc_id", r6(token_jaccard("text", "other")).alias("jaccard"))


@query
def ast_fingerprint(d: TestData) -> DataFrame:
    prints = ls.fingerprints(d.modules, "p_partkey", "content")
    return prints.select(
        "doc_id", F.size("node_types").alias("n_nodes"), F.md5(joined("node_types")).alias("types_md5")
    )


@query
def ast_similarity(d: TestData) -> DataFrame:
    """Each part's module against the bare function or method, by size."""
    part = d.parts
    bare = F.when(F.col("p_size") % 2 == 0, F.lit(FUNCTION)).otherwise(F.lit("class A:\n" + METHOD))
    variant = F.replace(F.replace(bare, F.lit("<k>"), F.col("p_partkey").cast("string")), F.lit("<n>"), F.lit("7"))
    left = d.modules.select(F.col("p_partkey").alias("doc_id"), F.col("content").alias("text"))
    right = part.select((-F.col("p_partkey") - 1).alias("doc_id"), variant.alias("text"))
    vectors = written(ls.structure_vectors(ls.fingerprints(left.unionByName(right))), "structure")
    pairs = part.select(F.col("p_partkey").alias("left_id"), (-F.col("p_partkey") - 1).alias("right_id"))
    # both joins sort vectors, so their tasks follow the number of vectors
    return ls.structure_similarity(pairs, vectors.repartition(max(1, -(-vectors.count() // TASK_DOCS)), "doc_id"))


@query
def validate_positive(d: TestData) -> DataFrame:
    vec = d.index.dense.select("doc_id", "unit_vec")
    pairs = (
        _next_docs(d)
        .join(vec.withColumnRenamed("unit_vec", "original_vec"), "doc_id")
        .join(vec.select((F.col("doc_id") - 1).alias("doc_id"), F.col("unit_vec").alias("generated_vec")), "doc_id")
        .withColumnsRenamed({"text": "original", "other": "generated"})
    )
    return ls.validate_positive(pairs)


@query
def validate_negative(d: TestData) -> DataFrame:
    pairs = d.vectors.select(
        F.col("doc_id").alias("case_id"),
        F.col("unit_vec").alias("original_vec"),
        F.reverse("unit_vec").alias("generated_vec"),
    )
    return ls.validate_negative(pairs, d.vectors, threshold=0.4)


@query
def sample_originals(d: TestData) -> DataFrame:
    return sample_rows(d.documents.select("doc_id", "lang"), 30).drop("sample_key")


def _candidates(d: TestData) -> DataFrame:
    """Seven candidate texts per document: four copies of falling disguise, three benchmark items."""
    blanked, changed = F.col("text"), F.replace(F.replace("text", F.lit("a"), F.lit("x")), F.lit("e"), F.lit("y"))
    for vowel in "aeiou":
        blanked = F.replace(blanked, F.lit(vowel), F.lit(" "))
    disguised = F.array(F.upper(blanked), changed, F.concat(F.lit("copy of "), "text"), F.col("text"))
    copies = d.documents.select(F.col("doc_id").alias("src_id"), F.posexplode(token_jaccards("text", disguised)).alias("place", "jaccard"))
    copies = copies.select("src_id", F.lit(1).alias("label"), (F.col("place") + 1).alias("attempt"), "jaccard")
    n_items = d.queries.agg(F.count("*")).scalar()
    wanted = d.documents.select(F.col("doc_id").alias("src_id"), "text", F.explode(F.array(*[F.lit(i) for i in range(1, 4)])).alias("attempt"))
    items = wanted.withColumn("query_id", (F.col("src_id") + F.col("attempt")) % n_items).join(
        d.queries.select("query_id", F.col("text").alias("candidate")), "query_id"
    ).select("src_id", F.lit(0).alias("label"), "attempt", token_jaccard("text", "candidate").alias("jaccard"))
    scored = copies.unionByName(items).withColumn("jaccard", r6("jaccard"))
    close = F.col("jaccard") >= ls.MIN_JACCARD
    return scored.withColumn("is_valid", F.when(F.col("label") == 1, close).otherwise(~close)).select(
        "src_id", "label", "attempt", "is_valid", "jaccard"
    )


def _disguise(asked: list[tuple[str, int, int]]) -> list[str | None]:
    """Copies of falling disguise for label 1, texts that resemble the original less and less for label 0."""
    if any(attempt == 2 and label == 1 and text.startswith("a") for text, label, attempt in asked):
        raise RuntimeError("no copy of this")
    plain = [_no_vowels, _others, lambda t: "copy of " + t]
    far = [lambda t: t, lambda t: "copy of " + t, _others, lambda t: None, lambda t: "nothing of this"]
    return [(plain if label else far)[attempt - 1](text) for text, label, attempt in asked]


def _no_vowels(text: str) -> str:
    for vowel in "aeiou":
        text = text.replace(vowel, " ")
    return text


def _others(text: str) -> str:
    return text.replace("a", "x").replace("e", "y")


@query
def candidate_rounds(d: TestData) -> DataFrame:
    originals = d.documents.select(F.col("doc_id").alias("src_id"), F.col("text").alias("code"))

    def check(made: DataFrame) -> DataFrame:
        scored = made.join(originals.withColumnRenamed("code", "text"), "src_id").withColumn("jaccard", r6(token_jaccard("text", "code")))
        close = F.col("jaccard") >= ls.MIN_JACCARD
        return scored.withColumn("is_valid", F.when(F.col("label") == 1, close).otherwise(~close)).drop("text")

    rounds = run_rounds(originals, _disguise, check)
    return rounds.select("src_id", "label", "attempt", "is_valid", "jaccard", F.md5("code").alias("code_md5"), "error")


@query
def first_valid_candidate(d: TestData) -> DataFrame:
    return ls.first_valid(_candidates(d))


@query
def candidate_stats(d: TestData) -> DataFrame:
    return ls.candidate_stats(d.documents.select(F.col("doc_id").alias("src_id")), ls.first_valid(_candidates(d)))


@query
def ragged_union(d: TestData) -> DataFrame:
    labelled = d.table("labels")
    positive = labelled.where("quality = 1").select("doc_id", F.lit(1).alias("label"), (F.col("doc_id") / 8).alias("token_jaccard"))
    negative = labelled.where("quality = 0").select("doc_id", F.lit(0).alias("label"), (F.col("doc_id") / 4).alias("max_corpus_similarity"))
    return ls.ragged_union(positive, negative)


# --- evaluation ---------------------------------------------------------------------


@query
def case_labels(d: TestData) -> DataFrame:
    return d.cases


@query
def evaluate(d: TestData) -> DataFrame:
    """Verdicts of the callable judge, with errors where an answer lacked a field."""
    verdicts = judge_containment(d.queries, d.dense_judged).withColumn(
        "error", F.when(F.col("query_id") % 10 == 3, F.lit("missing field"))
    )
    return ev.predict(d.cases, verdicts.where(F.col("query_id") % 10 != 7), "dense_context").drop("elapsed")


@query
def confusion_matrix(d: TestData) -> DataFrame:
    return ev.confusion(d.label_predictions, "method")


@query
def metrics(d: TestData) -> DataFrame:
    return ev.metrics(d.label_predictions, "method")


@query
def timing_summary(d: TestData) -> DataFrame:
    timed = d.table("events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("method"),
        F.col("value").alias("elapsed"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
    )
    return ev.timing(timed, "method")


@query
def error_cases(d: TestData) -> DataFrame:
    return ev.error_cases(d.label_predictions)


@query
def error_report(d: TestData) -> DataFrame:
    report = ev.error_report(d.label_predictions)
    return report.withColumn("examples", joined(F.transform("examples", lambda x: x.cast("string"))))


@query
def sweep_k(d: TestData) -> DataFrame:
    return ev.sweep_k(d.dense_judged, d.cases, 0.8)


@query
def sweep_threshold(d: TestData) -> DataFrame:
    best = d.dense.groupBy("query_id").agg(F.max("score").alias("max_similarity"))
    return ev.sweep_threshold(best, d.cases)


@query
def sweep_rrf_k(d: TestData) -> DataFrame:
    fused = written(rrf_topk_sweep(d.dense, d.sparse, ev.RRF_K_VALUES, 5), "fused")
    pairs = fused.select("query_id", "doc_id").distinct()
    judged = pair_containment(d.queries, pairs, d.index.sparse.postings)
    return ev.sweep_fused(fused.join(judged, ["query_id", "doc_id"]), d.cases, 0.8, ev.RRF_K_VALUES)


@query
def metrics_pivot(d: TestData) -> DataFrame:
    return ev.metrics_by_method(ev.metrics(d.label_predictions, "method"), ["de", "en", "es", "fr"])


@query
def metric_ranking(d: TestData) -> DataFrame:
    return ev.rank_methods(ev.metrics(d.label_predictions, "method"))


@query
def full_evaluation(d: TestData) -> DataFrame:
    return pe.report(pe.full_evaluation(d.index, d.queries, d.cases, dense=d.dense, hybrid=d.hybrid))


@query
def tradeoff(d: TestData) -> DataFrame:
    timed = d.label_predictions.join(
        d.table("events").select(F.col("event_id").alias("case_id"), F.col("value").alias("elapsed")), "case_id"
    ).withColumn("error", F.lit(None).cast("string"))
    return pe.tradeoff(timed)


# --- keyed table --------------------------------------------------------------------


@query
def validate_commands(d: TestData) -> DataFrame:
    return d.commands


@query
def create_table_once(d: TestData) -> DataFrame:
    """Creating a table that has rows leaves them."""
    path = new_path(d.spark, "staff")
    rp.create_table(d.spark, path)
    d.staff.write.mode("append").parquet(path)
    return rp.create_table(d.spark, path)


@query
def apply_adds(d: TestData) -> DataFrame:
    return rp.apply_adds(d.staff, d.requests("signup"))


@query
def apply_deletes(d: TestData) -> DataFrame:
    return rp.apply_deletes(d.staff, d.requests("error"))


@query
def apply_updates(d: TestData) -> DataFrame:
    return rp.apply_updates(d.staff, d.requests("purchase"))


@query
def filter_optional(d: TestData) -> DataFrame:
    return rp.filter_optional(d.table("customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@query
def filter_optional_empty(d: TestData) -> DataFrame:
    return rp.filter_optional(d.table("customer"), "c_mktsegment", "").select("c_custkey", "c_name", "c_acctbal")


@query
def point_lookups(d: TestData) -> DataFrame:
    asked = d.requests("view").select("name").distinct()
    return rp.point_lookups(d.staff, asked, "name", "salary")


@query
def replay_statuses(d: TestData) -> DataFrame:
    return rp.statuses(d.commands, d.replayed)


@query
def replay_final_table(d: TestData) -> DataFrame:
    return rp.final_table(d.replayed)


@query
def replay_asof_lookup(d: TestData) -> DataFrame:
    return rp.lookups_as_of(d.replayed)


@query
def replay_asof_snapshot(d: TestData) -> DataFrame:
    return rp.list_calls_as_of(d.commands, d.replayed)


@query
def replay_row_versions(d: TestData) -> DataFrame:
    return rp.row_versions(d.replayed)


@query
def replay_table_as_of(d: TestData) -> DataFrame:
    middle = d.commands.agg((F.max("seq") / 2).cast("bigint")).scalar()
    return rp.table_as_of(rp.row_versions(d.replayed), middle)


@query
def tables_as_of(d: TestData) -> DataFrame:
    """What every list call of the log returned, as counts and sums of its rows."""
    calls = d.commands.where((F.col("tool") == rp.LIST) & F.col("error").isNull()).select(F.col("seq").alias("position"), "role")
    seen = tables_at(rp.row_versions(d.replayed), calls, totals=True)
    return seen.groupBy("position", "asked_role").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("id_total").alias("id_total"), F.sum("salary_total").alias("salary_total"),
        F.min("first_name").alias("first_name"), F.max("last_name").alias("last_name"), F.count("role").alias("n_roles"),
    )


@query
def replay_in_two_parts(d: TestData) -> DataFrame:
    return d.two_runs[0].statuses.unionByName(d.two_runs[1].statuses)


@query
def replay_in_two_parts_lists(d: TestData) -> DataFrame:
    return d.two_runs[0].list_calls.unionByName(d.two_runs[1].list_calls)


@query
def replay_in_two_parts_table(d: TestData) -> DataFrame:
    return d.two_runs[1].state.table


@query
def replay_one_status_per_command(d: TestData) -> DataFrame:
    """Null tools, wrong types, text after the object and large integers: no command is lost or misread."""
    commands = written(rp.validate(d.hard_log), "hard_commands")
    return rp.statuses(commands, rp.replay(commands))


@query
def replay_sparse_positions(d: TestData) -> DataFrame:
    """The same log with positions as far apart as in epoch nanoseconds."""
    far = written(d.commands.withColumn("seq", F.col("seq") * 1_000_000_000), "sparse_commands")
    return rp.statuses(far, rp.replay(far, d.base, span=5000))


@query
def replay_summary(d: TestData) -> DataFrame:
    return rp.summary(rp.statuses(d.commands, d.replayed))


# --- transcripts --------------------------------------------------------------------


def _messages(d: TestData) -> DataFrame:
    return d.table("conversations").withColumnRenamed("text", "content")


@query
def assemble_transcripts(d: TestData) -> DataFrame:
    t = tr.assemble(_messages(d), system="default")
    return t.select("conv_id", "position", "turn", "role", F.md5("content").alias("content_md5"))


@query
def transcript_pages(d: TestData) -> DataFrame:
    turn = F.col("turn").cast("string")
    called = _messages(d).select(
        "*", F.when(F.col("role") == "assistant", F.array(F.struct(F.concat(F.lit("c"), turn).alias("id")))).alias("tool_calls"),
        F.when(F.col("role") == "user", F.concat(F.lit("u"), turn)).alias("tool_call_id"),
    )
    p = tr.pages(tr.assemble(called, system="default"), page_size=3)
    return p.select(
        "conv_id", "page", F.size("messages").alias("n_messages"), joined(F.col("messages.role")).alias("roles"),
        F.md5(joined(F.col("messages.content"), "|")).alias("content_md5"),
        joined(F.transform("messages", lambda m: F.coalesce(m["tool_calls"][0]["id"], F.lit("-")))).alias("calls"),
        joined(F.transform("messages", lambda m: F.coalesce(m["tool_call_id"], F.lit("-")))).alias("answers"),
    )


@query
def pair_tool_calls(d: TestData) -> DataFrame:
    """Each assistant turn calls two tools; the first is answered by the next turn, if any."""
    m = d.table("conversations")
    call_id = F.concat_ws("-", F.lit("call"), "turn")
    call = lambda suffix: F.struct(
        F.concat(call_id, F.lit(suffix)).alias("id"), F.lit("get_employee_salary").alias("name"),
        F.concat(F.lit('{"name": "u'), F.col("turn").cast("string"), F.lit('"}')).alias("arguments"),
    )
    calls = m.select(
        "conv_id", "turn", "role", F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.array(call("a"), call("b"))).alias("tool_calls"),
        F.lit(None).cast("string").alias("tool_call_id"),
    )
    answers = m.where("role = 'user'").select(
        "conv_id", F.col("turn"), F.lit("tool").alias("role"), F.col("text").alias("content"),
        F.lit(None).cast(calls.schema["tool_calls"].dataType).alias("tool_calls"),
        F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string"), F.lit("a")).alias("tool_call_id"),
    )
    paired = tr.pair_calls(calls.unionByName(answers))
    return paired.select("conv_id", "turn", "tool_call_id", "tool", "arguments", F.md5("result").alias("result_md5"))
