"""SQL giving the result of each registered query on the same tables."""

from __future__ import annotations

import ast
import hashlib
import math
from collections import Counter

from checks.data import FUNCTION, METHOD, MODULE, SMALL
ORACLES: dict[str, str] = {}

# The rules are stated here again, so that a wrong one in the package shows.
# --- fixed values ---
WHITESPACE = r"\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN_PATTERN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{WHITESPACE}]"
PROMPT_HEAD = "You are a code plagiarism detector. Analyze if the QUERY code is plagiarized from any REFERENCE code."
PROMPT_TAIL = """Determine:
1. Is the query plagiarized? (YES/NO)
2. If yes, which reference(s)?
3. Plagiarism confidence (0.0-1.0)
4. Brief explanation

Return JSON:
{
  "is_plagiarized": true/false,
  "confidence": 0.0-1.0,
  "matched_references": [1, 2, ...],
  "explanation": "brief reason"
}"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(column: str) -> str:
    return f"regexp_extract_all({column}, {lit(TOKEN_PATTERN)})"


def words(column: str) -> str:
    split = f"regexp_split_to_array({column}, {lit(f'[{WHITESPACE}]+')})"
    return f"list_distinct(list_filter({split}, lambda w: w <> ''))"


BUCKET = "(('0x' || substr(md5(term), 1, 7))::INT % 256)"

# --- shared subqueries ------------------------------------------------------------

TERMS = f"""
tok AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
counts AS (
  SELECT doc_id, len(t)::INT AS dl, term, count(*) AS tf
  FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
qcounts AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL)
"""

BM25 = f"""{TERMS},
stats AS (SELECT (SELECT count(*) FROM documents) AS n,
                 (SELECT sum(tf) FROM counts) / (SELECT count(*) FROM documents) AS avgdl),
postings AS (
  SELECT term, doc_id, tf, dl, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS saturation
  FROM counts, stats),
raw AS (
  SELECT term, count(*) AS df, max(saturation) AS max_saturation,
         ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
  FROM postings, stats GROUP BY term),
term_stats AS (
  SELECT term, df, max_saturation,
         CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf
  FROM raw),
bm25 AS (
  SELECT query_id, doc_id, round(sum(qtf * idf * saturation), 6) AS score
  FROM qcounts JOIN term_stats USING (term) JOIN postings USING (term) GROUP BY ALL)
"""

HASHED = f"""
doc_hash AS (SELECT doc_id, {BUCKET} AS bucket, sum(tf)::BIGINT AS value FROM counts GROUP BY ALL),
doc_unit AS (SELECT doc_id, bucket, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM doc_hash),
query_hash AS (SELECT query_id, {BUCKET} AS bucket, sum(qtf)::BIGINT AS value FROM qcounts GROUP BY ALL),
query_unit AS (SELECT query_id, bucket, value / sqrt(sum(value * value) OVER (PARTITION BY query_id)) AS value FROM query_hash),
cosines AS (
  SELECT i.item_id AS query_id, d.doc_id, round(coalesce(s.score, 0), 6) AS score
  FROM benchmark i CROSS JOIN documents d
  LEFT JOIN (SELECT q.query_id, u.doc_id, sum(q.value * u.value) AS score
             FROM query_unit q JOIN doc_unit u USING (bucket) GROUP BY ALL) s
    ON s.query_id = i.item_id AND s.doc_id = d.doc_id)
"""


def ranked(source: str, k: int, by: str = "query_id") -> str:
    return f"""(SELECT {'query_id' if by == 'query_id' else by}, doc_id, score, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank FROM {source})
    WHERE rank <= {k})"""


LISTS = f"""{BM25}, {HASHED},
dense AS {ranked('cosines', 20)},
sparse AS {ranked('bm25', 20)}
"""


def fused(depth: int, k: int, rrf: str = "60") -> str:
    return f"""
fused AS (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id,
         round(coalesce(1.0::DOUBLE / ({rrf} + d.rank - 1), 0) + coalesce(1.0::DOUBLE / ({rrf} + s.rank - 1), 0), 9) AS score
  FROM (SELECT * FROM dense WHERE rank <= {depth}) d
  FULL JOIN (SELECT * FROM sparse WHERE rank <= {depth}) s ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
hybrid AS {ranked('fused', k)}
"""


HYBRID = f"{LISTS}, {fused(10, 5)}"

CONTAINED = """
qsize AS (SELECT query_id, count(*) AS n FROM qcounts GROUP BY ALL),
shares AS (
  SELECT q.query_id, c.doc_id, round(count(*) / any_value(s.n), 6) AS containment
  FROM qcounts q JOIN counts c USING (term) JOIN qsize s ON s.query_id = q.query_id GROUP BY ALL)
"""

CASES = f"""
cases AS (
  SELECT item_id AS case_id, (EXISTS (
    SELECT 1 FROM (SELECT ' ' || array_to_string(t, ' ') || ' ' AS line FROM tok) d
    WHERE contains(d.line, ' ' || array_to_string({tokens('text')}, ' ') || ' ')))::INT AS y_true
  FROM benchmark)
"""


def verdicts(hits: str, method: str) -> str:
    """Containment verdicts; a sample has no scores and so no matches."""
    matches = "NULL::VARCHAR" if hits == "sampled" else "string_agg(h.rank || ':' || h.doc_id, ' ' ORDER BY h.rank)"
    return f"""
    SELECT i.item_id AS query_id, {lit(method)} AS method,
           coalesce(max(containment) >= 0.8, false) AS is_match,
           coalesce(max(containment), 0) AS confidence,
           count(h.doc_id)::INT AS context_size,
           coalesce(string_agg(h.rank::VARCHAR, ' ' ORDER BY h.rank) FILTER (containment >= 0.8), '') AS matched_references,
           NULL::VARCHAR AS error, {matches} AS matches
    FROM benchmark i LEFT JOIN (
      SELECT x.query_id, x.doc_id, x.rank, coalesce(s.containment, 0) AS containment
      FROM {hits} x LEFT JOIN shares s USING (query_id, doc_id)) h ON h.query_id = i.item_id
    GROUP BY ALL"""


def confusion(source: str, *by: str) -> str:
    keys = ", ".join(by)
    return f"""SELECT {keys}, count_if(y_true = 1 AND y_pred = 1)::BIGINT AS tp, count_if(y_true = 0 AND y_pred = 0)::BIGINT AS tn,
      count_if(y_true = 0 AND y_pred = 1)::BIGINT AS fp, count_if(y_true = 1 AND y_pred = 0)::BIGINT AS fn
      FROM {source} GROUP BY {keys}"""


METRIC_COLUMNS = """round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"""


def metrics(source: str, *by: str) -> str:
    return f"SELECT {', '.join(by)}, {METRIC_COLUMNS} FROM ({confusion(source, *by)})"


PREDICTIONS = """(SELECT lang AS method, l.doc_id AS case_id, quality AS y_true, 1 - toxic AS y_pred
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""

VECTORS = """
unit AS (SELECT vec_id, list_transform(embedding::DOUBLE[],
           lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings)
"""

NEIGHBOURS = f"""{VECTORS},
sims AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.v, b.v), 6) + 0.0 AS score
         FROM unit a JOIN unit b ON a.vec_id <> b.vec_id)
"""

# --- sources, sinks, corpus -----------------------------------------------------------

ORACLES["corpus_roundtrip"] = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
ORACLES["corpus_csv_roundtrip"] = ORACLES["corpus_roundtrip"]
ORACLES["label_counts"] = """
SELECT count(*) AS n_cases, count_if(quality = 1)::BIGINT AS n_positive, count_if(quality = 0)::BIGINT AS n_negative
FROM labels JOIN documents USING (doc_id)"""
ORACLES["metrics_csv_roundtrip"] = metrics(PREDICTIONS, "method")
ORACLES["embed_missing_only"] = """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""
LETTERS = ", ".join(f"(len(text) - len(replace(text, '{c}', '')))::DOUBLE AS n_{c}" for c in "aeiou")
ORACLES["embed_incremental"] = f"SELECT doc_id, {LETTERS} FROM documents"
ORACLES["embed_batch"] = ORACLES["embed_incremental"]


def filled(template: str) -> str:
    return f"replace(replace({lit(template.rstrip(chr(10)))}, '<k>', p_partkey::VARCHAR), '<n>', p_size::VARCHAR)"


def functions() -> str:
    parts = [("make_", FUNCTION, 1), ("tiny_", SMALL, 6), ("area_", METHOD, 19)]
    rows = " UNION ALL ".join(
        f"SELECT p_partkey, '{name}' || p_partkey AS function_name, {line} AS line, {filled(code)} AS code FROM part"
        for name, code, line in parts
    )
    return f"""(SELECT *, len({tokens('code')})::INT AS token_count FROM ({rows})
      WHERE len({tokens('code')}) BETWEEN 30 AND 8000)"""


ORACLES["extract_functions_from_modules"] = f"""
SELECT 'part_' || p_partkey || '.py::' || function_name || '::' || line AS id, code,
       'src/part_' || p_partkey || '.py' AS file_path, function_name, token_count FROM {functions()}"""
ORACLES["scan_source_files"] = f"SELECT code, function_name, token_count FROM {functions()}"
ORACLES["scan_changed_files"] = f"""
SELECT code, function_name, token_count FROM {functions()}
UNION ALL SELECT replace(code, 'make_', 'build_up_'), replace(function_name, 'make_', 'build_up_'), token_count FROM {functions()}"""
ORACLES["token_band_filter"] = f"""
SELECT doc_id, len({tokens('text')})::INT AS token_count FROM documents WHERE len({tokens('text')}) BETWEEN 30 AND 8000"""
ORACLES["corpus_union"] = """
SELECT 'documents' AS part, doc_id AS key, md5(text) AS text_md5 FROM documents
UNION ALL SELECT 'benchmark', item_id, md5(text) FROM benchmark"""
ORACLES["tokenize_text"] = f"""
SELECT doc_id, len({tokens('text')})::INT AS n_tokens, md5(array_to_string({tokens('text')}, ' ')) AS tokens_md5 FROM documents"""
ORACLES["whitespace_words"] = f"""
SELECT doc_id, len({words('text')})::INT AS n_words, md5(array_to_string(list_sort({words('text')}), ' ')) AS words_md5 FROM documents"""
TRIM = lit(rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z")
ORACLES["strip_code_fences"] = f"""
SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, '```json', ''), '```python', ''), '```', '')
  || chr(10) || ' ' || chr(10) || ' x', {TRIM}, '', 'g')) AS text_md5 FROM documents"""
ORACLES["url_tail"] = """
SELECT page_id, replace(split_part(rtrim(url, '/'), '/', -1), '.git', '') AS tail,
       replace(split_part(rtrim(url || '.git//', '/'), '/', -1), '.git', '') AS repo_tail FROM pages"""

# --- embeddings and vectors -----------------------------------------------------------

ORACLES["hash_embed"] = f"WITH {TERMS}, {HASHED} SELECT doc_id, bucket, value FROM doc_hash"
ORACLES["hash_embed_vectors"] = f"WITH {TERMS}, {HASHED} SELECT query_id, bucket, value FROM query_hash"
ORACLES["dense_index"] = f"WITH {TERMS}, {HASHED} SELECT doc_id, bucket, round(value, 6) AS value FROM doc_unit"
ORACLES["l2_normalize_vectors"] = """
WITH scaled AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 1) AS v FROM embeddings),
long AS (SELECT vec_id, unnest(range(len(v)))::INT AS pos, unnest(v) AS x FROM scaled)
SELECT vec_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM long"""
ORACLES["cosine_pairs"] = """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLES["max_similarity_to_corpus"] = f"""
WITH {NEIGHBOURS} SELECT query_id, doc_id AS nearest_id, score AS max_similarity FROM {ranked('sims', 1)}"""
ORACLES["dense_topk"] = f"WITH {NEIGHBOURS} SELECT * FROM {ranked('sims', 10)}"
ORACLES["dense_topk_regions"] = ORACLES["dense_topk"]
ORACLES["dense_topk_ragged"] = f"""WITH {VECTORS},
sims AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.v, b.v), 6) + 0.0 AS score
         FROM unit a, unit b WHERE b.vec_id % 7 <> 0 AND b.vec_id % 11 <> 0 AND b.vec_id % 13 <> 0 AND b.vec_id % 17 <> 0)
SELECT * FROM {ranked('sims', 10)}"""
ORACLES["unsound_embeddings"] = """
SELECT vec_id AS doc_id, CASE WHEN vec_id % 17 = 0 THEN 'null' WHEN vec_id % 7 <> 0 AND vec_id % 13 = 0 THEN 'empty'
  WHEN vec_id % 19 = 0 THEN 'not finite' WHEN vec_id % 7 = 0 THEN 'wrong length' END AS problem
FROM embeddings WHERE problem IS NOT NULL"""
ORACLES["build_all_indexes"] = f"""WITH {TERMS}
SELECT 'corpus' AS table_name, count(*) AS n_rows FROM documents
UNION ALL SELECT 'dense', count(*) FROM documents
UNION ALL SELECT 'postings', count(*) FROM counts
UNION ALL SELECT 'term_stats', count(DISTINCT term) FROM counts
UNION ALL SELECT 'doc_stats', count(*) FROM documents"""

# --- sparse index and retrieval ---------------------------------------------------------

ORACLES["bm25_postings"] = f"WITH {BM25} SELECT term, doc_id, tf, dl, round(saturation, 6) AS saturation FROM postings"
ORACLES["bm25_term_stats"] = f"""WITH {BM25}
SELECT term, df, round(idf, 6) AS idf, round(max_saturation, 6) AS max_saturation FROM term_stats"""
ORACLES["bm25_corpus_stats"] = f"""WITH {BM25}
SELECT n, round(avgdl, 6) AS avgdl, (SELECT round(avg(raw_idf), 6) FROM raw) AS avg_idf,
       (SELECT count(*) FROM raw) AS n_terms FROM stats"""
ORACLES["bm25_doc_stats"] = f"""
SELECT doc_id, len({tokens('text')})::INT AS dl, len(list_distinct({tokens('text')}))::BIGINT AS n_terms FROM documents"""
ORACLES["bm25_rescore_pairs"] = f"""WITH {LISTS}
SELECT d.query_id, d.doc_id, coalesce(b.score, 0) AS score FROM dense d LEFT JOIN bm25 b USING (query_id, doc_id)"""
ORACLES["dense_topk_text"] = f"WITH {LISTS} SELECT * FROM dense"
ORACLES["dense_topk_regions_text"] = ORACLES["dense_topk_text"]
ORACLES["sparse_topk"] = f"WITH {BM25} SELECT * FROM {ranked('bm25', 20)}"
ORACLES["sparse_topk_thresholds"] = f"WITH {BM25} SELECT * FROM {ranked('bm25', 10)}"
ORACLES["sparse_topk_blocks"] = ORACLES["sparse_topk_thresholds"]
GROWN = """documents AS (
  SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN text || ' ' || lang WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END AS text
  FROM documents)"""
ORACLES["index_grow"] = f"""WITH {GROWN}, {LISTS}
SELECT *, 'sparse' AS kind FROM sparse WHERE rank <= 10 UNION ALL SELECT *, 'dense' AS kind FROM dense WHERE rank <= 10"""
ORACLES["hybrid_rrf_topk"] = f"WITH {LISTS}, {fused(20, 10)} SELECT * FROM hybrid"
ORACLES["hydrate_hits"] = f"""WITH {BM25}
SELECT query_id, rank, doc_id, lang, source, score FROM {ranked('bm25', 20)} JOIN documents USING (doc_id)"""
ORACLES["match_record_lists"] = f"""WITH {HYBRID}
SELECT query_id, string_agg(rank || ':' || doc_id, ' ' ORDER BY rank) AS matches, string_agg(lang, ' ' ORDER BY rank) AS langs
FROM hybrid JOIN documents USING (doc_id) GROUP BY query_id"""

# --- detection ------------------------------------------------------------------------

ORACLES["detect_threshold"] = f"""WITH {NEIGHBOURS}
SELECT query_id, 'embedding' AS method, max(score) >= 0.45 AS is_match, max(score) AS max_similarity,
       0.45::DOUBLE AS threshold, string_agg(rank || ':' || doc_id, ' ' ORDER BY rank) AS matches
FROM {ranked('sims', 5)} GROUP BY query_id"""
ORACLES["detect_threshold_text"] = f"""WITH {LISTS}
SELECT query_id, 'embedding' AS method, max(score) >= 0.8 AS is_match, max(score) AS max_similarity,
       0.8::DOUBLE AS threshold, string_agg(rank || ':' || doc_id, ' ' ORDER BY rank) AS matches
FROM dense WHERE rank <= 5 GROUP BY query_id"""
SAMPLED = """
sampled AS (
  SELECT i.item_id AS query_id, s.doc_id, s.rank FROM benchmark i CROSS JOIN (
    SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)::INT AS rank FROM documents
    QUALIFY rank <= 100) s)
"""
ORACLES["detect_sampled_context"] = f"WITH {TERMS}, {CONTAINED}, {SAMPLED} {verdicts('sampled', 'sampled_context')}"
ORACLES["detect_dense_context"] = f"""WITH {LISTS}, {CONTAINED}
{verdicts('(SELECT * FROM dense WHERE rank <= 5)', 'dense_context')}"""
ORACLES["detect_hybrid_context"] = f"WITH {HYBRID}, {CONTAINED} {verdicts('hybrid', 'hybrid_context')}"
FENCED = "chr(10) || '```python' || chr(10) || {} || chr(10) || '```'"
ORACLES["build_judge_prompts"] = f"""WITH {HYBRID},
refs AS (
  SELECT query_id, count(*)::INT AS n,
    string_agg('REFERENCE ' || rank || ':' || {FENCED.format('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS r
  FROM hybrid JOIN documents USING (doc_id) GROUP BY query_id),
prompts AS (
  SELECT item_id AS query_id, coalesce(n, 0)::INT AS context_size,
    {lit(PROMPT_HEAD)} || chr(10) || chr(10) || 'QUERY CODE:' || {FENCED.format('text')} || chr(10) || chr(10)
    || 'REFERENCE CODES:' || chr(10) || coalesce(r, '') || chr(10) || chr(10) || {lit(PROMPT_TAIL)} AS prompt
  FROM benchmark LEFT JOIN refs ON query_id = item_id)
SELECT query_id, context_size, len(prompt)::INT AS n_chars, md5(prompt) AS prompt_md5 FROM prompts"""
ORACLES["judge_by_containment"] = f"""WITH {HYBRID}, {CONTAINED}
SELECT query_id, doc_id, rank, coalesce(containment, 0) AS containment FROM hybrid LEFT JOIN shares USING (query_id, doc_id)"""
ORACLES["parse_judge_answers"] = """
SELECT doc_id,
  CASE WHEN doc_id % 12 IN (3, 11) THEN NULL ELSE doc_id % 12 IN (0, 1, 4, 6, 7, 8, 9) END AS is_match,
  CASE WHEN doc_id % 12 IN (0, 1) THEN ('0.' || doc_id)::DOUBLE WHEN doc_id % 12 IN (3, 11) THEN NULL WHEN doc_id % 12 = 4 THEN 1
    WHEN doc_id % 12 = 5 THEN 0.25 WHEN doc_id % 12 IN (6, 7, 8) THEN 0.5 WHEN doc_id % 12 = 9 THEN 0.9 ELSE 0 END AS confidence,
  CASE WHEN doc_id % 12 IN (0, 1) THEN '1 ' || doc_id WHEN doc_id % 12 IN (6, 8) THEN '1 2' ELSE '' END AS matched_references,
  CASE WHEN doc_id % 12 IN (0, 1) THEN 'copy of ' || doc_id WHEN doc_id % 12 IN (3, 11) THEN NULL WHEN doc_id % 12 = 4 THEN 'x'
    WHEN doc_id % 12 = 5 THEN 'none' WHEN doc_id % 12 IN (6, 7, 8, 9) THEN 's' ELSE 'Parse error' END AS explanation,
  CASE doc_id % 12 WHEN 3 THEN 'missing field' WHEN 11 THEN 'not an object' END AS error
FROM documents"""
ORACLES["judge_with_callable"] = f"""WITH {HYBRID},
held AS (SELECT h.query_id, h.rank, h.doc_id, contains(d.text, i.text) AS hit
         FROM hybrid h JOIN documents d USING (doc_id) JOIN benchmark i ON i.item_id = h.query_id)
SELECT query_id, 'verbatim' AS method, bool_or(hit) AS is_match, bool_or(hit)::INT::DOUBLE AS confidence,
       count(*)::INT AS context_size, coalesce(string_agg(rank::VARCHAR, ' ' ORDER BY rank) FILTER (hit), '') AS matched_references,
       NULL::VARCHAR AS error, string_agg(rank || ':' || doc_id, ' ' ORDER BY rank) AS matches
FROM held GROUP BY query_id"""
ORACLES["judge_answers_once"] = f"""WITH {HYBRID},
held AS (SELECT h.query_id, h.rank, contains(d.text, i.text) AS hit
         FROM hybrid h JOIN documents d USING (doc_id) JOIN benchmark i ON i.item_id = h.query_id),
judged AS (SELECT query_id, bool_or(hit) AS is_match, bool_or(hit)::INT::DOUBLE AS confidence,
                  coalesce(string_agg(rank::VARCHAR, ' ' ORDER BY rank) FILTER (hit), '') AS matched_references
           FROM held GROUP BY query_id)
SELECT query_id * 3 + copy AS query_id, is_match, confidence, matched_references, NULL::VARCHAR AS error, 1 AS n_answers
FROM judged CROSS JOIN range(3) c(copy)"""
ORACLES["detect_sampled_context_parts"] = """
WITH held AS (
  SELECT i.item_id AS query_id, s.rank, contains(s.text, i.text) AS hit FROM benchmark i CROSS JOIN (
    SELECT text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)::INT AS rank FROM documents QUALIFY rank <= 1000) s)
SELECT query_id, 'sampled_context' AS method, bool_or(hit) AS is_match, bool_or(hit)::INT::DOUBLE AS confidence,
       count(*)::INT AS context_size, coalesce(string_agg(rank::VARCHAR, ' ' ORDER BY rank) FILTER (hit), '') AS matched_references,
       NULL::VARCHAR AS error, NULL::VARCHAR AS matches
FROM held GROUP BY query_id"""

# --- labelled sets ----------------------------------------------------------------------


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"round(CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE {both} / (len({a}) + len({b}) - {both}) END, 6)"


NEXT = f"""
w AS (SELECT doc_id, text, {words('text')} AS ws FROM documents),
pairs AS (SELECT a.doc_id, a.ws AS x, b.ws AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
"""
ORACLES["token_jaccard_pairs"] = f"WITH {NEXT} SELECT doc_id, {jaccard('x', 'y')} AS jaccard FROM pairs"
ORACLES["validate_positive"] = f"""WITH {TERMS}, {HASHED}, {NEXT},
sim AS (SELECT a.doc_id, sum(a.value * b.value) AS s FROM doc_unit a JOIN doc_unit b ON b.doc_id = a.doc_id + 1 AND b.bucket = a.bucket GROUP BY ALL),
scored AS (SELECT doc_id, round(coalesce(s, 0), 6) AS structure_similarity, {jaccard('x', 'y')} AS token_jaccard FROM pairs LEFT JOIN sim USING (doc_id))
SELECT *, structure_similarity >= 0.75 AND token_jaccard >= 0.1 AS is_valid FROM scored"""
ORACLES["validate_negative"] = f"""WITH {VECTORS},
p AS (SELECT vec_id, v, list_reverse(v) AS g FROM unit),
o AS (SELECT vec_id, g, round(list_inner_product(v, g), 6) AS s FROM p),
m AS (SELECT o.vec_id, max(round(list_inner_product(o.g, unit.v), 6)) AS m FROM o CROSS JOIN unit WHERE o.s <= 0.4 GROUP BY ALL)
SELECT o.vec_id AS case_id, s AS original_similarity, coalesce(m, 1) AS max_corpus_similarity,
       s <= 0.4 AND coalesce(m, 1) <= 0.4 AS is_valid
FROM o LEFT JOIN m USING (vec_id)"""
ORACLES["sample_originals"] = "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 30"
CANDIDATES = f"""
raw AS (
  SELECT doc_id AS src_id, text, 1 AS label, 1 AS attempt, upper(translate(text, 'aeiou', '     ')) AS candidate FROM documents
  UNION ALL SELECT doc_id, text, 1, 2, translate(text, 'ae', 'xy') FROM documents
  UNION ALL SELECT doc_id, text, 1, 3, 'copy of ' || text FROM documents
  UNION ALL SELECT doc_id, text, 1, 4, text FROM documents
  UNION ALL SELECT doc_id, d.text, 0, a, b.text
    FROM documents d CROSS JOIN range(1, 4) r(a) JOIN benchmark b ON b.item_id = (d.doc_id + a) % (SELECT count(*) FROM benchmark)),
split AS (SELECT src_id, label, attempt::INT AS attempt, {words('text')} AS x, {words('candidate')} AS y FROM raw),
scored AS (SELECT src_id, label, attempt, {jaccard('x', 'y')} AS jaccard FROM split),
valid AS (SELECT * FROM scored WHERE CASE WHEN label = 1 THEN jaccard >= 0.1 AND attempt <= 3 ELSE jaccard < 0.1 AND attempt <= 5 END),
best AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY src_id, label ORDER BY attempt) = 1)
"""
ORACLES["candidate_rounds"] = f"""
WITH raw AS (
  SELECT doc_id AS src_id, text, unnest([
    {{'label': 1, 'attempt': 1, 'code': translate(text, 'aeiou', '     '), 'error': NULL}},
    {{'label': 1, 'attempt': 2, 'code': CASE WHEN NOT starts_with(text, 'a') THEN translate(text, 'ae', 'xy') END,
      'error': CASE WHEN starts_with(text, 'a') THEN 'no copy of this' END}},
    {{'label': 1, 'attempt': 3, 'code': 'copy of ' || text, 'error': NULL}},
    {{'label': 0, 'attempt': 1, 'code': text, 'error': NULL}}, {{'label': 0, 'attempt': 2, 'code': 'copy of ' || text, 'error': NULL}},
    {{'label': 0, 'attempt': 3, 'code': translate(text, 'ae', 'xy'), 'error': NULL}},
    {{'label': 0, 'attempt': 4, 'code': NULL, 'error': 'nothing generated'}}, {{'label': 0, 'attempt': 5, 'code': 'nothing of this', 'error': NULL}}]) AS c
  FROM documents),
split AS (SELECT src_id, c.label, c.attempt, c.code, c.error, {words('text')} AS x, {words("coalesce(c.code, '')")} AS y FROM raw),
scored AS (SELECT src_id, label, attempt, code, error, CASE WHEN code IS NOT NULL THEN {jaccard('x', 'y')} END AS jaccard FROM split),
valid AS (SELECT *, coalesce(CASE WHEN label = 1 THEN jaccard >= 0.1 ELSE jaccard < 0.1 END, false) AS is_valid FROM scored)
SELECT src_id, label::INT AS label, attempt::INT AS attempt, is_valid, jaccard, md5(code) AS code_md5, error FROM valid
QUALIFY coalesce(min(attempt) FILTER (is_valid) OVER (PARTITION BY src_id, label), 9) >= attempt"""
ORACLES["first_valid_candidate"] = f"WITH {CANDIDATES} SELECT src_id, label, attempt, jaccard FROM best"
ORACLES["candidate_stats"] = f"""WITH {CANDIDATES}
SELECT l.label, count(b.src_id) AS n_success, count(*) - count(b.src_id) AS n_fail
FROM documents d CROSS JOIN (SELECT unnest([0, 1])::INT AS label) l
LEFT JOIN best b ON b.src_id = d.doc_id AND b.label = l.label GROUP BY l.label"""
ORACLES["ragged_union"] = """
SELECT doc_id, quality AS label, CASE WHEN quality = 1 THEN doc_id / 8 END AS token_jaccard,
       CASE WHEN quality = 0 THEN doc_id / 4 END AS max_corpus_similarity FROM labels"""



def node_names(node: ast.AST) -> list[str]:
    return [type(node).__name__] + [n for child in ast.iter_child_nodes(node) for n in node_names(child)]


def trigrams(source: str) -> Counter:
    names = node_names(ast.parse(source))
    grams = Counter(" ".join(names[i : i + 3]) for i in range(len(names) - 2))
    out: Counter = Counter()
    for gram, n in grams.items():
        out[int(hashlib.md5(gram.encode()).hexdigest()[:7], 16) % 256] += n
    return out


def trigram_cosine(left: str, right: str) -> float:
    a, b = trigrams(left), trigrams(right)
    length = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return round(sum(v * b[k] for k, v in a.items()) / length, 6)


def example(template: str) -> str:
    return template.replace("<k>", "1").replace("<n>", "2")


# every part's module has the same shape, so its node names are one literal
NODES = node_names(ast.parse(example(MODULE)))
ORACLES["ast_fingerprint"] = f"""
SELECT p_partkey AS doc_id, {len(NODES)} AS n_nodes, md5({lit(' '.join(NODES))}) AS types_md5 FROM part"""
ORACLES["ast_similarity"] = f"""
SELECT p_partkey AS left_id, -p_partkey - 1 AS right_id, CASE WHEN p_size % 2 = 0
  THEN {trigram_cosine(example(MODULE), example(FUNCTION))} ELSE {trigram_cosine(example(MODULE), example('class A:' + chr(10) + METHOD))}
  END AS structure_similarity FROM part"""

ORACLES["rebuild_indexes"] = f"""
WITH now AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END AS text FROM documents
  UNION ALL SELECT -doc_id - 1, concat_ws(' ', lang, source) FROM documents)
SELECT doc_id, round(length(text) / sqrt(length(text)::DOUBLE ** 2 + 10000), 6) AS first_number, len({tokens('text')})::INT AS dl,
  CASE WHEN doc_id >= 0 AND doc_id % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS n_embedded
FROM now"""

# --- evaluation ---------------------------------------------------------------------------

ORACLES["case_labels"] = f"WITH {TERMS}, {CASES} SELECT case_id, y_true FROM cases"
ORACLES["evaluate"] = f"""WITH {LISTS}, {CONTAINED}, {CASES},
v AS ({verdicts('(SELECT * FROM dense WHERE rank <= 10)', 'dense_context')})
SELECT method, case_id, y_true,
  CASE WHEN case_id % 10 IN (3, 7) THEN 0 ELSE is_match::INT END AS y_pred,
  CASE WHEN case_id % 10 IN (3, 7) THEN 0 ELSE confidence END AS confidence,
  CASE case_id % 10 WHEN 3 THEN 'missing field' WHEN 7 THEN 'no verdict' END AS error
FROM cases JOIN v ON case_id = query_id"""
ORACLES["confusion_matrix"] = confusion(PREDICTIONS, "method")
ORACLES["metrics"] = metrics(PREDICTIONS, "method")
ORACLES["timing_summary"] = """
SELECT 'm' || (user_id % 4) AS method, round(avg(value) FILTER (event_type <> 'error'), 6) AS avg_time,
  round(sum(value) FILTER (event_type <> 'error'), 6) AS total_time, count_if(event_type = 'error')::BIGINT AS n_errors
FROM events GROUP BY 1"""
WRONG = f"""(SELECT *, CASE WHEN y_true = 0 THEN 'FP' ELSE 'FN' END AS error_type FROM {PREDICTIONS} WHERE y_true <> y_pred)"""
ORACLES["error_cases"] = f"SELECT * FROM {WRONG}"
ORACLES["error_report"] = f"""
SELECT method, error_type, count(*) AS n_cases, array_to_string(list_sort(list(case_id))[1:3], ' ') AS examples
FROM {WRONG} GROUP BY ALL"""
ORACLES["sweep_k"] = f"""WITH {LISTS}, {CONTAINED}, {CASES},
p AS (
  SELECT k, case_id, y_true, (coalesce(max(containment), 0) >= 0.8)::INT AS y_pred
  FROM cases CROSS JOIN (SELECT unnest([3, 5, 10])::INT AS k)
  LEFT JOIN dense ON query_id = case_id AND rank <= k LEFT JOIN shares USING (query_id, doc_id) GROUP BY ALL)
{metrics('p', 'k')}"""
ORACLES["sweep_threshold"] = f"""WITH {LISTS}, {CASES},
best AS (SELECT query_id, max(score) AS score FROM dense GROUP BY query_id),
p AS (
  SELECT threshold, case_id, y_true, (coalesce(score, 0) >= threshold)::INT AS y_pred
  FROM cases CROSS JOIN (SELECT unnest([0.7, 0.8, 0.9])::DOUBLE AS threshold) LEFT JOIN best ON query_id = case_id)
{metrics('p', 'threshold')}"""
ORACLES["sweep_rrf_k"] = f"""WITH {LISTS}, {CONTAINED}, {CASES},
ks AS (SELECT unnest([30, 60, 90])::INT AS rrf_k),
merged AS (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id, d.rank AS dr, s.rank AS sr
  FROM (SELECT * FROM dense WHERE rank <= 10) d FULL JOIN (SELECT * FROM sparse WHERE rank <= 10) s
    ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
scored AS (SELECT rrf_k, query_id, doc_id, round(coalesce(1.0::DOUBLE / (rrf_k + dr - 1), 0) + coalesce(1.0::DOUBLE / (rrf_k + sr - 1), 0), 9) AS score FROM merged, ks),
top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY rrf_k, query_id ORDER BY score DESC, doc_id) <= 5),
p AS (
  SELECT ks.rrf_k, case_id, y_true, (coalesce(max(containment), 0) >= 0.8)::INT AS y_pred
  FROM cases CROSS JOIN ks LEFT JOIN top ON top.rrf_k = ks.rrf_k AND top.query_id = case_id
  LEFT JOIN shares ON shares.query_id = top.query_id AND shares.doc_id = top.doc_id GROUP BY ALL)
{metrics('p', 'rrf_k')}"""
LONG = f"(UNPIVOT ({metrics(PREDICTIONS, 'method')}) ON accuracy, precision, recall, f1 INTO NAME metric VALUE value)"
ORACLES["metrics_pivot"] = "SELECT metric, " + ", ".join(
    f"max(value) FILTER (method = '{m}') AS {m}" for m in ("de", "en", "es", "fr")
) + f" FROM {LONG} GROUP BY metric"
ORACLES["metric_ranking"] = f"""
SELECT method, metric, value, rank() OVER (PARTITION BY metric ORDER BY value DESC)::INT AS position FROM {LONG}"""
ORACLES["full_evaluation"] = f"""WITH {HYBRID}, {CONTAINED}, {CASES}, {SAMPLED},
p AS (
  SELECT method, is_match::INT AS y_pred, y_true FROM cases JOIN (
    SELECT query_id, 'embedding' AS method, max(score) >= 0.8 AS is_match FROM dense WHERE rank <= 5 GROUP BY query_id
    UNION ALL SELECT query_id, method, is_match FROM ({verdicts('sampled', 'sampled_context')})
    UNION ALL SELECT query_id, method, is_match FROM ({verdicts('(SELECT * FROM dense WHERE rank <= 5)', 'dense_context')})
    UNION ALL SELECT query_id, method, is_match FROM ({verdicts('hybrid', 'hybrid_context')})) ON query_id = case_id)
SELECT *, {METRIC_COLUMNS}, NULL::DOUBLE AS avg_time, NULL::DOUBLE AS total_time, 0::BIGINT AS n_errors
FROM ({confusion('p', 'method')})"""
ORACLES["tradeoff"] = f"""
SELECT method, f1, avg_time FROM ({metrics(f'(SELECT p.* FROM {PREDICTIONS} p JOIN events ON event_id = case_id)', 'method')})
JOIN (SELECT method, round(avg(value), 6) AS avg_time FROM {PREDICTIONS} p JOIN events ON event_id = case_id GROUP BY method) USING (method)"""

# --- keyed table ------------------------------------------------------------------------------

LOG = """
e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, 'u' || user_id AS uname, round(value * 100)::BIGINT AS pay FROM events),
named AS (
  SELECT *, (['eng', 'ops', 'hr', 'sales'])[k % 4 + 1] AS urole FROM e),
log AS (
  SELECT event_id AS seq,
    CASE WHEN k = 13 THEN 'drop_table' ELSE CASE event_type WHEN 'signup' THEN 'add_employee' WHEN 'error' THEN 'delete_employee'
      WHEN 'purchase' THEN 'update_employee_salary' WHEN 'view' THEN 'get_employee_salary' ELSE 'get_employees' END END AS tool,
    CASE event_type
      WHEN 'signup' THEN CASE k
        WHEN 17 THEN '{"name": "' || uname || '", "role": "' || urole || '"}'
        WHEN 23 THEN '{"name": '
        WHEN 29 THEN '{"name": "' || uname || '", "role": "' || urole || '", "salary": "much"}'
        ELSE '{"name": "' || uname || '", "role": "' || urole || '", "salary": ' || pay || '}' END
      WHEN 'error' THEN CASE WHEN k = 19 THEN '{"name": "' || uname || '", "force": true}' ELSE '{"name": "' || uname || '"}' END
      WHEN 'purchase' THEN '{"name": "' || uname || '", "salary": ' || pay || '}'
      WHEN 'view' THEN '{"name": "' || uname || '"}'
      ELSE CASE WHEN k % 2 = 0 THEN '{}' WHEN k = 21 THEN '{"role": ""}' ELSE '{"role": "' || urole || '"}' END END AS arguments
  FROM named),
tools AS (
  SELECT * FROM (VALUES
    ('init_db', []::VARCHAR[], []::VARCHAR[]),
    ('add_employee', ['name', 'role', 'salary'], ['name', 'role', 'salary']),
    ('delete_employee', ['name'], ['name']),
    ('get_employees', []::VARCHAR[], ['role']),
    ('get_employee_salary', ['name'], ['name']),
    ('update_employee_salary', ['name', 'salary'], ['name', 'salary'])) t(tool, required, allowed)),
parsed AS (
  SELECT seq, log.tool, required, allowed, json_valid(arguments) AS good,
    CASE WHEN json_valid(arguments) THEN json_keys(arguments) END AS ks,
    CASE WHEN json_valid(arguments) AND json_type(arguments, '$.name') = 'VARCHAR' THEN json_extract_string(arguments, '$.name') END AS name,
    CASE WHEN json_valid(arguments) AND json_type(arguments, '$.role') = 'VARCHAR' THEN json_extract_string(arguments, '$.role') END AS role,
    CASE WHEN json_valid(arguments) AND json_type(arguments, '$.salary') IN ('BIGINT', 'UBIGINT')
      THEN TRY_CAST(json_extract_string(arguments, '$.salary') AS BIGINT) END AS salary
  FROM log LEFT JOIN tools ON tools.tool = log.tool),
commands AS (
  SELECT seq, tool, name, role, salary,
    CASE WHEN allowed IS NULL THEN 'Unknown tool: ' || tool
      WHEN NOT good THEN 'Invalid arguments: not a JSON object'
      WHEN len(list_filter(required, lambda x: NOT list_contains(ks, x))) > 0 THEN 'Invalid arguments: missing argument'
      WHEN len(list_filter(ks, lambda x: NOT list_contains(allowed, x))) > 0 THEN 'Invalid arguments: unexpected argument'
      WHEN list_contains(required, 'name') AND name IS NULL OR list_contains(required, 'role') AND role IS NULL
        OR list_contains(required, 'salary') AND salary IS NULL THEN 'Invalid arguments: bad value' END AS error
  FROM parsed)
"""

REPLAY = f"""{LOG},
keyed AS (
  SELECT seq, tool, name, role, salary, NULL::BIGINT AS base_id FROM commands
  WHERE error IS NULL AND tool IN ('add_employee', 'delete_employee', 'get_employee_salary', 'update_employee_salary')
  UNION ALL
  SELECT -1, 'add_employee', 'u' || s_suppkey, 'ops', round(s_acctbal * 100)::BIGINT, s_suppkey + 1 FROM supplier),
judged AS (
  SELECT *, CASE WHEN tool = 'add_employee' THEN NOT present ELSE present END AS ok FROM (
    SELECT *, coalesce(last_value(CASE tool WHEN 'add_employee' THEN true WHEN 'delete_employee' THEN false END IGNORE NULLS)
      OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS present FROM keyed)),
numbered AS (
  SELECT *, CASE WHEN base_id IS NOT NULL THEN base_id
    WHEN tool = 'add_employee' AND ok THEN (SELECT max(s_suppkey) + 1 FROM supplier)
      + sum(CASE WHEN tool = 'add_employee' AND ok AND base_id IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) END::BIGINT AS id
  FROM judged),
replayed AS (
  SELECT *,
    last_value(CASE WHEN tool = 'add_employee' AND ok THEN id END IGNORE NULLS) OVER w AS old_id,
    last_value(CASE WHEN tool = 'add_employee' AND ok THEN role END IGNORE NULLS) OVER w AS old_role,
    last_value(CASE WHEN tool IN ('add_employee', 'update_employee_salary') AND ok THEN salary END IGNORE NULLS) OVER w AS old_salary
  FROM numbered WINDOW w AS (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
outcome AS (
  SELECT seq, tool, CASE WHEN ok THEN 'success' ELSE 'error' END AS status,
    CASE WHEN tool = 'add_employee' AND ok THEN 'Added ' || name || ' with ID ' || id
      WHEN tool = 'add_employee' THEN 'Employee ' || name || ' already exists'
      WHEN NOT ok THEN 'Employee ' || name || ' not found'
      WHEN tool = 'delete_employee' THEN 'Deleted ' || name
      WHEN tool = 'update_employee_salary' THEN 'Updated ' || name || '''s salary to $' || salary END AS message,
    CASE WHEN tool = 'get_employee_salary' AND ok THEN old_salary END AS salary
  FROM replayed WHERE seq >= 0
  UNION ALL
  SELECT seq, tool, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END,
    coalesce(error, CASE WHEN tool = 'init_db' THEN 'Database initialized' END), NULL
  FROM commands WHERE error IS NOT NULL OR tool IN ('init_db', 'get_employees')),
versions AS (
  SELECT coalesce(id, old_id) AS id, name, CASE WHEN tool = 'add_employee' THEN role ELSE old_role END AS role, salary,
         seq AS valid_from, valid_to
  FROM (SELECT *, lead(seq) OVER (PARTITION BY name ORDER BY seq) AS valid_to FROM replayed
        WHERE ok AND tool IN ('add_employee', 'delete_employee', 'update_employee_salary'))
  WHERE tool <> 'delete_employee')
"""
ORACLES["validate_commands"] = f"WITH {LOG} SELECT * FROM commands"
ORACLES["replay_statuses"] = f"WITH {REPLAY} SELECT * FROM outcome"
ORACLES["replay_summary"] = f"WITH {REPLAY} SELECT tool, status, count(*) AS n_commands FROM outcome GROUP BY ALL"
ORACLES["replay_sparse_positions"] = f"WITH {REPLAY} SELECT * REPLACE (seq * 1000000000 AS seq) FROM outcome"
ORACLES["replay_one_status_per_command"] = """
WITH e AS (SELECT event_id AS seq, event_id % 10 AS kind, 'u' || user_id AS name FROM events),
adds AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) = 1 AS first,
    CASE kind WHEN 4 THEN 1000000000000000000 + seq ELSE seq END AS pay
  FROM e WHERE kind IN (4, 6)),
held AS (SELECT *, row_number() OVER (ORDER BY seq) AS id FROM adds WHERE first)
SELECT e.seq,
  CASE WHEN e.kind = 0 THEN NULL WHEN e.kind IN (3, 9) THEN 'get_employee_salary' ELSE 'add_employee' END AS tool,
  CASE WHEN h.seq = e.seq OR e.kind = 9 AND h.seq < e.seq THEN 'success' ELSE 'error' END AS status,
  CASE WHEN e.kind = 0 THEN 'Unknown tool: null'
    WHEN e.kind IN (1, 2, 5) THEN 'Invalid arguments: bad value'
    WHEN e.kind IN (3, 7, 8) THEN 'Invalid arguments: not a JSON object'
    WHEN e.kind IN (4, 6) AND h.seq = e.seq THEN 'Added ' || e.name || ' with ID ' || h.id
    WHEN e.kind IN (4, 6) THEN 'Employee ' || e.name || ' already exists'
    WHEN e.kind = 9 AND coalesce(h.seq < e.seq, false) THEN NULL ELSE 'Employee ' || e.name || ' not found' END AS message,
  CASE WHEN e.kind = 9 AND h.seq < e.seq THEN h.pay END AS salary
FROM e LEFT JOIN held h ON h.name = e.name"""
ORACLES["replay_final_table"] = f"WITH {REPLAY} SELECT id, name, role, salary FROM versions WHERE valid_to IS NULL"
ORACLES["replay_asof_lookup"] = f"""WITH {REPLAY}
SELECT seq, name, ok AS found, CASE WHEN ok THEN old_salary END AS salary FROM replayed WHERE tool = 'get_employee_salary'"""
ORACLES["replay_asof_snapshot"] = f"""WITH {REPLAY},
calls AS (SELECT seq, nullif(role, '') AS role FROM commands WHERE error IS NULL AND tool = 'get_employees')
SELECT c.seq, c.role, count(v.name) AS n_rows, coalesce(sum(v.salary), 0)::BIGINT AS salary_total
FROM calls c LEFT JOIN versions v ON v.valid_from < c.seq AND (v.valid_to IS NULL OR v.valid_to >= c.seq)
  AND (c.role IS NULL OR v.role = c.role)
GROUP BY c.seq, c.role"""
ORACLES["tables_as_of"] = f"""WITH {REPLAY},
calls AS (SELECT seq AS position, nullif(role, '') AS asked_role FROM commands WHERE error IS NULL AND tool = 'get_employees')
SELECT position, asked_role, count(*) AS n_rows, sum(id)::BIGINT AS id_total, sum(salary)::BIGINT AS salary_total,
  min(name) AS first_name, max(name) AS last_name, count(DISTINCT role) AS n_roles
FROM calls JOIN versions v ON v.valid_from < position AND (v.valid_to IS NULL OR v.valid_to >= position)
  AND (asked_role IS NULL OR v.role = asked_role)
GROUP BY position, asked_role"""
ORACLES["replay_in_two_parts"] = ORACLES["replay_statuses"]
ORACLES["replay_in_two_parts_lists"] = ORACLES["replay_asof_snapshot"]
ORACLES["replay_in_two_parts_table"] = ORACLES["replay_final_table"]
ORACLES["replay_row_versions"] = f"WITH {REPLAY} SELECT * FROM versions"
ORACLES["replay_table_as_of"] = f"""WITH {REPLAY},
middle AS (SELECT floor(max(seq) / 2) AS point FROM commands)
SELECT id, name, role, salary FROM versions, middle WHERE valid_from < point AND (valid_to IS NULL OR valid_to >= point)"""
STAFF = """
staff AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role, round(c_acctbal * 100)::BIGINT AS salary FROM customer),
requests AS (SELECT event_id AS seq, event_type, 'Customer#' || lpad((user_id * 25)::VARCHAR, 9, '0') AS name, 'NEW' AS role,
  round(value * 100)::BIGINT AS salary FROM events)
"""
ORACLES["create_table_once"] = f"WITH {STAFF} SELECT * FROM staff"
ORACLES["apply_adds"] = f"""WITH {STAFF},
fresh AS (SELECT * FROM requests WHERE event_type = 'signup' AND name NOT IN (SELECT name FROM staff)
          QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1)
SELECT (SELECT max(id) FROM staff) + row_number() OVER (ORDER BY seq) AS id, name, role, salary FROM fresh"""
ORACLES["apply_deletes"] = f"""WITH {STAFF}
SELECT * FROM staff WHERE name NOT IN (SELECT name FROM requests WHERE event_type = 'error')"""
ORACLES["apply_updates"] = f"""WITH {STAFF},
last AS (SELECT name, max_by(salary, seq) AS pay FROM requests WHERE event_type = 'purchase' GROUP BY name)
SELECT id, name, role, coalesce(pay, salary) AS salary FROM staff LEFT JOIN last USING (name)"""
ORACLES["filter_optional"] = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'"
ORACLES["filter_optional_empty"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"
ORACLES["point_lookups"] = f"""WITH {STAFF},
asked AS (SELECT DISTINCT name FROM requests WHERE event_type = 'view')
SELECT a.name, CASE WHEN s.name IS NULL THEN 'error' ELSE 'success' END AS status,
  CASE WHEN s.name IS NULL THEN 'Employee ' || a.name || ' not found' END AS message, s.salary
FROM asked a LEFT JOIN staff s USING (name)"""

# --- transcripts --------------------------------------------------------------------------------

TRANSCRIPT = """
every AS (
  SELECT conv_id, turn, role, text AS content FROM conversations
  UNION ALL
  SELECT conv_id, min(turn) - 1, 'system', 'default' FROM conversations GROUP BY conv_id HAVING count_if(role = 'system') = 0),
lines AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM every)
"""
ORACLES["assemble_transcripts"] = f"""WITH {TRANSCRIPT}
SELECT conv_id, position, turn, role, md5(content) AS content_md5 FROM lines"""
ORACLES["transcript_pages"] = f"""WITH {TRANSCRIPT}
SELECT conv_id, position // 3 AS page, count(*)::INT AS n_messages, string_agg(role, ' ' ORDER BY position) AS roles,
  md5(string_agg(content, '|' ORDER BY position)) AS content_md5,
  string_agg(CASE role WHEN 'assistant' THEN 'c' || turn ELSE '-' END, ' ' ORDER BY position) AS calls,
  string_agg(CASE role WHEN 'user' THEN 'u' || turn ELSE '-' END, ' ' ORDER BY position) AS answers FROM lines GROUP BY ALL"""
ORACLES["pair_tool_calls"] = """
WITH calls AS (
  SELECT conv_id, turn, 'call-' || turn || s AS tool_call_id, 'get_employee_salary' AS tool,
         '{"name": "u' || turn || '"}' AS arguments, s
  FROM conversations CROSS JOIN (SELECT unnest(['a', 'b']) AS s) WHERE role = 'assistant')
SELECT c.conv_id, c.turn, tool_call_id, tool, arguments, md5(m.text) AS result_md5
FROM calls c LEFT JOIN conversations m ON m.conv_id = c.conv_id AND m.turn = c.turn + 1 AND m.role = 'user' AND c.s = 'a'"""
