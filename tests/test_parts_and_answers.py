"""Contexts in parts, answers asked once, candidates in rounds, files parsed once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from kinspot.functions.text import tokenize
from kinspot.operators import answers as an
from kinspot.operators import labelset as ls
from kinspot.operators import parts as pt
from kinspot.operators.embedding import embed_column, embed_missing
from kinspot.operators.judge import build_prompts, reference_text
from kinspot.operators.rounds import candidate_rounds
from kinspot.plans.indexing import build_indexes
from kinspot.plans.labelled_set import generate_labelled_set
from kinspot.sources.changed_files import scan_changed_files
from kinspot.sources.code_files import extract_functions, scan_files


def table(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def holding():
    """A judge that says which references hold the query's text; a query ``bad`` fails, one named ``odd`` gets no JSON."""

    def judge(prompts):
        out = []
        for p in prompts:
            asked, rest = p.split("\n\nREFERENCE CODES:\n", 1)
            query = asked.split("QUERY CODE:\n```python\n", 1)[1].rsplit("\n```", 1)[0]
            references = rest.split("\n\nDetermine:")[0].split("\n\n---\n\n")
            if query == "bad" and "r7 " in rest:
                raise RuntimeError("no answer")
            held = [i + 1 for i, r in enumerate(references) if query in r]
            answer = {"is_plagiarized": bool(held), "confidence": len(held) / 10, "matched_references": [*held, 99], "explanation": f"of {len(held)}"}
            out.append("what?" if query == "odd" else json.dumps(answer))
        return out

    return judge


# --- parts ---------------------------------------------------------------------------


def test_no_part_is_over_its_room_and_nothing_is_lost(spark):
    texts = [f"r{i} " + "word, " * (7 * i % 40) + "end" for i in range(60)] + [" a\tb \n " * 300, "", None, "x" * 5000, "\n\n"]
    references = table(spark, [(i + 1, t) for i, t in enumerate(texts)], "rank int, text string").repartition(4)
    room = 200
    parts = pt.deal_parts(references, room).collect()
    sizes = spark.createDataFrame([(r.part, r.references) for r in parts], "part long, t string").select(F.size(tokenize("t")).alias("n")).collect()
    assert len(parts) > 15 and max(r.n for r in sizes) <= room
    assert [n for r in sorted(parts) for n in r.ranks] == sorted(n for r in parts for n in r.ranks)
    listed = {}
    for r in sorted(parts):
        blocks = r.references.split("\n\n---\n\n")
        assert len(blocks) == len(r.ranks) and all(b.startswith(f"REFERENCE {i}:\n") for i, b in enumerate(blocks, 1))
        for rank, b in zip(r.ranks, blocks):
            listed[rank] = listed.get(rank, "") + b.split(":\n```python\n", 1)[1].rsplit("\n```", 1)[0]
    assert listed == {i + 1: t or "" for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="no room"):
        pt.deal_parts(references, 40)


def test_one_part_gives_the_prompt_of_one_context(spark):
    queries = table(spark, [(1, "q one"), (2, None)], "query_id bigint, text string")
    contexts = table(spark, [(q, r, t) for q in (1, 2) for r, t in ((1, "a"), (2, None), (3, "c d"))], "query_id bigint, rank int, text string")
    seen = {r.query_id: (r.context_size, r.prompt) for r in build_prompts(queries, contexts).collect()}
    assert all(n == 3 and p.count("REFERENCE ") == 5 and "REFERENCE 2:\n```python\n\n```" in p for n, p in seen.values())
    got = pt.ask_parts(queries, pt.deal_parts(contexts.where("query_id = 1").select("rank", "text"), 1000), lambda prompts: prompts)
    assert {r.query_id: r.response for r in got.collect()} == {q: p for q, (_, p) in seen.items()}
    assert spark.range(1).select(reference_text(F.lit(4), F.lit(None).cast("string")).alias("t")).first().t == "REFERENCE 4:\n```python\n\n```"


def test_verdicts_merge_the_parts(spark):
    references = table(spark, [(i + 1, f"r{i} needle{i // 10} end") for i in range(40)], "rank int, text string")
    queries = table(
        spark, [(1, "needle2"), (2, "r3 needle0"), (3, "nowhere"), (4, "bad"), (5, "long " * 200), (6, "odd"), (7, "needle0 end"), (8, "end")], "query_id bigint, text string"
    )
    got = {r.query_id: r for r in pt.judge_in_parts(queries, references, holding(), budget=450, query_budget=100).collect()}
    want = {q: [i + 1 for i in range(40) if t in f"r{i} needle{i // 10} end"] for q, t in ((1, "needle2"), (2, "r3 needle0"), (7, "needle0 end"), (8, "end"))}
    assert {q: got[q].matched_references for q in want} == want and all(got[q].is_match for q in want)
    assert got[3].is_match is False and got[3].confidence == 0 and got[3].error is None
    assert got[4].is_match is None and got[4].error == "no answer"
    assert got[5].error == "query of more than 100 tokens" and len(got) == 8
    assert got[6].is_match is False and got[6].explanation == "Parse error"
    assert got[8].confidence == int(got[8].explanation.split()[1]) / 10 > 0 and got[1].elapsed > 0
    none = pt.judge_in_parts(queries, references.where("false"), holding(), budget=450, query_budget=100).collect()
    assert len(none) == 8 and not any(r.is_match for r in none)


# --- answers ---------------------------------------------------------------------------


def test_prompts_are_asked_once_across_runs(spark, tmp_path):
    path, calls, down = str(tmp_path / "answers"), spark.sparkContext.accumulator(0), str(tmp_path / "down")
    open(down, "w").close()

    def judge(prompts):
        calls.add(len(prompts))
        if os.path.exists(down) and any(p.startswith("p3") for p in prompts):
            raise RuntimeError("model is down")
        return [f"answer to {p}" for p in prompts]

    prompts = table(spark, [(i, f"p{i % 10}") for i in range(40)] + [(90, None), (91, "")], "query_id bigint, prompt string")
    first = {r.query_id: (r.response, r.error) for r in an.ask_once(prompts, judge, path, "m", batch_size=1, slice_prompts=4).collect()}
    assert calls.value == 11 and first[3] == (None, "model is down") and first[25] == ("answer to p5", None) and first[90] == first[91] == ("answer to ", None)
    os.remove(down)
    again = {r.query_id: (r.response, r.error) for r in an.ask_once(prompts, judge, path, "m", batch_size=1).collect()}
    assert calls.value == 12 and again[33] == ("answer to p3", None) and all(again[i] == first[i] for i in first if i % 10 != 3)
    an.ask_once(prompts, judge, path, "another model", batch_size=1).count()
    assert calls.value == 23
    assert an.ask_once(prompts.where("false"), judge, path, "m").count() == 0 and calls.value == 23


def test_slices_before_a_failure_are_kept(spark, tmp_path, monkeypatch):
    path, calls = str(tmp_path / "answers"), spark.sparkContext.accumulator(0)

    def judge(prompts):
        calls.add(len(prompts))
        return [p.upper() for p in prompts]

    asked, ask = [], an.ask_judge

    def failing(part, *rest):
        asked.append(1)
        if len(asked) == 3:
            raise RuntimeError("driver lost")
        return ask(part, *rest)

    prompts = table(spark, [(i, f"p{i}") for i in range(30)], "query_id bigint, prompt string")
    monkeypatch.setattr(an, "ask_judge", failing)
    with pytest.raises(RuntimeError, match="driver lost"):
        an.ask_once(prompts, judge, path, "m", slice_prompts=6)
    kept = an.answer_table(spark, path).count()
    monkeypatch.setattr(an, "ask_judge", ask)
    assert kept == calls.value > 0 and an.ask_once(prompts, judge, path, "m").count() == 30 and calls.value == 30


def test_two_writers_of_a_key_are_settled(spark):
    rows = [("k", "m", r, None, 1.0, at, run) for r, at, run in (("b", 5, "x"), ("a", 5, "y"), ("first?", 9, "z"))] + [("k", "m", None, "down", 1.0, 1, "w"), ("k", "n", "other", None, 1.0, 0, "v")]
    held = table(spark, rows, "key string, model string, response string, error string, elapsed double, at long, run string")
    held = held.withColumn("asked_at", F.timestamp_seconds("at"))
    assert [tuple(r) for r in an.settled_answers(held, "m").collect()] == [("k", "a", 1.0)]


# --- embeddings -----------------------------------------------------------------------


def test_null_texts_and_failing_texts(spark, tmp_path):
    path, calls = str(tmp_path / "embeddings"), spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        if any(t == "bad" for t in texts):
            raise RuntimeError("cannot embed")
        return [[float(len(t)), 1.0] for t in texts]

    docs = table(spark, [(1, "a"), (2, None), (3, "bad"), (4, "")], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.embedding, r.error) for r in embed_column(docs, embed).collect()}
    assert got == {1: ([1, 1], None), 2: ([0, 1], None), 3: (None, "cannot embed"), 4: ([0, 1], None)}
    assert {r.doc_id for r in embed_missing(docs, path, embed).collect()} == {1, 2, 4}
    before = calls.value
    assert {r.doc_id for r in embed_missing(docs, path, embed).collect()} == {1, 2, 4} and calls.value == before + 1
    assert spark.read.parquet(path).where("embedding IS NOT NULL").count() == 3
    assert {tuple(r) for r in spark.read.parquet(path).where("error IS NOT NULL").select("doc_id", "error").collect()} == {(3, "cannot embed")}


# --- rounds ----------------------------------------------------------------------------


def test_originals_that_are_accepted_are_not_asked_again(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def generator(rows):
        asked.add(len(rows))
        if any(code == "boom" and attempt == 1 for code, _, attempt in rows):
            raise RuntimeError("refused")
        return [None if code == "never" else f"{code} {label} {attempt}" for code, label, attempt in rows]

    def check(made):
        want = F.when(F.col("code").startswith("late"), 3).otherwise(F.when(F.col("label") == 1, 1).otherwise(2))
        return made.withColumn("score", F.col("attempt") * 0.5).withColumn("is_valid", F.col("attempt") >= want)

    originals = table(spark, [(1, "soon"), (2, "late"), (3, "boom"), (4, "never"), (5, None)], "src_id bigint, code string")
    rows = candidate_rounds(originals, generator, check, path=str(tmp_path / "rounds"), batch_size=1).collect()
    made = {}
    for r in rows:
        made.setdefault((r.src_id, r.label), []).append((r.attempt, r.is_valid, r.error))
    last = {key: max(v)[0] for key, v in made.items()}
    assert last == {(1, 1): 1, (1, 0): 2, (2, 1): 3, (2, 0): 3, (3, 1): 2, (3, 0): 2, (4, 1): 3, (4, 0): 5, (5, 1): 1, (5, 0): 2}
    assert all(len(v) == last[k] and sum(ok for _, ok, _ in v) <= 1 for k, v in made.items())
    assert asked.value == sum(last.values()) and sorted(made[3, 1]) == [(1, False, "refused"), (2, True, None)]
    assert {e for _, _, e in made[4, 0]} == {"nothing generated"}
    best = {(r.src_id, r.label): r.attempt for r in ls.first_valid(spark.createDataFrame(rows).drop("error")).collect()}
    assert best == {k: a for k, a in last.items() if k[0] != 4}
    assert candidate_rounds(originals.where("false"), generator, check).count() == 0


def test_a_labelled_set_is_generated_in_rounds(spark):
    corpus = table(spark, list(enumerate(["alpha beta gamma delta", "one two three four five", "red green blue"])), "doc_id bigint, text string")
    index = build_indexes(corpus)
    code = "def f(a):\n    return a + 1\n"
    originals = table(spark, [("s", code)], "src_id string, code string")

    def generator(rows):
        return [("not python (" if a == 1 else code) if label == 1 else (code if a < 3 else "zzz yyy xxx") for _, label, a in rows]

    accepted, attempts = generate_labelled_set(originals, generator, index)
    assert {(r.label, r.attempt, r.code) for r in accepted.collect()} == {(1, 2, code), (0, 3, "zzz yyy xxx")}
    assert sorted((r.label, r.attempt, r.is_valid) for r in attempts.collect()) == [(0, 1, False), (0, 2, False), (0, 3, True), (1, 1, False), (1, 2, True)]


# --- files -----------------------------------------------------------------------------


def function(name, extra=""):
    return f"def {name}(a, b):\n" + "".join(f"    a = a + b * {i}{extra}\n" for i in range(12)) + "    return a\n"


def test_only_changed_files_are_parsed(spark, tmp_path):
    root, store = tmp_path / "src", str(tmp_path / "store")
    (root / "deep").mkdir(parents=True)
    files = {"a.py": function("one"), "deep/b.py": function("two") + function("three"), "c.py": "no python (", "d.txt": function("four")}
    for i, (name, text) in enumerate(files.items()):
        (root / name).write_text(text)
        os.utime(root / name, (1_000_000 + i, 1_000_000 + i))

    def scan():
        got = sorted((r.file_path, r.function_name, r.code, r.doc_id) for r in scan_changed_files(spark, str(root), store).collect())
        assert got == sorted((r.file_path, r.function_name, r.code, r.doc_id) for r in extract_functions(scan_files(spark, str(root))).collect())
        return {g[1] for g in got}, spark.read.parquet(f"{store}/files").count()

    assert scan() == ({"one", "two", "three"}, 3)
    assert scan() == ({"one", "two", "three"}, 3)
    (root / "a.py").write_text(function("one", " + 1"))
    (root / "new.py").write_text(function("five"))
    os.utime(root / "new.py", (5, 5))  # older than all others
    (root / "deep/b.py").unlink()
    assert scan() == ({"one", "five"}, 5)
    empty = tmp_path / "none"
    empty.mkdir()
    assert scan_changed_files(spark, str(empty), str(tmp_path / "other")).count() == 0


def test_a_candidate_lies_on_disk_once(spark, tmp_path, monkeypatch):
    """Candidates stood in two tables, and the shuffle files of every round stayed beside them."""
    import pyarrow.parquet as pq
    from pyspark.sql import DataFrameWriter

    key, write, settings = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", DataFrameWriter.parquet, {}
    before = spark.conf.get(key, None)

    def parquet(self, target, *args, **options):
        settings[target.rsplit("/", 1)[-1]] = spark.conf.get(key, None)
        return write(self, target, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    originals = table(spark, [(i, f"text {i} " * 20) for i in range(50)] + [(3, "twice"), (None, "no id")], "src_id bigint, code string")
    check = lambda made: made.drop("code").withColumn("is_valid", F.col("attempt") >= 2)
    rows = candidate_rounds(originals, lambda asked: [f"{code} {label} {attempt}" for code, label, attempt in asked], check, path=str(tmp_path / "rounds"))
    codes = {}
    for file in (tmp_path / "rounds").rglob("*.parquet"):
        if {"code", "original"} & set(pq.read_schema(file).names):
            meta = pq.ParquetFile(file).metadata
            assert meta.num_rows == 0 or meta.row_group(0).column(meta.num_columns - 2).compression == "ZSTD"
            codes |= {file.parent.name: codes.get(file.parent.name, 0) + meta.num_rows} if meta.num_rows else {}
    # the id that comes twice: 4 candidates of a label, each beside 4 verdicts
    assert codes == {"originals": 52, "round-1": 2 * (49 + 16), "round-2": 2 * (49 + 16)}
    assert rows.count() == codes["round-1"] + codes["round-2"] and rows.where("attempt = 1 AND is_valid OR attempt = 2 AND NOT is_valid").isEmpty()
    assert rows.where("code IS NULL OR error IS NOT NULL").isEmpty() and rows.select("code").distinct().count() == 4 * 51
    assert {settings[name] for name in ("originals", "generated-1", "verdicts-1", "round-1", "round-2")} == {"true"}
    assert spark.conf.get(key, None) == before
