import pytest

from kinspot.operators import labelset as ls
from kinspot.operators import transcript as tr
from kinspot.sources import code_files as cf
from kinspot.sources import tables as tb

MODULE = '''import os


def pub(a):
    """Doc."""
    def inner(b):
        return b
    return inner(a)


def _priv():
    pass


async def co():
    pass


class C:
    @property
    def meth(self):
        return 1  # trailing
'''


def test_extraction(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "m.py").write_text(MODULE)
    (tmp_path / "bad.py").write_text("def broken(:\n")
    (tmp_path / "latin.py").write_bytes(b"def caf\xe9(x):\n    return x\n")
    (tmp_path / "other.txt").write_text("def no():\n    pass\n")
    files = cf.scan_files(spark, str(tmp_path))
    assert files.count() == 3
    got = {r.function_name: r for r in cf.extract_functions(files, 0, 10**6).collect()}
    assert set(got) == {"pub", "inner", "meth", "caf"}
    assert got["meth"].code == "    def meth(self):\n        return 1  # trailing"
    assert got["inner"].code == "    def inner(b):\n        return b"
    assert got["pub"].id == "m.py::pub::4" and got["pub"].file_path.endswith("/a/b/m.py")
    # def meth ( self ) : return 1 # trailing
    assert [r.function_name for r in cf.extract_functions(files, 10, 10).collect()] == ["meth"]


def test_same_name_in_two_folders_keeps_two_ids(spark):
    rows = [("x/m.py", bytearray(b"def f():\n    pass\n")), ("y/m.py", bytearray(b"def f():\n    pass\n"))]
    got = cf.extract_functions(spark.createDataFrame(rows, "file_path string, content binary"), 0, 100).collect()
    assert len({r.id for r in got}) == 1 and len({r.doc_id for r in got}) == 2


def test_corpus_round_trips(spark, tmp_path):
    rows = [("m.py::f::1", 'def f():\n  return "a,b"\n', "x/m.py", "f", 9), ("n", "", "y", "g", 30)]
    corpus = spark.createDataFrame(rows, tb.CORPUS_SCHEMA)
    for fmt in ("parquet", "csv", "json"):
        path = str(tmp_path / fmt)
        tb.write_corpus(corpus, path, fmt)
        back = {tuple(x or "" for x in r) for r in tb.read_corpus(spark, path, fmt).collect()}
        assert back == {tuple(r) for r in rows}, fmt


def test_union_keeps_ids_stable(spark):
    a = spark.createDataFrame([("a", 1), ("a", 2)], "part string, key bigint")
    b = spark.createDataFrame([("b", 1)], "part string, key bigint")
    ids = {(r.part, r.key): r.doc_id for r in tb.union_corpora(a, b).collect()}
    assert len(set(ids.values())) == 3
    assert {(r.part, r.key): r.doc_id for r in tb.union_corpora(b, a).collect()} == ids


def test_fingerprints_and_structure(spark):
    texts = [(1, "x = 1"), (2, "y = 2"), (3, "for i in z:\n    print(i)"), (4, "def ("), (5, "")]
    prints = ls.fingerprints(spark.createDataFrame(texts, "doc_id bigint, text string"))
    got = {r.doc_id: r.node_types for r in prints.collect()}
    assert got[1] == ["Module", "Assign", "Name", "Store", "Constant"] and got[4] is None and got[5] == ["Module"]
    vectors = ls.structure_vectors(prints)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "left_id bigint, right_id bigint")
    sims = {r.right_id: r.structure_similarity for r in ls.structure_similarity(pairs, vectors).collect()}
    assert sims[2] == 1.0 and sims[3] < 1.0 and sims[4] == 0.0


def test_negative_validation_stops_at_the_original(spark):
    pairs = spark.createDataFrame(
        [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 1.0]), (3, [1.0, 0.0], [0.0, -1.0])],
        "case_id bigint, original_vec array<double>, generated_vec array<double>",
    )
    index = spark.createDataFrame([(1, [0.0, 1.0])], "doc_id bigint, unit_vec array<double>")
    got = {r.case_id: tuple(r)[1:] for r in ls.validate_negative(pairs, index).collect()}
    assert got == {1: (1.0, 1.0, False), 2: (0.0, 1.0, False), 3: (0.0, -1.0, True)}


def test_first_valid_respects_attempt_limits(spark):
    rows = [(1, 1, 3, True, "c"), (1, 1, 2, False, "b"), (2, 1, 4, True, "late"), (1, 0, 5, True, "e"), (2, 0, 6, True, "f")]
    candidates = spark.createDataFrame(rows, "src_id bigint, label int, attempt int, is_valid boolean, text string")
    best = ls.first_valid(candidates)
    assert {tuple(r) for r in best.collect()} == {(1, 1, 3, "c"), (1, 0, 5, "e")}
    stats = ls.candidate_stats(spark.createDataFrame([(1,), (2,)], "src_id bigint"), best)
    assert {tuple(r) for r in stats.collect()} == {(1, 1, 1), (0, 1, 1)}


@pytest.mark.parametrize("span", [2, 1000])
def test_transcripts(spark, span):
    rows = [(1, t, r, f"m{t}") for t, r in enumerate(["user", "assistant", "tool", "assistant"])]
    rows += [(2, 0, "system", "own"), (2, 1, "user", "hi")]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")
    got = tr.assemble(messages, "default", span)
    first = {r.conv_id: r.content for r in got.where("position = 0").collect()}
    assert first == {1: "default", 2: "own"} and got.count() == 7
    pages = {(r.conv_id, r.page): [m.position for m in r.messages] for r in tr.pages(got, 3).collect()}
    assert pages == {(1, 0): [0, 1, 2], (1, 1): [3, 4], (2, 0): [0, 1]}


def test_tool_calls_find_their_results(spark):
    schema = (
        "conv_id bigint, turn bigint, role string, content string, "
        "tool_calls array<struct<id string, name string, arguments string>>, tool_call_id string"
    )
    rows = [
        (1, 1, "assistant", None, [("a", "f", "{}"), ("b", "g", "{}")], None),
        (1, 2, "tool", "ok", None, "a"),
        (1, 3, "assistant", "done", None, None),
        (2, 1, "tool", "foreign", None, "b"),
    ]
    got = {r.tool_call_id: r.result for r in tr.pair_calls(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "ok", "b": None}


def test_source_files_stay_small_and_are_parsed_one_at_a_time(spark, tmp_path, monkeypatch):
    import checks.queries as cq

    monkeypatch.setattr(cq, "FILE_MODULES", 10)
    modules = spark.range(200).selectExpr("id AS p_partkey", "concat('def f', id, '(x):\n    return x\n') AS content")
    cq._write_modules(modules, str(tmp_path / "few"), 4)
    files = cf.scan_files(spark, str(tmp_path))
    assert files.count() >= 15  # 20 are written, some may be empty
    assert cf.extract_functions(files, 0, 100).count() == 200


def test_functions_in_every_kind_of_block():
    text = "\n".join((
        "if a:", "    def f(): pass", "else:", "    def g(): pass", "try:", "    def h(): pass", "except E:", "    def i(): pass",
        "else:", "    def j(): pass", "finally:", "    def k(): pass", "match a:", "    case 1:", "        def l(): pass",
        "with a:", "    for b in c:", "        class D:", "            async def m():", "                def n(): pass", "x = lambda: 0 if a else 1",
    ))
    import ast

    walked = [n.name for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef)]
    assert [name for name, *_ in cf.defined_functions(text)] == walked and len(walked) == 8
