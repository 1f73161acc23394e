"""Token files, packing, chat, vectors, URLs: round trips, brute force and odd cases."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kinspot.llm import chat, encode, packing, permutation_index, queries, stage, token_store, url_filter

from . import cases

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = [
    None, "", " a  b\n\n c", "\n x", "a \n b", "tab\tx\n\ny  z ", "<|endoftext|> a<|endoftext|>b", "  x　y", "it's  'll d'été l'é's", "é́ é ́a", "a\0b \0c",
    "A B \x1c \x1dC", "×a÷b é×,", "1a2 b3.4é5", "rock'n'roll's", "x̸,̸a", "…,a…    b", "\n\n", "   ", "a'\n 's", "Éé,ß.ñ\n\nÀ  À", "İstanbul K ſ", "👩‍👩‍👧 emoji, ok!!",
]


def expected_ids(vocabulary, texts, end):
    t = Tokenizer.from_file(vocabulary)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


@pytest.mark.parametrize("vocabulary", [BYTE_BPE, WORD_BPE])
def test_units_encode_like_the_whole_text(vocabulary):
    rng = random.Random(4)
    alphabet = "aZé ×'9\n ,.<|>\t　ßñ…s"
    texts = ODD + [t for _, t in cases.DOCS] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    ids, bounds = encode.Encoder(vocabulary).encode(pa.array(texts, pa.string()))
    for i, want in enumerate(expected_ids(vocabulary, texts, 0)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want[:-1].tolist(), texts[i]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4096])
def test_perfect_hash_takes_every_slot_once(n):
    hashes = token_store._key_hash(np.random.default_rng(n).integers(-(2**63), 2**63, n))
    seeds, slot = token_store.perfect_hash(hashes)
    assert sorted(slot.tolist()) == list(range(n)) and (token_store.find_slots(hashes, seeds, n) == slot).all()


def test_token_index_reads_back_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 500)
    rows = [(i, t) for i, t in cases.DOCS if i is not None][1:] + [(100 - i, x) for i, x in enumerate(ODD)] + [(-5, "first of all")]
    rows = list(dict(rows).items())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.token_index(cases.docs(spark, rows).repartition(3), BYTE_BPE, 2).collect()}
    at, want = 0, {}
    ordered = sorted(rows)
    for (i, _), ids in zip(ordered, expected_ids(BYTE_BPE, [t for _, t in ordered], 2)):
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def test_every_row_is_read_back(spark, monkeypatch):
    """Repeated ids, a hot one over several shards, and rows without id."""
    monkeypatch.setattr(token_store, "SHARD_IDS", 40)
    rows = [(7, f"copy {i % 5}") for i in range(60)] + [(None, "no id"), (None, None), (None, "no id"), (3, ""), (9, "alone here"), (9, "alone here")]
    got = token_store.token_index(cases.docs(spark, rows).repartition(3), BYTE_BPE, 2).collect()
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    want = sorted((i is not None, i or 0, zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, expected_ids(BYTE_BPE, [t for _, t in rows], 2)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None] * 3 + [3] + [7] * 60 + [9] * 2


def test_token_store_lookups(spark):
    store = token_store.write_store(cases.docs(spark), BYTE_BPE, 2)
    asked = spark.createDataFrame([(5,), (999,), (None,), (5,), (2,)], "doc_id long")
    assert sorted(r.doc_id for r in token_store.look_up(store, asked).collect()) == [2, 5]
    assert store.bases.agg({"n_docs": "sum"}).first()[0] == len(cases.DOCS)  # rows without id and repeats are stored
    assert token_store.token_index(cases.empty(spark), BYTE_BPE).count() == 0


def packed(rows):
    f = pd.DataFrame([r.asDict() for r in rows]).sort_values(["sequence_id", "offset"])
    ends = f.groupby("sequence_id").agg(n=("length", "sum"))
    assert (ends["n"] <= 2048).all() and ((f.offset + f.length).groupby(f.sequence_id).shift().fillna(0) == f.offset).all()
    padded = ends["n"][(ends["n"] & (ends["n"] - 1)) != 0]
    return f, (2048 - padded).sum() / ends["n"].sum()


def test_packing_holds_every_id_once(spark):
    rng = random.Random(8)
    rows = [(200 + i, " ".join(rng.choices(["alpha", "beta", "x1"], k=rng.choice([5, 300, 700, 1024, 3000])))) for i in range(150)]
    rows = [(i, t) for i, t in cases.DOCS if i not in (1, None)] + rows
    f, padding = packed(packing.packed_pieces(cases.docs(spark, rows), WORD_BPE).collect())
    assert padding < 0.03  # five lengths only, which fill few sequences to the end
    whole = dict(zip([i for i, _ in rows], expected_ids(WORD_BPE, [t for _, t in rows], 1)))
    for r in f.itertuples():
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(whole[r.doc_id])
    spans = f.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert all((g.start == np.concatenate(([0], np.cumsum(g.length)[:-1]))).all() and g.length.sum() == len(whole[i]) for i, g in spans)


def test_packing_of_odd_cases(spark):
    f, _ = packed(packing.packed_pieces(cases.docs(spark), WORD_BPE).collect())
    total = sum(map(len, expected_ids(WORD_BPE, [t for _, t in cases.DOCS], 1)))
    assert f.length.sum() == total and f.doc_id.isna().sum() == 2
    assert packing.packed_pieces(cases.empty(spark), WORD_BPE).count() == 0


def test_patterns_reach_the_bound_and_the_demand():
    sizes, demand = np.array([60, 100, 130, 200]), np.array([500.0, 300, 200, 90])
    basis, used = packing.patterns(sizes, demand, 256)
    assert ((basis @ sizes) <= 256).all() and np.allclose(basis.T @ used, demand)
    assert used.sum() >= (sizes @ demand) / 256 - 1e-9 and used.sum() <= 500 / 2 + 300 / 2 + 200 + 90


def test_knapsack_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes, prices = np.sort(rng.choice(np.arange(1, 13), 3, replace=False)), rng.random(3)
        best = max(prices @ [a, b, c] for a in range(13) for b in range(13) for c in range(13) if sizes @ [a, b, c] <= 12)
        value, counts = packing._knapsack(prices, sizes, 12)
        assert np.isclose(value, best) and np.isclose(prices @ counts, value) and sizes @ counts <= 12


# --- chat ----------------------------------------------------------------------------

SAID = [
    (1, 1, "user", "hi"), (1, 2, "assistant", "### user: </turn>\n\\"), (1, 0, "system", None), (2, 0, None, ""), (2, 0, None, ""), (None, 1, "user", "x"), (3, None, "a:b\\ #<", "y"), (3, 5, "assistant", "né\n\n"),
    (4, 1, "assistant", "z" * 200_000), (5, 1, "user", "b"), (5, 1, "assistant", "a"),
]


def expected_chat(rows):
    out, trees = {}, {}
    for row in rows:
        trees.setdefault(row[0], []).append(row)
    for tree, own in trees.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out[tree] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.format_turns(turns)[0]))
    return out


def test_conversations_survive_the_template(spark):
    rows = spark.createDataFrame(SAID, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node", "2 AS leaf", "'u' AS formatted", "3 AS up")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.conversation_report(rows).collect()}
    assert got == expected_chat(SAID)
    assert chat.conversation_report(rows.limit(0)).count() == 0


def test_template_round_trip_of_any_text():
    rng = random.Random(2)
    for _ in range(2000):
        turns = [("".join(rng.choices("au:\\#< \n", k=rng.randint(0, 6))), "".join(rng.choices("\\#</turn>:\n x", k=rng.randint(0, 25)))) for _ in range(rng.randint(0, 4))]
        text, masks = chat.format_turns(turns, learnt="a")
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in masks] == [t for r, t in turns if r == "a"]


def test_best_paths_of_reply_trees(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for tree in range(12):
        own = []
        for _ in range(rng.choice([1, 2, 40])):
            parent = rng.choice(own) if own else None
            rows.append((tree, n, parent, float(rng.randint(0, 9))))
            own.append(n)
            n += 1
    rows += [(50, 900, 901, 1.0), (50, 901, 900, 1.0), (51, 910, 999, 2.0)]  # a circle; a parent that is not there
    parent, score = {r[1]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
    got: dict = {}
    for r in chat.root_paths(spark.createDataFrame(rows, "tree long, node long, parent long, score double"), branches=2).collect():
        got.setdefault(r.leaf, {})[r.up] = r.node
    want, parents = {}, set(parent.values())
    for tree in range(12):
        paths = {}
        for leaf in (r[1] for r in rows if r[0] == tree and r[1] not in parents):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths[leaf] = path
        for leaf in sorted(paths, key=lambda x: (-sum(score[i] for i in paths[x]), x))[:2]:
            want[leaf] = dict(enumerate(paths[leaf]))
    assert got.pop(910)[0] == 910 and got == want


# --- vectors -------------------------------------------------------------------------


def expected_neighbours(vectors, k):
    sound = {i: np.array(v, float) for i, v in vectors if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(sound))
    x, out = np.stack([sound[i] for i in ids]), {}
    for q in ids[ids % 20 == 0]:
        s = (x * sound[q]).sum(1)
        s[ids == q] = -np.inf
        out[q] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k] if s[i] > -np.inf]
    return out


def test_neighbours_of_few_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(i, [0.5] * 8) for i in range(200, 230)]
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [None] * 8), (380, [1.0, float("inf")] * 4), (400, [1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>").selectExpr("*", "1 AS block", "'v' AS vector", "0 AS rank")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got: dict = {}
    for r in sorted(permutation_index.neighbours(table).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = expected_neighbours(rows, 20)
    assert got.keys() == want.keys()
    for q, own in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in own] and np.allclose([s for _, s in got[q]], [s for _, s in own], atol=1e-12)
    assert permutation_index.neighbours(table.limit(0)).count() == 0


def test_recall_over_several_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(permutation_index, "BLOCK_ROWS", 200)
    monkeypatch.setattr(permutation_index, "QUERY_ROWS", 10)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in table.collect()]
    x, ids = np.stack([v for _, v in vectors]).astype(float), np.array([i for i, _ in vectors])
    got: dict = {}
    for r in permutation_index.neighbours(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        shares.append(len(set(ids[np.argsort(-s)[:20]]) & got[q]) / 20)
    assert len(got) == len(shares) and np.mean(shares) >= 0.9


@pytest.mark.parametrize("deviation", [0.0, 0.3, 0.5, 1.0])
def test_recall_where_lengths_differ(spark, deviation):
    """A block of many times 10 * k rows, so that only a share of it is reranked."""
    larger = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not larger.exists():
        pytest.skip("larger test tables are not here")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(str(larger)).collect()]
    ids = np.array([i for i, _ in rows])
    x = np.stack([v for _, v in rows]) * np.exp(np.random.default_rng(0).normal(0, deviation, len(rows)))[:, None]
    got: dict = {}
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    for r in permutation_index.neighbours(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        shares.append(len(set(ids[np.argsort(-s)[:20]]) & got[q]) / 20)
    assert len(ids) * permutation_index.SHARE > 2 * 10 * 20 and np.mean(shares) >= 0.95


# --- URLs ----------------------------------------------------------------------------

URLS = [
    None, "", "no scheme.com/", "http://www.Example.com/en/1", "https://a.example.com/en/1?x=/es/", "http://example.com/EN/1", "ftp://x.net/es/", "http://x.net/es", "http://net/fr/a", "http://x.com", "http://x.com?y", "http://x.com/#a",
    "http://notcom/", "http://a.b.c.d.e.net/fr/x#y", "x://y://z.com/a", "http://example.com.org/en/", "http:///path", "http://com/", "HTTP://WWW.EXAMPLE.COM/en/x", "http://x.org/" + "a" * 100_000, "http://ünï.net/fr/",
]


def expected_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = host.translate(cases.LOWER)
    fit = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, None))


def test_url_rules_and_verdicts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[3]), (3, URLS[3])]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'<html>' AS html", "'h' AS host", "'s' AS suffix", "1 AS features")
    got = url_filter.filter_urls(table, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, expected_rule(u)[:3])) for i, u in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    by_rule = {h + p: v for v, h, p in queries.URL_RULES}
    assert all(r.verdict == by_rule[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)
    assert url_filter.filter_urls(table.limit(0), queries.URL_RULES).count() == 0


def test_trees_learn_what_urls_tell():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] < 0.3)).astype(float)
    model = url_filter.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert (url_filter.BoostedTrees().fit(x[:0], y[:0]).probability(x) < 0.5).all()
    assert (url_filter.BoostedTrees().fit(x, np.ones(len(x))).probability(x) > 0.5).all()


def test_units_are_told_apart_and_forgotten(monkeypatch):
    """Case, bytes and lengths make units of their own; a worker that forgets, or merges often, gives the same ids."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aAbBzZéÉß09.,'") for _ in range(rng.randrange(1, 7)))
    texts = [" ".join(word() for _ in range(200)) for _ in range(40)] + ["Aa aA AA aa", "É é É", *(x or "" for x in ODD)]
    column = pa.array(texts, pa.string())
    want = [ids[:-1].tolist() for ids in expected_ids(BYTE_BPE, texts, 0)]
    for remembered, recent in ((10**6, 1 << 17), (50, 10), (10**6, 1)):
        monkeypatch.setattr(encode, "REMEMBERED", remembered)
        monkeypatch.setattr(encode, "RECENT", recent)
        monkeypatch.setattr(encode, "SLICE_BYTES", 1000)
        one = encode.Encoder(BYTE_BPE)
        for _ in range(2):
            flat, bounds = one.encode(column)
            assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_few_units_are_encoded_at_once(monkeypatch):
    """The library's results are many times the ids, and stand in a worker's memory until all of a call are read."""
    calls = []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, units, **options):
            calls.append(len(units))
            return self.tokenizer.encode_batch_fast(units, **options)

    one = encode.Encoder(WORD_BPE)
    one.tokenizer = Counting(one.tokenizer)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(200)) for _ in range(150)]
    flat, bounds = one.encode(pa.array(texts))
    assert max(calls) <= 4096 < sum(calls)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids[:-1].tolist() for ids in expected_ids(WORD_BPE, texts, 0)]


def test_a_task_gives_freed_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(stage, "give_back", lambda: given.append(1))
    assert list(stage.lean(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and given == [1]
