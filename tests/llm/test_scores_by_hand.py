"""Scores, rules and spans beside plain re-statements, and texts that are worked off in pieces."""

import time

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, rows

from kinspot.llm import quality, secret_scan, toxicity
from kinspot.llm.labelled import training_labels
from kinspot.llm.queries import QUERIES

from . import cases


@pytest.fixture(scope="module")
def net():
    made = toxicity.ConvNet()
    made.weights = np.random.default_rng(1).normal(0, 1, len(made.weights)).astype(np.float32)
    made.biases = [np.random.default_rng(i).normal(0, 0.1, len(b)).astype(np.float32) for i, b in enumerate(made.biases)]
    return made


def texts_of(lengths):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**62, sum(lengths), dtype=np.uint64)
    return words, np.concatenate(([0], np.cumsum(lengths)))


def test_convolution_and_pooling_by_loops(net):
    words, starts = texts_of([0, 1, 2, 3, 9, 0, 17])
    got = net.pooled(words, starts)
    for t, (a, b) in enumerate(zip(starts, starts[1:])):
        x = net.vectors(words[a:b]) if b > a else np.zeros((0, 1))
        want = []
        for own, bias in zip(net.filters, net.biases):
            for f in range(own.shape[2]):
                best = 0.0
                for at in range(len(x)):
                    total = float(bias[f])
                    for j in range(len(own)):
                        if at + j < len(x):
                            total += float(np.dot(x[at + j].astype(float), own[j][:, f].astype(float)))
                    best = max(best, total)
                want.append(best)
        assert np.allclose(got[t], want, atol=1e-5)
    p = net.probability(words, starts)
    assert np.allclose(p, 1 / (1 + np.exp(-(got.astype(float) @ net.weights.astype(float)))), atol=1e-5)


def test_a_long_text_is_pooled_in_pieces(net, monkeypatch):
    words, starts = texts_of([5, 1000, 0, 130, 2, 128])
    whole = net.pooled(words, starts)
    for piece in (1, 7, 64, 129):
        monkeypatch.setattr(toxicity, "PIECE_WORDS", piece)
        assert np.allclose(net.pooled(words, starts), whole, atol=1e-5)


def test_quality_model_is_the_direct_solution(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    described = quality.statistics(docs)
    model = quality.train_quality(described, labels)
    known = described.join(training_labels(labels, "quality"), "doc_id").collect()
    x, y = np.array([r.statistics for r in known], float), np.array([r.label for r in known], float)
    assert 20 < len(x) < 400
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1.0), rtol=1e-5)
    z = np.clip((x - model.mean) / model.scale, -quality.FAR, quality.FAR)
    f = np.concatenate((np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.directions + model.phases), np.ones((len(x), 1))), 1)
    # ridge as least squares with rows for the penalty
    weight = np.full(f.shape[1], np.sqrt(quality.RIDGE * len(x) / quality.FEATURES))
    weight[-1] = np.sqrt(1e-9)
    direct, *_ = np.linalg.lstsq(np.concatenate((f, np.diag(weight))), np.concatenate((y, np.zeros(f.shape[1]))), rcond=None)
    ridge = np.clip(f @ direct, 0, 1)
    assert np.allclose(model.ridge(x), ridge, atol=1e-6)
    bins = np.rint(model.ridge(x) * quality.BINS).astype(int)
    places = np.unique(bins)
    ones, n = (np.array([v[bins == b].sum() for b in places]) for v in (y, np.ones(len(y))))
    # isotonic regression by its min-max formula
    mean = lambda i, j: ones[i : j + 1].sum() / n[i : j + 1].sum()
    levels = [max(min(mean(i, j) for j in range(k, len(places))) for i in range(k + 1)) for k in range(len(places))]
    assert np.allclose(model.places * quality.BINS, places) and np.allclose(model.levels, levels)
    scored = {r.doc_id: r.score for r in QUERIES["op6_quality"](spark, sf_dir).collect()}
    assert np.allclose([scored[r.doc_id] for r in known], np.interp(model.ridge(x), places / quality.BINS, levels), atol=1e-6)


RULES = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
lowered AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts)
SELECT l.page_id, l.host, l.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
FROM lowered l LEFT JOIN rules r ON (l.host = r.host OR ends_with(l.host, '.' || r.host)) AND starts_with(l.path, r.path)
GROUP BY l.page_id, l.host, l.path"""


def test_hosts_paths_and_rules_by_sql(spark, sf_dir):
    got = QUERIES["op4_url_filter"](spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect()
    want = connect(sf_dir).execute(RULES).fetchall()
    assert rows(["a", "b", "c", "d"], [r[:4] for r in got]) == rows(["a", "b", "c", "d"], [w[:4] for w in want])
    verdicts = {w[0]: w[4] for w in want}
    assert all(r.verdict == verdicts[r.page_id] if r.rule else r.verdict in ("allow", "block") for r in got)


def test_many_secrets_in_one_text():
    """Base spans and novel ones do not overlap, and twice the secrets take about twice the time."""
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"))

    def text(n):
        return "\n".join(f"password: {''.join(rng.choice(letters, 24))} and credential {''.join(rng.choice(letters, 40))}" for _ in range(n))

    scanner, took = secret_scan.Scanner(secret_scan.IDENTIFIERS, secret_scan.NOVEL), []
    for n in (500, 4000):
        whole = text(n)
        begun = time.process_time()
        spans = scanner.spans(whole)
        took.append(time.process_time() - begun)
        base = cases.base_spans(whole)
        assert [s for s in spans if s[1] < 3] == [(a, k, b) for a, k, b in base] and len(spans) > 1.5 * n
        novel = [(a, b) for a, k, b in spans if k == 3]
        taken = sorted([(a, b) for a, _, b in base] + novel)
        assert all(b <= c for (_, b), (c, _) in zip(taken, taken[1:]) if (c, _) in novel or (_, b) in novel)
    assert took[1] < 16 * took[0]


def test_masks_of_a_batch_in_pieces(spark, monkeypatch):
    rows_ = [(i, f"text {i} password = abcdef{i} " + "x " * (i % 7)) for i in range(40)] + [(50, None), (51, "")]
    whole = {r.doc_id: r.text for r in secret_scan.mask_secrets(cases.docs(spark, rows_)).collect()}
    monkeypatch.setattr(secret_scan, "SLICE_BYTES", 60)
    assert {r.doc_id: r.text for r in secret_scan.mask_secrets(cases.docs(spark, rows_)).collect()} == whole
    assert all("[SECRET]" in whole[i] and "abcdef" not in whole[i] for i in range(40)) and whole[50] is None and whole[51] == ""
    assert isinstance(pa.array([""]), pa.StringArray)
