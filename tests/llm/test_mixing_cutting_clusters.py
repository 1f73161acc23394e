"""Clusters, mixes and fill-in-the-middle beside plain re-statements, odd cases included."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspot.llm import clustering, fill_in_middle, mixing

from . import cases

# --- fill in the middle ------------------------------------------------------------------


def cut_by_hand(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINED = [
    (20, "one\ntwo\nthree\n"), (21, "one\ntwo\nthree"), (22, "\n\n\n"), (23, "a <P> in it\nand more\n"), (24, "é\n\U0001f600x\nß\n" * 50),
    (25, "ends in a half mark <\n<S\n>P>\n" * 7), (26, "\n" * 200_000), (27, "ab\r\ncd\x0bef\n" * 9), (28, "x" * 300_000 + "\n" + "é" * 70_000), (None, "no id\nat all\n"),
]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 50)])
def test_cuts_are_those_by_hand(spark, rate, spm):
    rows = cases.DOCS + LINED
    out = fill_in_middle.fill_in_middle(cases.docs(spark, rows), 7, rate, spm)
    back = fill_in_middle.restored(F.col("output"), F.col("form")).alias("back")
    got = Counter(tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back).collect())
    assert got == Counter((i, *cut_by_hand(i, t, 7, rate, spm), t or "") for i, t in rows)
    assert rate != 100 or {r[2] for r in got} == {"plain", "psm", "spm"}


def test_no_documents_to_cut(spark):
    assert fill_in_middle.transformation_report(cases.empty(spark)).count() == 0


def test_every_container_selects(spark):
    rng = np.random.default_rng(4)
    low = {
        fill_in_middle.ArrayContainer: np.unique(rng.integers(0, 65536, 900)), fill_in_middle.BitmapContainer: np.unique(rng.integers(0, 65536, 30_000)),
        fill_in_middle.RunContainer: np.concatenate((np.arange(5, 4000), np.arange(9000, 65536))),
    }
    for kind, values in low.items():
        held = fill_in_middle.container(values)
        assert type(held) is kind and [held.select(r) for r in range(0, len(values), 7)] == values[::7].tolist()
    offsets = np.concatenate([values + 65536 * high for high, values in zip((0, 3, 900), low.values())])
    whole = fill_in_middle.BoundarySet(offsets)
    assert len(whole) == len(offsets) and [whole.select(r) for r in range(0, len(offsets), 11)] == offsets[::11].tolist()


# --- mixing ------------------------------------------------------------------------------


def targets_by_hand(sizes, weights, share, epochs):
    """Clamp and deal again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    asked, full = share * sum(sizes.values()), set()
    while True:
        rest, open_ = asked - sum(epochs * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        now = {s: epochs * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        above = {s for s in names if s not in full and now[s] > epochs * sizes[s]}
        if not above or above | full == set(names):
            return {s: min(now[s], epochs * sizes[s]) for s in names}
        full |= above


def sourced(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return table.selectExpr("*", "'en' AS lang", "1L AS size", "'x' AS draw", "2 AS row", "'y' AS target", "0 AS weight", "'z' AS place")


def many_sources():
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), str(s)) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 1500), rng.choice(["ä", "b", "hot", "\U0001f600", "Z"], 1500, p=[0.05, 0.2, 0.6, 0.05, 0.1])))]
    rows += [(9000, "the very same row", "copies")] * 700 + [(None, "no id at all", "copies")] * 300  # a hot key
    return rows + [(1, None, None), (2, "of no\tsource ", None), (2, "of no\tsource ", None), (3, "", "empty"), (4, cases.LONG, "long"), (5, "tiny", "long")]


@pytest.mark.parametrize(("share", "epochs", "weights"), [(1.5, 2, (3, 1, 2)), (0.3, 1, (1, 5)), (1.9, 2, (1,)), (2.5, 2, (3, 1, 2)), (1.5, 4, (1, 9))])
def test_mix_reaches_its_targets(spark, share, epochs, weights):
    rows = many_sources()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(cases.space_words(text))
    want = targets_by_hand(sizes, weights, share, epochs)
    got = mixing.mix_report(sourced(spark, rows), weights, share, epochs).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(cases.space_words(t))) for i, t, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= epochs * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_mix_agrees_when_rerun(spark):
    table = sourced(spark, many_sources())
    runs = [Counter(tuple(r) for r in mixing.mix_report(table.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]
    assert mixing.mix_report(table).collect() and mixing.mix_report(table, seed=8).exceptAll(mixing.mix_report(table)).count() > 0


def test_mixed_texts_hold_the_words_taken(spark):
    rows = many_sources()
    table = sourced(spark, rows)
    whole = {(i, s): t for i, t, s in rows}
    taken = Counter()
    for r in mixing.mixed_documents(table).collect():
        assert len(cases.space_words(r.text)) == r.words > 0
        text = whole[r.doc_id, r.source]
        assert r.text == text or (text.startswith(r.text) and r.words < len(cases.space_words(text)))
        taken[r.doc_id, r.source] += r.words
    want = Counter()
    for r in mixing.mix_report(table).collect():
        want[r.doc_id, r.source] += r.taken
    assert taken == +want


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, " ", None)]])
def test_mix_of_nothing(spark, rows):
    got = mixing.mix_report(sourced(spark, rows)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * len(rows)
    assert mixing.mixed_documents(sourced(spark, rows)).count() == 0


# --- clusters ----------------------------------------------------------------------------


def cluster_by_hand(rows, k, rounds, seed=1, scale=64, width=4):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) * scale <= clustering.LARGEST for x in v)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in by_hash[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        own = [min(range(len(centers)), key=lambda c: (apart(v, centers[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centers)):
                if members := [v for (_, v), o in zip(kept, own) if o == c]:
                    centers[c] = [sum(x) // len(members) for x in zip(*members)]
    distances = [apart(v, centers[o]) for (_, v), o in zip(kept, own)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    inertia = Counter()
    for o, d in zip(own, distances):
        inertia[o] += d
    return Counter((i, o, d, inertia[o], sum(distances), digest[o]) for (i, _), o, d in zip(kept, own, distances))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "'x' AS id", "2 AS block", "'y' AS v", "0 AS cluster")


def spots(n, width=4, spread=1.0, size=1.0, seed=3):
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(7, width)) * 10
    return [(i, (size * (around[i % 7] + spread * rng.normal(size=width))).tolist()) for i in range(n)]


ODD = [
    (900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]), (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0]), (906, [1e300, 0.0, 0.0, 0.0]),
    (907, [0.0] * 4), (907, [0.0] * 4), (907, [1.0, -1.0, 0.5, 0.0]), (None, [3.0, 3.0, 3.0, -3.0]), (None, None), (908, [-0.001, 1 / 64, 1 / 128, -1 / 64]),
]


@pytest.mark.parametrize(("rows", "k", "rounds"), [
    (spots(600) + ODD, 16, 3), (spots(300, spread=20.0), 5, 8), (spots(200, size=60_000.0), 6, 4), (ODD, 16, 3), (spots(50), 1, 2), (spots(40), 3, 0),
    ([(i, [float(i % 2)] * 4) for i in range(40)], 8, 3), ([(i, [float(i), 0.0, 0.0, 0.0]) for i in range(200)], 9, 6), ([], 16, 3), ([(1, None)], 16, 3),
])
def test_clusters_are_those_by_hand(spark, monkeypatch, rows, k, rounds):
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 64)
    got = clustering.cluster_report(vectors(spark, rows).repartition(3), k, rounds, width=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == cluster_by_hand(rows, k, rounds)


def test_only_expired_vectors_are_measured():
    """Heaps over many moves of the centroids: owners stay right while few vectors are touched."""
    grid = np.floor(64 * np.array([v for _, v in spots(3000)])).astype(np.int64)
    centers = grid[:7].copy()
    drift, heaps, measured, rng = np.zeros(7), clustering._first_heaps(grid, 7), [], np.random.default_rng(2)
    for turn in range(12):
        slots, _, _ = clustering._rescan(grid, centers, drift, heaps)
        measured.append(len(slots))
        assert (heaps.owners(len(grid)) == clustering.squared_distances(grid, centers).argmin(1)).all()
        entries, places, sizes = heaps.columns()
        heaps = clustering.GapHeaps(np.frombuffer(entries), np.frombuffer(places, "<i4"), np.frombuffer(sizes, "<i4"))
        for own in heaps.entries:
            assert all(own[(i - 1) // 2] <= own[i] for i in range(1, len(own)))
        after = centers + rng.integers(-6, 7, centers.shape)
        moves = np.sqrt(((after - centers) ** 2).sum(1))
        drift = drift + moves + [np.delete(moves, c).max() for c in range(7)]
        centers = after
    assert measured[0] == len(grid) and max(measured[1:]) < len(grid) / 4


def test_distances_beyond_exact_doubles():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-clustering.LARGEST, clustering.LARGEST, (20, 64)), rng.integers(-clustering.LARGEST, clustering.LARGEST, (3, 64))
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(v, c)) for c in b] for v in a]
    assert clustering.squared_distances(a, b).tolist() == want
