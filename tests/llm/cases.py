"""Small tables with every odd case, and plain re-statements of what the operators must give."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import combinations

LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"word{i % 977}x{i // 7}" for i in range(30_000))
DOCS = [
    (1, "Hello world, foo bar baz qux"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (1, "Hello world, foo bar baz qux"),
    (None, "no id here at all"), (None, None), (7, "hello WORLD, foo bar baz qux"), (8, "two words"), (9, "TWO words"),
    (10, "naïve É ß ñandú «quoted» — dash…"), (11, "a b a b a b a b"), (12, "Hello world, foo bar baz quux"),
]
#: other columns under names that operators use inside
EXTRA = ", 'x' AS key, 1.5D AS score, 0 AS component, array(1) AS ids, 'y' AS bucket, 2 AS id, 'z' AS spans, 3 AS start"


def docs(spark, rows=DOCS):
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    return plain.selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", *[c.strip() for c in re.split(r",(?![^(]*\))", EXTRA) if c.strip()])


def empty(spark):
    return docs(spark, [])


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text, k):
    w = space_words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_duplicates(rows, k, percent):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: shingle_set(t, k) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def contamination(rows, items, width=13):
    """Per row: n_words, n_hit, n_items, digest, contaminated."""
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for j in range(max(1, len(w) - width + 1)):
            if w:
                windows[tuple(w[j : j + width])] |= set() if item is None else {str(item)}
    lengths, out = {len(w) for w in windows}, []
    for _, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_spans(text):
    """(start, kind, end) by the patterns as they are stated."""
    text, found = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for kind, (pattern, holds) in enumerate((
        (assign, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if holds(m)]
    return sorted(found)
