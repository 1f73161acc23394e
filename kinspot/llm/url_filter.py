"""URL verdicts: a list of host and path rules, and boosted trees on lexical features for the rest.

A rule is a host and the begin of a path, and fits that host and all its
subdomains; the longest that fits decides. URLs that a rule decides are the
labelled ones: gradient-boosted trees are grown on a bounded sample of them
(the ``TRAIN_ROWS`` first in hash order) and judge the URLs that no rule fits.
Features are the URL's lengths, depth, shares of digits and signs, entropies,
parameter counts, and statistics of the host's last label over all URLs: how
many there are and how many of its labelled ones are blocked.

Cases: a null URL, or one without ``://``, has an empty host and path; no rule
fits it and the trees judge it by its features. Without labelled URLs of both
verdicts the trees say what is known, with none of them ``allow``. Every row
is judged by itself, so repeated rows and null ids give rows of their own. No
rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinspot.llm.stage import stored

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, LEAF, RIDGE, BINS = 40, 3, 0.2, 10, 1.0, 32
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digits", "signs", "hyphens", "capitals", "entropy", "host_entropy",
    "parameters", "query_length", "fragment", "secure", "longest_part", "host_digits",
)
#: statistics of the last label that join them: log count, log labelled count, share of blocked ones
ALL_FEATURES = (*FEATURES, "suffix_urls", "suffix_labelled", "suffix_blocked")

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:cut]


class Rules:
    """Rules as (verdict, host, path), found by the ends of a host."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        self.most_labels = max((h.count(".") + 1 for h in self.by_host), default=0)

    def fit(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, as text, and its verdict; of equally long ones the first in order of text."""
        labels = host.rsplit(".", self.most_labels)
        found = []
        for i in range(min(len(labels), self.most_labels)):
            end = ".".join(labels[len(labels) - 1 - i :])
            found += [(-len(end) - len(begin), end + begin, verdict) for begin, verdict in self.by_host.get(end, ()) if path.startswith(begin)]
        if not found:
            return None, None
        _, rule, verdict = min(found)
        return rule, verdict


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.fromiter(Counter(text).values(), float) / len(text)
    return float(-(n * np.log2(n)).sum())


def lexical_features(url: str | None, host: str, path: str) -> list[float]:
    """Values in the order of ``FEATURES``."""
    url = url or ""
    _, _, query = url.partition("?")
    query, _, _ = query.partition("#")
    n = max(1, len(url))
    parts = [p for p in host.replace(".", "/").split("/") + path.split("/") if p]
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1 if host else 0, sum(c.isdigit() for c in url) / n,
        sum(not c.isalnum() for c in url) / n, url.count("-"), sum(c.isupper() for c in url) / n, _entropy(url), _entropy(host),
        query.count("&") + 1 if query else 0, len(query), "#" in url, url[:6].translate(_LOWER) == "https:", max(map(len, parts), default=0), sum(c.isdigit() for c in host),
    ]


def _describe_task(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            split = [host_and_path(u) for u in urls]
            fitted = [rules.fit(*s) for s in split]
            values = [lexical_features(u, *s) for u, s in zip(urls, split, strict=True)]
            columns = [
                pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()),
                pa.array([f[0] for f in fitted], pa.string()), pa.array([f[1] for f in fitted], pa.string()),
                pa.array([s[0].rsplit(".", 1)[-1] for s in split], pa.string()), pa.array(values, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], ["page_id", "host", "path", "rule", "ruled", "suffix", "features"])

    return run


@dataclass
class BoostedTrees:
    """Trees of ``DEPTH`` levels over binned features, fitted to the log loss."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = -30.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    @staticmethod
    def _leaves(b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]))
        return node - (2**DEPTH - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if len(y) == 0:
            return self
        share = y.mean()
        if share in (0.0, 1.0):
            self.base = 30.0 if share else -30.0
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b, logit = self.binned(x), np.full(len(y), np.log(share / (1 - share)))
        self.base = float(logit[0])
        inner = 2**DEPTH - 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-logit))
            grad, hess = p - y, p * (1 - p)
            feature, cut, node = np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                for at in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == at)
                    if len(rows) >= 2 * LEAF:
                        feature[at], cut[at] = self._split(b[rows], grad[rows], hess[rows])
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]))
            leaf = node - inner
            g, h = np.bincount(leaf, grad, 2**DEPTH), np.bincount(leaf, hess, 2**DEPTH)
            value = -RATE * g / (h + RIDGE)
            logit += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    @staticmethod
    def _split(b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        best, where = 1e-9, (-1, 0)
        whole = grad.sum() ** 2 / (hess.sum() + RIDGE)
        for j in range(b.shape[1]):
            n, g, h = (np.cumsum(np.bincount(b[:, j], w, BINS + 1)) for w in (None, grad, hess))
            gain = g**2 / (h + RIDGE) + (g[-1] - g) ** 2 / (h[-1] - h + RIDGE) - whole
            gain[(n < LEAF) | (n[-1] - n < LEAF)] = 0
            if gain.max() > best:
                best, where = gain.max(), (j, int(gain.argmax()))
        return where

    def probability(self, x: np.ndarray) -> np.ndarray:
        logit, b = np.full(len(x), self.base), self.binned(x)
        for feature, cut, value in self.trees:
            logit += value[self._leaves(b, feature, cut)]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _judge_task(model: BoostedTrees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(ALL_FEATURES))
            p = model.probability(x)
            verdict = [r or ("block" if q >= 0.5 else "allow") for r, q in zip(batch.column("ruled").to_pylist(), p, strict=True)]
            names = ["page_id", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(verdict, pa.string()), pa.array(p)], [*names, "verdict", "block_probability"])

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per row of ``pages`` (page_id, url): host, path, rule, verdict and the trees' probability of ``block``."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    described = stored(plain.mapInArrow(_describe_task(Rules(rules)), "page_id long, host string, path string, rule string, ruled string, suffix string, features array<double>"), "urls")
    blocked, labelled = F.count_if(F.col("ruled") == "block"), F.count("ruled")
    suffixes = described.groupBy("suffix").agg(F.array(F.log1p(F.count("*")), F.log1p(labelled), (blocked + 1) / (labelled + 2)).alias("of_suffix"))
    known = described.join(suffixes, "suffix").withColumn("features", F.concat("features", "of_suffix"))
    sample = known.filter("ruled IS NOT NULL").select("page_id", "host", "path", "ruled", "features")
    sample = sample.orderBy(F.xxhash64("page_id", "host", "path"), "page_id", "host", "path", "features").limit(TRAIN_ROWS).toPandas()
    x = np.array(sample["features"].tolist(), float).reshape(len(sample), len(ALL_FEATURES))
    model = BoostedTrees().fit(x, (sample["ruled"] == "block").to_numpy(float))
    return known.mapInArrow(_judge_task(model), "page_id long, host string, path string, rule string, verdict string, block_probability double")
