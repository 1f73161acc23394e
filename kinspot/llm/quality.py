"""Document quality by kernel ridge regression over statistics of the text.

Each document is described by fixed statistics of its bytes, words and lines.
Random Fourier features of the standardised statistics approximate a Gaussian
kernel. Every labelled document that may be learnt from takes part: partitions
sum their moments, then their normal equations, Spark adds the sums, and the
driver solves a system whose size is the number of features. An isotonic
regression on counts by score bin makes the ridge scores probabilities.

Cases: null and empty texts have statistics of zeros and are scored like any
other. Each row is scored by itself. Without labels every score is 0. No
documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinspot.llm.labelled import held_out, training_labels
from kinspot.llm.stage import stored, whole_text
from kinspot.llm.words import SPACE, hash_spans, slices, text_bytes, word_spans

FEATURES, RIDGE, WIDTH = 256, 1e-3, 1.0
#: score bins of the calibration
BINS = 1000
CUT = 0.5
#: standardised statistics beyond this many deviations are as far as this
FAR = 6.0
BYTE_KINDS = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "beyond_ascii": range(128, 256), "space": b" ",
    "newline": b"\n", "end_mark": b".!?", "comma": b",;:", "bar": b"|", "sign": b"#$%&*@^~", "shout": b"!", "bracket": b"()[]{}<>", "quote": b"\"'`",
    "other": bytes(c for c in range(32) if c != 10) + b"\x7f\\/+=-_",
}
NAMES = (
    [f"share_{k}" for k in BYTE_KINDS]
    + ["log_bytes", "log_words", "word_length", "word_length_deviation", "longest_word", "distinct_words", "most_repeated_word"]
    + ["words_a_line", "repeated_lines", "capital_words", "shouted_words", "marked_words", "next_repeats"]
)

_KIND = np.zeros(256, np.uint8)
for _number, _members in enumerate(BYTE_KINDS.values()):
    _KIND[list(_members)] = _number
_LINE_END = np.zeros(256, bool)
_LINE_END[0x0A] = True


def _repeats(values: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and how often its most frequent one stands."""
    distinct, most = np.zeros(docs), np.zeros(docs)
    if len(values):
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])))
        runs, of = np.diff(np.append(new, len(v))), o[new]
        distinct = np.bincount(of, minlength=docs).astype(float)
        np.maximum.at(most, of, runs)
    return distinct, most


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs, sizes = len(offsets) - 1, np.diff(offsets)
    per_byte = 1 / np.maximum(sizes, 1)
    text = np.repeat(np.arange(docs, dtype=np.int64), sizes)
    counts = np.bincount(text * len(BYTE_KINDS) + _KIND[raw], minlength=docs * len(BYTE_KINDS)).reshape(docs, -1)
    out = [counts * per_byte[:, None]]
    begins, ends, starts = word_spans(raw, offsets, SPACE)
    n = np.diff(starts)
    per_word, owner = 1 / np.maximum(n, 1), np.repeat(np.arange(docs), n)
    lengths = (ends - begins).astype(float)
    mean = np.bincount(owner, lengths, docs) * per_word
    deviation = np.sqrt(np.maximum(np.bincount(owner, lengths**2, docs) * per_word - mean**2, 0))
    longest = np.zeros(docs)
    np.maximum.at(longest, owner, lengths)
    hashes = hash_spans(raw, begins, ends)
    distinct, most = _repeats(hashes, owner, docs)
    first, last = raw[begins], raw[np.maximum(ends - 1, 0)]
    capital = (first >= 65) & (first <= 90)
    loud = np.add.reduceat(((raw >= 97) & (raw <= 122)).astype(np.int64), begins) == 0 if len(begins) else np.zeros(0, bool)
    marked = _KIND[last] == list(BYTE_KINDS).index("sign")
    same = np.append((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), False) if len(hashes) else np.zeros(0, bool)
    line_begins, line_ends, line_starts = word_spans(raw, offsets, _LINE_END)
    n_lines = np.diff(line_starts)
    distinct_lines, _ = _repeats(hash_spans(raw, line_begins, line_ends), np.repeat(np.arange(docs), n_lines), docs)
    columns = [
        np.log1p(sizes), np.log1p(n), np.log1p(mean), np.log1p(deviation), np.log1p(longest), distinct * per_word, most * per_word,
        np.log1p(n / np.maximum(n_lines, 1)), 1 - distinct_lines / np.maximum(n_lines, 1),
        *(np.bincount(owner, x, docs) * per_word for x in (capital, loud & (lengths > 1), marked, same)),
    ]
    return np.concatenate([*out, np.stack(columns, 1)], 1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        parts = [np.zeros((0, len(NAMES)))]
        for first, last in slices(offsets):
            own = offsets[first : last + 1]
            parts.append(_statistics(raw[own[0] : own[-1]], own - own[0]))
        flat = np.concatenate(parts).astype(np.float32)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(NAMES), pa.int32()), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "statistics"])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``statistics`` (floats in the order of ``NAMES``) of each row."""
    return whole_text(docs).mapInArrow(_describe, "doc_id long, statistics array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)


def _sum_task(rows_of):
    """One row per row of the matrix that a partition's batches add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = rows_of(_matrix(batch), batch.column("label").to_numpy().astype(float))
                total = part if total is None else total + part
        if total is not None:
            n, m = total.shape
            index = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
            yield pa.RecordBatch.from_arrays([pa.array(index[0]), pa.array(index[1]), pa.array(total.ravel())], ["i", "j", "value"])

    return run


def _summed(rows: DataFrame, rows_of, shape: tuple[int, int]) -> np.ndarray:
    """Sum of a fixed-size matrix over all partitions; the driver gets its cells."""
    cells = rows.mapInArrow(_sum_task(rows_of), "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros(shape)
    for r in cells.collect():
        out[r["i"], r["j"]] = r["value"]
    return out


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            weight = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / weight, weight, a[2] + b[2]])
    return np.concatenate([np.full(int(n), m) for m, _, n in blocks]) if blocks else np.zeros(0)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    places: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.scale, -FAR, FAR)
        f = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / self.directions.shape[1])
        return np.concatenate((f, np.ones((len(f), 1))), 1)

    def ridge(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip(self.features(statistics) @ self.weights, 0, 1)

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        # rounded, as a product's last digits depend on where a row stands among others
        return np.round(np.interp(self.ridge(statistics), self.places, self.levels), 9)


def _bin_task(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.rint(model.ridge(_matrix(batch)) * BINS).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], ["bin", "label"])

    return run


def train_quality(described: DataFrame, labels: DataFrame, name: str = "quality") -> QualityModel | None:
    """The model from ``statistics``' table, or None without labels to learn from."""
    rows = stored(described.join(training_labels(labels, name), "doc_id").select("statistics", "label"), "labelled-statistics")
    d = len(NAMES)
    moments = _summed(rows, lambda x, y: np.stack([x.sum(0), (x * x).sum(0), np.full(d, float(len(x)))]), (3, d))
    n = moments[2, 0]
    if not n:
        return None
    mean = moments[0] / n
    deviation = np.sqrt(np.maximum(moments[1] / n - mean**2, 0))
    rng = np.random.default_rng(11)
    model = QualityModel(mean, np.where(deviation > 1e-9, deviation, 1.0), rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return f.T @ np.concatenate((f, y[:, None]), 1)

    sums = _summed(rows, equations, (FEATURES + 1, FEATURES + 2))
    penalty = np.eye(FEATURES + 1) * RIDGE * n / FEATURES
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])
    binned = rows.mapInArrow(_bin_task(model), "bin long, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    counts = binned.toPandas().sort_values("bin")
    model.places = counts["bin"].to_numpy() / BINS
    model.levels = isotonic((counts["ones"] / counts["n"]).to_numpy(), counts["n"].to_numpy())
    return model


def _score_task(model: QualityModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch)) if model is not None and batch.num_rows else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from 0.5 on)."""
    described = stored(statistics(docs), "statistics")
    scored = described.mapInArrow(_score_task(train_quality(described, labels)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
