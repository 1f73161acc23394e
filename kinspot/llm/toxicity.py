"""Toxic documents by a convolutional text classifier, trained in numpy.

A word is three rows of hashed embedding tables side by side: two of the whole
word, so that two words look alike only if both hashes meet, and one of its
first bytes, which inflected forms share. Filters of several widths run over the
words of the whole text (zeros follow its last word), the largest response of
each filter is pooled, and a linear layer gives the logit. It is trained by
Adam on a bounded sample: of the labelled documents that may be learnt from,
the ``PER_CLASS`` first in hash order of each label, but for those over
``TRAIN_WORDS`` words. Words and beginnings of fewer than ``MIN_DOCUMENTS`` of
them have no vector, so that chance words of few documents say nothing. Each
fifth of all labelled documents does not train. All of that fifth, whatever
their number and length, are scored where they lie and counted by label,
language and score bin, and the counts set the thresholds by language, the
language being guessed from the text's own function words. A score is the
probability, stretched so that its language's threshold lies at 0.7.

Cases: null and empty texts have no words and get the score of that. Each row
is scored by itself. Without labels of both kinds no model can be made and
every score is 0. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinspot.llm.labelled import held_out, training_labels
from kinspot.llm.stage import lean, stored, whole_text
from kinspot.llm.words import NOT_ALNUM, hash_spans, slices, text_bytes, word_spans

#: the bounds of the sample that trains
PER_CLASS, TRAIN_WORDS = 3000, 5000
#: bits of the code of a word that number its row in each table: twice the word, and its first bytes
BITS, HEAD_BYTES = (16, 16, 18), 4
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 16
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.01, 1e-4
CUT = 0.7
#: share of clean calibration documents that a threshold may wrong, and its bounds
WRONGED, LOWEST, HIGHEST = 0.01, 0.3, 0.99
#: score bins of the calibration
BINS = 10_000
#: training documents a word must stand in to have a vector; all others are zeros
MIN_DOCUMENTS = 3
#: share of words that a training step leaves out
DROPPED = 0.1
#: least calibration documents of each label for a language to get a threshold of its own
LEAST = 10
#: fixed words that tell languages apart
LANGUAGES = {
    "en": "the of and to in is that it was for with are this",
    "de": "der die und das nicht ein zu den ist mit von sich auf",
    "fr": "le la les des et en du un une qui dans pour sur au",
    "es": "el los las que y un por con una su para es del",
}
NAMES = ("", *LANGUAGES)


def _codes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per range of texts: its first and last number, the code of every word, the first word of each text."""
    raw, offsets = text_bytes(column)
    for first, last in slices(offsets):
        own = offsets[first : last + 1]
        part = raw[own[0] : own[-1]]
        begins, ends, starts = word_spans(part, own - own[0], NOT_ALNUM)
        whole, head = hash_spans(part, begins, ends), hash_spans(part, begins, np.minimum(ends, begins + HEAD_BYTES))
        low = np.uint64(BITS[0] + BITS[1])
        code = (whole & np.uint64((1 << int(low)) - 1)) | (head & np.uint64((1 << BITS[2]) - 1)) << low
        yield first, last, code, starts


def _rows(codes: np.ndarray) -> list[np.ndarray]:
    """Rows of the three tables; row 0 is for what has no vector."""
    shifts = np.cumsum((0, *BITS[:-1]))
    return [(codes >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1) for shift, bits in zip(shifts, BITS, strict=True)]


def _language_words() -> list[np.ndarray]:
    return [codes for text in LANGUAGES.values() for _, _, codes, _ in _codes(pa.array([text]))]


def _guess(codes: np.ndarray, starts: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """Number of the language whose function words are the most frequent; 0 without any."""
    counts = np.zeros((len(known) + 1, len(starts) - 1))
    for i, own in enumerate(known):
        total = np.concatenate(([0], np.cumsum(np.isin(codes, own))))
        counts[i + 1] = total[starts[1:]] - total[starts[:-1]]
    return np.where(counts.max(0) > 0, counts.argmax(0), 0)


def _coded(column: pa.Array, known: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for first, last, codes, starts in _codes(column):
        yield first, last, codes, starts, _guess(codes, starts, known)


#: words of a text whose vectors and responses are held at once
PIECE_WORDS = 1 << 16


@dataclass
class ConvNet:
    """Embeddings, filters of each width (by place within the filter), and the linear layer."""

    seed: int = 5
    tables: list[np.ndarray] = field(init=False)
    filters: list[np.ndarray] = field(init=False)
    biases: list[np.ndarray] = field(init=False)
    weights: np.ndarray = field(init=False)
    offset: float = field(init=False, default=0.0)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.tables = [rng.normal(0, 0.1, (1 << bits, DIM)).astype(np.float32) for bits in BITS]
        self.filters = [rng.normal(0, 1 / np.sqrt(len(BITS) * DIM * w), (w, len(BITS) * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.weights = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)

    def vectors(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([t[r] for t, r in zip(self.tables, _rows(words), strict=True)], 1)

    def responses(self, x: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Response of every filter at every word; a filter that runs past its text meets zeros there."""
        left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(x))
        out = []
        for own, bias in zip(self.filters, self.biases, strict=True):
            y = x @ own[0] + bias
            for j in range(1, len(own)):
                part = x[j:] @ own[j]
                part[left[: len(part)] <= j] = 0
                y[: len(part)] += part
            out.append(y)
        return out

    def pooled(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Largest positive response of each filter in each text; 0 where there is none.

        A text of more than ``PIECE_WORDS`` words is worked off in pieces, each with the words that its last filters reach.
        """
        sizes = np.diff(starts)
        out = np.zeros((len(sizes), len(self.weights)), np.float32)
        long = sizes > PIECE_WORDS
        for text in np.flatnonzero(long):
            for at in range(starts[text], starts[text + 1], PIECE_WORDS):
                part = words[at : min(at + PIECE_WORDS + max(WIDTHS) - 1, starts[text + 1])]
                y = self.responses(self.vectors(part), np.array([0, len(part)]))
                out[text] = np.maximum(out[text], np.concatenate([r[:PIECE_WORDS].max(0) for r in y]))
        if long.any():
            words, sizes = words[~np.repeat(long, sizes)], np.where(long, 0, sizes)
            starts = np.concatenate(([0], np.cumsum(sizes)))
        some = np.flatnonzero(sizes)
        if len(some):
            y = self.responses(self.vectors(words), starts)
            out[some] = np.maximum(np.concatenate([np.maximum.reduceat(r, starts[some], axis=0) for r in y], 1), 0)
        return out

    def probability(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(words, starts) @ self.weights + self.offset, -30, 30).astype(float)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray) -> ConvNet:
        """Adam on the mean log loss of mini-batches; embeddings move where a pooled filter looked only."""
        rng = np.random.default_rng(self.seed + 1)
        low = np.uint64((1 << (BITS[0] + BITS[1])) - 1)
        for part in (low, ~low):
            met, documents = np.unique(np.concatenate([np.unique(t & part) for t in texts]), return_counts=True)
            met = met[documents >= MIN_DOCUMENTS]
            texts = [np.where(np.isin(t & part, met), t, t & ~part) for t in texts]
        for table, rows in zip(self.tables, _rows(np.unique(np.concatenate(texts))), strict=True):
            table[np.setdiff1d(np.arange(len(table)), rows)] = 0
            table[0] = 0
        dense = [*self.filters, *self.biases, self.weights]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in [*dense, *self.tables]]
        step = 0

        def adam(p, g, m, v, at=...):
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.999 * v[at] + 0.001 * g * g
            p[at] -= RATE * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-7)

        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), BATCH):
                chosen = [i for i in order[b : b + BATCH] if len(texts[i])]
                if not chosen:
                    continue
                step += 1
                words = np.concatenate([texts[i] for i in chosen])
                words = np.where(rng.random(len(words)) < DROPPED, np.uint64(0), words)
                starts = np.concatenate(([0], np.cumsum([len(texts[i]) for i in chosen])))
                x = self.vectors(words)
                y = self.responses(x, starts)
                best = [np.stack([r[s:e].argmax(0) + s for s, e in zip(starts[:-1], starts[1:])]) for r in y]
                tops = [np.take_along_axis(r, i, 0) for r, i in zip(y, best, strict=True)]
                pooled = np.maximum(np.concatenate(tops, 1), 0)
                error = 1 / (1 + np.exp(-(pooled @ self.weights + self.offset))) - labels[chosen]
                error = (error / len(chosen)).astype(np.float32)
                down = error[:, None] * self.weights * (pooled > 0)
                grads, into = [], np.zeros_like(x)
                bias_grads = []
                for w, (own, at) in enumerate(zip(self.filters, best, strict=True)):
                    d = down[:, w * FILTERS : (w + 1) * FILTERS]
                    g = np.zeros_like(own)
                    for j in range(len(own)):
                        place = at + j
                        inside = place < starts[1:, None]
                        place = np.minimum(place, len(x) - 1)
                        dj = d * inside
                        g[j] = np.einsum("bfe,bf->ef", x[place], dj)
                        np.add.at(into, place.ravel(), (dj[:, :, None] * own[j].T[None]).reshape(-1, x.shape[1]))
                    grads.append(g + DECAY * own)
                    bias_grads.append(d.sum(0))
                dense_grads = [*grads, *bias_grads, pooled.T @ error + DECAY * self.weights]
                for p, g, (m, v) in zip(dense, dense_grads, moments, strict=False):
                    adam(p, g, m, v)
                self.offset -= RATE * float(error.sum())
                looked_at = np.abs(into).sum(1) > 0
                for t, rows in enumerate(_rows(words)):
                    touched = np.flatnonzero(looked_at & (rows > 0))
                    own, back = np.unique(rows[touched], return_inverse=True)
                    g = np.zeros((len(own), DIM), np.float32)
                    np.add.at(g, back, into[touched, t * DIM : (t + 1) * DIM])
                    adam(self.tables[t], g, *moments[len(dense) + t], own)
        return self


def best_threshold(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """Midpoint of the gap between bins at which the F1 measure is largest, of those that wrong few clean documents.

    ``clean`` and ``toxic`` count the documents of each of the distinct ``bins``.
    Where even the highest score is a clean document's, the threshold lies above it.
    """
    order = np.argsort(-bins)
    s, clean, toxic = bins[order] / BINS, clean[order], toxic[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(clean + toxic) + toxic.sum())
    f1[np.cumsum(clean) > WRONGED * clean.sum()] = -1
    i = int(np.argmax(f1))
    if f1[i] <= 0:
        return float((s[clean > 0].max(initial=0) + 1) / 2)
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


@dataclass
class ToxicModel:
    net: ConvNet
    thresholds: np.ndarray  # by number of the language

    def scores(self, words: np.ndarray, starts: np.ndarray, language: np.ndarray) -> np.ndarray:
        p, t = self.net.probability(words, starts), self.thresholds[language]
        # rounded, as a product's last digits depend on where a row stands among others
        return np.round(np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t)), 6)


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, words, starts in _codes(batch.column("text")):
            texts = [words[a:b].tobytes() if b - a <= TRAIN_WORDS else None for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), batch.column("label").slice(first, last - first), pa.array(texts, pa.binary())],
                ["doc_id", "label", "words"])


def _bin_task(net: ConvNet, known: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, starts, language in _coded(batch.column("text"), known):
                at = np.floor(net.probability(words, starts) * BINS + 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(language, pa.int32()), pa.array(at.astype(np.int32))],
                    ["doc_id", "language", "bin"])

    return run


def _calibration_counts(texts: DataFrame, labels: DataFrame, net: ConvNet) -> pd.DataFrame:
    """Clean and toxic documents of each language and score bin; texts do not travel to their labels."""
    binned = stored(texts.mapInArrow(lean(_bin_task(net, _language_words())), "doc_id long, language int, bin int"), "calibration-bins")
    counts = binned.join(labels, "doc_id").groupBy("language", "bin")
    return counts.agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic")).toPandas()


def _threshold(counts: pd.DataFrame) -> float:
    by_bin = counts.groupby("bin")[["clean", "toxic"]].sum()
    return best_threshold(by_bin.index.to_numpy(), by_bin["clean"].to_numpy(), by_bin["toxic"].to_numpy())


def train_toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxic") -> ToxicModel | None:
    """The model, or None if the labels that may be learnt from are not of both kinds."""
    known = training_labels(labels, name)
    order = F.xxhash64("doc_id")
    fold = F.pmod(order, F.lit(5)) == 0
    halves = [known.filter(F.col("label") == v).orderBy(order, "doc_id").limit(PER_CLASS) for v in (0, 1)]
    sample = stored(halves[0].union(halves[1]), "training-sample")
    rows = whole_text(docs).join(sample, "doc_id").mapInArrow(lean(_sample_task), "doc_id long, label int, words binary").filter("words IS NOT NULL")
    rows = rows.select("label", "words", fold.alias("kept"), "doc_id").toPandas().sort_values("doc_id")
    y = rows["label"].to_numpy()
    if len(set(y)) < 2:
        return None
    texts = [np.frombuffer(w, np.uint64) for w in rows["words"]]
    kept = rows["kept"].to_numpy()
    train = np.flatnonzero(~kept) if len(set(y[~kept])) == 2 else np.arange(len(y))
    net = ConvNet().train([texts[i] for i in train], y[train].astype(np.float32))
    learnable = whole_text(docs).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = _calibration_counts(learnable.filter(fold), known, net)
    if not (counts["clean"].any() and counts["toxic"].any()):
        counts = _calibration_counts(learnable, known, net)
    common = _threshold(counts)
    thresholds = np.full(len(NAMES), common)
    for i in range(1, len(NAMES)):
        own = counts[counts["language"] == i]
        if min(own["clean"].sum(), own["toxic"].sum()) >= LEAST:
            thresholds[i] = _threshold(own)
    return ToxicModel(net, np.clip(thresholds, LOWEST, HIGHEST))


def _score_task(model: ToxicModel | None, known: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for first, last, words, starts, language in _coded(batch.column("text"), known):
                scores.append(np.zeros(last - first) if model is None else model.scores(words, starts, language))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(scores), pa.float64())], [*batch.schema.names, "toxicity_score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicModel | None) -> DataFrame:
    """``docs`` with ``toxicity_score``: 0 to 1, toxic from 0.7 on; replaces a column of that name."""
    plain = docs.drop("toxicity_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", toxicity_score double"
    return plain.mapInArrow(lean(_score_task(model, _language_words())), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from 0.7 on)."""
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_toxicity(docs, labels))
    score = F.col("toxicity_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
