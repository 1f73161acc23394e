"""Fill-in-the-middle examples: texts cut at line ends, middle moved to the end.

The ends of a text's lines are a set of code point offsets, kept the way
compressed bitmaps do: offsets of equal high 16 bits share a container, which
holds the low 16 bits as a sorted array, as a bitmap or as runs, whichever is
smallest. Cumulative cardinalities say in which container the r-th boundary
lies; a select inside that container gives its offset. So a cut after any
number of lines costs two look-ups, however many lines a text has.

Which lines become prefix, middle and suffix is drawn from a hash of the
document's id, so a rerun cuts alike. Texts that hold one of the marks stay
as they are (form ``plain``), so the marks in an output are always the three
put there, and ``restored`` gives back the exact text.

Cases: a null text is an empty one, and empty texts are plain. A null id draws
like an id without digits. Rows that share an id draw alike, each on its own
text. A text of one line still has cuts before and after it, so parts may be
empty. An empty table gives no rows; columns other than id and text are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinspot.llm.stage import stored, whole_text
from kinspot.llm.words import slices, text_bytes

#: fixed by the contract: marks before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: bytes of text that are cut and handed back at once
SLICE_BYTES = 1 << 24
CONTAINER_BITS = 16
BITMAP_WORDS = 1 << (CONTAINER_BITS - 6)


class ArrayContainer:
    """Sorted low halves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class RunContainer:
    """Starts of runs of consecutive values, and how many values lie before each."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start, self.before = low[first].astype(np.uint16), first.astype(np.uint32)

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.start[run]) + rank - int(self.before[run])


class BitmapContainer:
    """One bit for each value, and how many bits are set before each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(BITMAP_WORDS * 64, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)))

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.before, rank, "right")) - 1
        held = int(self.words[word])
        for _ in range(rank - int(self.before[word])):
            held &= held - 1  # clears the lowest bit
        return word * 64 + (held & -held).bit_length() - 1


def container(low: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest container of these sorted low halves."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    sizes = {RunContainer: 4 * len(first), ArrayContainer: 2 * len(low), BitmapContainer: 8 * BITMAP_WORDS}
    kind = min(sizes, key=sizes.__getitem__)
    return kind(low, first) if kind is RunContainer else kind(low)


class BoundarySet:
    """A set of offsets that are asked for by rank."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> CONTAINER_BITS
        begins = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[begins]
        self.before = np.append(begins, len(offsets))  # cumulative cardinalities
        low = offsets & ((1 << CONTAINER_BITS) - 1)
        self.containers = [container(low[a:b]) for a, b in zip(begins, self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        """The offset that ``rank`` others of the set lie before."""
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        return (int(self.keys[at]) << CONTAINER_BITS) + self.containers[at].select(rank - int(self.before[at]))


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Code point offsets of the ends of the lines of a UTF-8 text that is not empty."""
    ends = np.flatnonzero(raw == 0x0A) + 1
    if not len(ends) or ends[-1] != len(raw):
        ends = np.append(ends, len(raw))
    following = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that begin no character
    return ends - np.searchsorted(following, ends) if len(following) else ends


def cut(ends: BoundarySet, first: int, last: int) -> tuple[int, int]:
    """Offsets after ``first`` and after ``last`` lines."""
    return tuple(ends.select(lines - 1) if lines else 0 for lines in (first, last))


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _cut_task(rate: int, spm: int):
    names = [field.split()[0] for field in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            draws = np.stack([batch.column(f"h{i}").to_numpy() for i in range(1, 5)])
            for start, end in slices(offsets, SLICE_BYTES):
                rows = []
                for i in range(start, end):
                    own = raw[offsets[i] : offsets[i + 1]]
                    text, (h1, h2, h3, h4) = own.tobytes().decode(), draws[:, i].tolist()
                    ends = BoundarySet(line_ends(own) if len(own) else np.empty(0, np.int64))
                    n = len(ends)
                    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
                        rows.append((n, "plain", None, None, text))
                        continue
                    a, b = cut(ends, *sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefix, middle, suffix = text[:a], text[a:b], text[b:]
                    if h4 % 100 < spm:
                        rows.append((n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                    else:
                        rows.append((n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), *columns], names)

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n (lines), form, prefix_chars, middle_chars, output.

    ``rate`` of a hundred documents are transformed, ``spm`` of a hundred of
    these with the suffix first; lengths are null where the form is plain.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return whole_text(docs).select("doc_id", "text", *draws).mapInArrow(_cut_task(rate, spm), RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def transformation_report(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them."""
    out = fill_in_middle(docs, seed, rate, spm)
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return stored(out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256")), "fill-in-middle")
