"""Text functions as Columns; all but the overlap of words and the tokens of whole tables stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# --- fixed values -----------------------------------------------------------
# White space as Unicode (and Python's str.split) sees it, for use inside [...].
WHITESPACE = (
    r"\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)  # the same characters, the plain space left out
# A token is a run of ASCII word characters or one other visible character.
TOKEN_PATTERN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{WHITESPACE}]"
FENCES = ("```json", "```python", "```")
MIN_TOKENS = 30
MAX_TOKENS = 8000
#: bytes of texts whose tokens are held as one batch, about
BATCH_CHARS = 1 << 20
# ----------------------------------------------------------------------------


def tokenize(text: Column | str) -> Column:
    """Tokens of a text in order, with repetition."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


# What a byte of a text is: white space, of a word, the first byte of another character, or one that follows it.
_SPACE, _WORD, _OTHER, _FOLLOWS = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[c for c in range(128) if re.match("[A-Za-z0-9_]", chr(c))]] = _WORD
_KINDS[[ord(c) for c in " " + SPACES if ord(c) < 128]] = _SPACE
_KINDS[0x80:0xC0] = _FOLLOWS
# first bytes of white space of two and three bytes, and the bytes that follow them
_WIDE_SPACES = {first: [c[1:] for c in map(str.encode, SPACES) if c[0] == first] for first in {c.encode()[0] for c in SPACES} - set(range(128))}


def tokenised(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text`` for :func:`token_batches`: a null text is empty, and bytes that are no UTF-8 are replaced."""
    return docs.select(F.col(id_col).alias("doc_id"), F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (document, tokens) of rows (document, text), tokens as :func:`tokenize` gives them.

    Works on the bytes of many texts at once: a token is a string of the
    batch's bytes without white space, and no Python object.
    """
    for batch in batches:
        ids, texts, start = batch.column(0), batch.column(1).cast(pa.string()), 0
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + BATCH_CHARS, "right")) - 1)
            lists = _token_lists(data[ends[start] : ends[end]], ends[start : end + 1] - ends[start])
            yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), lists], names=["doc_id", "tokens"])
            start = end


def _token_lists(data: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Tokens of texts that lie one after the other in ``data``, each from one of the ``bounds`` to the next."""
    kind = np.take(_KINDS, data)
    for first, tails in _WIDE_SPACES.items():
        at = np.flatnonzero(data == first)
        for tail in tails if len(at) else ():
            here = at[at + len(tail) < len(data)]
            for i, byte in enumerate(tail, 1):
                here = here[data[here + i] == byte]
            for i in range(len(tail) + 1):
                kind[here + i] = _SPACE
    word = kind == _WORD
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    begins[heads] = word[heads]
    begins |= kind == _OTHER
    kept = kind != _SPACE
    at = np.flatnonzero(begins)
    text = np.compress(kept, data)
    offsets = np.append((np.cumsum(kept, dtype=np.int32) - 1)[at], len(text)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(text))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), tokens)


def whitespace_tokens(text: Column | str) -> Column:
    """Distinct white-space separated words of a text."""
    # a split at one plain character needs no regular expression
    words = F.split(F.translate(text, SPACES, " " * len(SPACES)), " ")
    return F.array_remove(F.array_distinct(words), "")


def strip(text: Column | str) -> Column:
    """Trim white space of every kind at both ends."""
    return F.regexp_replace(text, rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def strip_fences(text: Column | str) -> Column:
    """Drop Markdown code fences around (or inside) an answer, and trim it."""
    out = strip(text)
    for fence in FENCES:
        out = F.replace(out, F.lit(fence), F.lit(""))
    return strip(out)


def path_tail(path: Column | str) -> Column:
    """Last segment of a path or URL, without trailing slashes and ``.git``."""
    trimmed = F.rtrim(path, F.lit("/"))
    return F.replace(F.substring_index(trimmed, "/", -1), F.lit(".git"), F.lit(""))


def in_token_band(n_tokens: Column, low: int = MIN_TOKENS, high: int = MAX_TOKENS) -> Column:
    """True when a token count lies in the band, both ends included."""
    return n_tokens.between(low, high)


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two sets given as arrays without repeats; 0 when both are empty."""
    sizes = F.struct(
        F.size(F.array_intersect(left, right)).alias("shared"), (F.size(left) + F.size(right)).alias("total")
    )
    # binding the sizes to a lambda variable computes the intersection once
    ratio = F.transform(F.array(sizes), lambda s: F.try_divide(s["shared"], s["total"] - s["shared"]))
    return F.coalesce(ratio[0], F.lit(0.0))


def token_jaccard(left: Column | str, right: Column | str) -> Column:
    """Jaccard overlap of the white-space words of two texts."""
    return token_jaccards(left, F.array(right))[0]


def token_jaccards(text: Column | str, others: Column) -> Column:
    """:func:`token_jaccard` of a text with each of an array of texts; its own words are found once.

    Runs in Python, whose ``split`` and sets take a third of the time of array functions.
    """
    return _word_overlaps(text, others)


@F.arrow_udf(returnType=ArrayType(DoubleType()))
def _word_overlaps(texts: pa.Array, others: pa.Array) -> pa.Array:
    def words(text: str | None) -> set[str]:
        return set((text or "").split())

    def ratio(own: set[str], other: set[str]) -> float:
        shared = len(own & other)
        total = len(own) + len(other) - shared
        return shared / total if total else 0.0

    out = []
    for text, several in zip(texts, others, strict=True):
        own = words(text.as_py())
        out.append(None if not several.is_valid else [ratio(own, words(other.as_py())) for other in several.values])
    return pa.array(out, pa.list_(pa.float64()))


def containment(query_tokens: Column, context_tokens: Column) -> Column:
    """Share of the query's distinct tokens that also occur in the context."""
    distinct = F.array_distinct(query_tokens)
    shared = F.size(F.array_intersect(distinct, context_tokens))
    return F.coalesce(F.try_divide(shared, F.size(distinct)), F.lit(0.0))


def whole_json(text: str | Column) -> Column:
    """A variant of text that is one JSON value and nothing else; null for any other text.

    The JSON parser accepts text after a value, so the value is parsed inside
    an object whose last member must be found intact. An object that names a
    key twice is not accepted.
    """
    column = F.col(text) if isinstance(text, str) else text
    enclosed = F.try_parse_json(F.concat(F.lit('{"a":'), column, F.lit(',"z":0}')))
    members = F.try_variant_get(enclosed, "$", "map<string,variant>")
    return F.when(F.size(members) == 2, F.try_element_at(members, F.lit("a")))
