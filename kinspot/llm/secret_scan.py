"""Secrets in texts: fixed patterns, and strings that compression cannot explain from their surroundings.

The base kinds are ``assign``, ``access`` and ``hex`` (patterns below). The
method adds kind ``novel``: a long string of letters and digits after a
sensitive word is compressed behind its surroundings, with a zstandard
dictionary of common identifiers; if the bytes it adds are at least ``NOVEL``
of its length, it repeats nothing around it and is no identifier, and is
reported. A candidate starts near the word and is taken whole, however long it
is. Base spans stay as they are, and a novel span never overlaps one.

Positions count code points and the end is exclusive. Null and empty texts
have no spans. Rows are judged one by one, so repeated rows, equal ids and
null ids each give a row of their own; no documents give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kinspot.llm.stage import lean, stored
from kinspot.llm.words import slices, text_bytes

#: fixed by the contract
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")

#: words before a candidate that make its context a sensitive one
SENSITIVE = r"pass(?:word|wd|phrase)|secret|token|credential|api_?key|private_?key|auth(?:orization)?|bearer"
#: code points between a sensitive word and a candidate, and of surroundings on either side
REACH, AROUND = 40, 1024
CANDIDATE_LEAST = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_LEAST
#: bytes that a candidate must add for each of its own
NOVEL = 0.65
#: identifiers that need no explanation
IDENTIFIERS = (
    "self return import from class public private static final void string boolean integer config settings "
    "environment variable process client server request response header authorization bearer content type "
    "application json username password secret token api_key access_key credential private_key public_key "
    "database connection host port localhost default example placeholder changeme your_password_here "
    "your_api_key_here test_token dummy_secret null none undefined true false function const let var export "
    "getenv os.environ process.env System.getProperty base64 encode decode sha256 md5 uuid "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000"
)
#: bytes of text that are masked and handed back at once
SLICE_BYTES = 1 << 26
SPANS = "array<struct<kind:string,start:long,end:long>>"
MARK = "[SECRET]"


class Scanner:
    """Finds the spans of one text after another."""

    def __init__(self, identifiers: str, novel: float):
        import zstandard

        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
        self.hex = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
        self.sensitive = re.compile(SENSITIVE, re.IGNORECASE | re.ASCII)
        self.candidate = re.compile(CANDIDATE)
        self.novel = novel
        known = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=6, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added_bytes(self, before: str, string: str, after: str) -> int:
        """Compressed bytes that ``string`` adds to its surroundings."""
        around = (before + "\n" + after + "\n").encode()
        return len(self.packer.compress(around + string.encode())) - len(self.packer.compress(around))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """Start, number of the kind and end of each base span, in that order."""
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        # a run that is too short for its kind holds no shorter one that is not, so the least length may go first
        found += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def candidates(self, text: str, first: int) -> Iterator[tuple[int, int]]:
        """Whole candidates that start at ``first`` or up to ``REACH`` after it."""
        at = first
        # the least candidate that starts in reach ends here, so looking for a start never reads on
        while m := self.candidate.search(text, at, min(len(text), first + REACH + CANDIDATE_LEAST)):
            start, at = self.candidate.match(text, m.start()).span()
            yield start, at

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and novel ones."""
        base = self.base(text)
        # where the base spans begin, and how far those up to each one go
        begins, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
        last, novel = -1, []
        for word in self.sensitive.finditer(text):
            for start, end in self.candidates(text, word.end()):
                before = bisect_left(begins, end)
                if start <= last or (before and reach[before - 1] > start):
                    continue
                last, string = start, text[start:end]
                if not (any(c.isdigit() for c in string) and any(c.isalpha() for c in string)):
                    continue
                if self.added_bytes(text[max(0, start - AROUND) : start], string, text[end : end + AROUND]) >= self.novel * len(string):
                    novel.append((start, 3, end))
        return sorted(base + novel)


_WORTH_A_LOOK = rf"(?i:{SENSITIVE})|AKIA|[0-9a-f]{{{HEX_LEAST}}}"


def _scan_column(scanner: Scanner, column: pa.Array) -> list[list[tuple[int, int, int]]]:
    worth = pc.fill_null(pc.match_substring_regex(column, _WORTH_A_LOOK), False).to_pylist()
    return [scanner.spans(column[i].as_py()) if look else [] for i, look in enumerate(worth)]


def _find_task(identifiers: str, novel: float):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(identifiers, novel)
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in _scan_column(scanner, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, identifiers: str = IDENTIFIERS, novel: float = NOVEL) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end; by start, then kind) of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(lean(_find_task(identifiers, novel)), f"doc_id long, spans {SPANS}")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts together have about ``SLICE_BYTES``."""
    for first, last in slices(text_bytes(batch.column("text"))[1], SLICE_BYTES):
        yield batch.slice(first, last - first)


def _mask_task(identifiers: str, novel: float, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(identifiers, novel)
        for batch in (part for whole in batches for part in _parts(whole)):
            texts, lengths = batch.column("text").to_pylist(), None
            for i, spans in enumerate(_scan_column(scanner, batch.column("text"))):
                if spans:
                    out, at = [], 0
                    for start, _, end in spans:
                        if start >= at:
                            out += [texts[i][at:start], mark]
                        at = max(at, end)
                    texts[i] = "".join([*out, texts[i][at:]])
            columns = {f.name: batch.column(f.name) for f in batch.schema}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                lengths = pc.utf8_length(columns["text"])
                columns["n_chars"] = lengths.cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def mask_secrets(docs: DataFrame, identifiers: str = IDENTIFIERS, novel: float = NOVEL, mark: str = MARK) -> DataFrame:
    """``docs`` with each secret replaced by ``mark``, overlapping ones by one; ``n_chars`` follows if it is there."""
    return docs.mapInArrow(lean(_mask_task(identifiers, novel, mark)), docs.schema)


def secret_report(docs: DataFrame, identifiers: str = IDENTIFIERS, novel: float = NOVEL) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    found = stored(find_secrets(docs, identifiers, novel), "secrets")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
