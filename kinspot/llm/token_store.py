"""Token ids in binary shards, with a minimal perfect hash index from document keys to places.

``write_store`` encodes documents in ascending order of their ids and makes
two tables in the shared folder:

* shards: raw little-endian ids of whole documents one after another, about
  ``SHARD_IDS`` ids to a row (a longer document is a row of its own), with the
  keys and ends of its documents beside them;
* index: one row per hash bucket of keys. Its keys are hashed and displaced: a
  seed per small group of keys sends each key to a slot of its own, with as
  many slots as keys. A slot holds the key's fingerprint, its shard, offset
  and length, and how many documents have the key. A lookup reads one row, one seed and one slot, however many
  documents there are; another key passes a fingerprint with chance 2**-32.

Cases: null text is the empty text and still gets its end id. Documents of
equal ids are all stored, in the order of their texts' hashes; the key finds
the first of them and their number, and the others are found in the shards'
directories, which lists them all. A document whose id is null is stored
before all others and has no key to be found by, but is in the directory too.
So reading back by all keys gives every document. No documents make empty
tables, and lookups of absent keys give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from kinspot.llm.encode import encoder
from kinspot.llm.stage import stored, whole_text
from kinspot.llm.words import mix

SHARD_IDS = 1 << 20
#: mean keys of an index row
BUCKET_KEYS = 4096
#: mean keys that share a seed
GROUP_KEYS = 4

SHARDS = "shard long, n_docs long, n_ids long, width int, keys binary, ends binary, ids binary"
INDEX = "bucket long, n_keys long, seeds binary, prints binary, shards binary, offsets binary, lengths binary, copies binary"
PLACES = "doc_id long, shard long, position long, n_tokens long"


@dataclass(frozen=True)
class TokenStore:
    """A written store: its payload, where each shard begins among all ids, and its index."""

    shards: DataFrame
    bases: DataFrame
    index: DataFrame
    n_buckets: int


def id_width(vocabulary: str, *extra: int) -> int:
    """Bytes an id takes: two where the vocabulary and the extra ids allow it, else four."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1, *extra) < 1 << 16 else 4


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with ``end_id`` after each, and the new bounds."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, bounds + np.arange(n + 1)


def _shard_task(vocabulary: str, end_id: int, width: int):
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            own, flat, ends = np.concatenate(keys), np.concatenate(ids), np.cumsum(np.concatenate(lengths))
            row = [number, len(own), len(flat), width, own.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), flat.astype(kind).tobytes()]
            names = ["shard", "n_docs", "n_ids", "width", "keys", "ends", "ids"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            # a null id becomes the smallest integer, which is marked as no key
            own_keys = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            flat, bounds = with_end(*encoder(vocabulary).encode(batch.column("text")), end_id)
            first = 0
            while first < len(own_keys):
                room = bounds[first] + SHARD_IDS - held
                last = max(first + (held == 0), int(np.searchsorted(bounds, room, "right")) - 1)
                if last > first:
                    keys.append(own_keys[first:last])
                    ids.append(flat[bounds[first] : bounds[last]])
                    lengths.append(np.diff(bounds[first : last + 1]))
                    held += int(bounds[last] - bounds[first])
                    first = last
                if first < len(own_keys):
                    yield shard()
                    number += 1
                    keys, ids, lengths, held = [], [], [], 0
        if keys:
            yield shard()

    return run


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key (null: none), shard, offset and length of each stored document."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, ends = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["ends"], "<i8")
            offsets = np.concatenate(([0], ends[:-1]))
            columns = [np.full(len(keys), row["shard"]), offsets, ends - offsets]
            own = pa.array(keys, pa.int64(), mask=keys == np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "shard", "position", "n_tokens"])


def _key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64))


def _slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes ^ mix(seeds.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the groups, and the slot of each key; every slot from 0 to n - 1 is taken once.

    Groups are placed from the largest down. A group of several keys tries
    seeds, many at once, until its keys fall into free slots of their own; a
    group of one takes any free slot, stored as ``-1 - slot``.
    """
    n = len(hashes)
    n_groups = max(1, -(-n // GROUP_KEYS))
    group = ((hashes >> np.uint64(33)) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(n_groups + 1))
    seeds, slot, free = np.zeros(n_groups, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    sizes = np.diff(starts)
    for g in np.argsort(-sizes, kind="stable"):
        own = order[starts[g] : starts[g + 1]]
        if len(own) == 0:
            break
        if len(own) == 1:
            break
        first = 1
        while True:
            tried = np.arange(first, first + 256)
            at = _slots(hashes[own][None, :], tried[:, None], n)
            ok = free[at].all(1)
            if ok.any():
                at_sorted = np.sort(at[ok], 1)
                apart = (at_sorted[:, 1:] != at_sorted[:, :-1]).all(1)
                if apart.any():
                    pick = np.flatnonzero(ok)[np.argmax(apart)]
                    seeds[g], slot[own] = tried[pick], at[pick]
                    free[at[pick]] = False
                    break
            first += 256
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)
    seeds[single] = -1 - left
    slot[order[starts[single]]] = left
    return seeds, slot


def find_slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot a key has under ``perfect_hash``'s seeds; absent keys get a slot of another key."""
    own = seeds[((hashes >> np.uint64(33)) % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(own < 0, -1 - own, _slots(hashes, np.maximum(own, 0), n))


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (mix(~hashes) >> np.uint64(32)).astype("<u4")


def _build_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    hashes = _key_hash(rows["doc_id"].to_numpy())
    seeds, slot = perfect_hash(hashes)

    def placed(values: np.ndarray, kind: str) -> bytes:
        out = np.zeros(len(values), kind)
        out[slot] = values
        return out.tobytes()

    return pd.DataFrame([{
        "bucket": rows["bucket"].iloc[0], "n_keys": len(rows), "seeds": seeds.astype("<i8").tobytes(),
        "prints": placed(_prints(hashes), "<u4"), "shards": placed(rows["shard"].to_numpy(), "<i8"),
        "offsets": placed(rows["position"].to_numpy(), "<i8"), "lengths": placed(rows["n_tokens"].to_numpy(), "<i8"),
        "copies": placed(rows["copies"].to_numpy(), "<i8"),
    }])


def _bucket(n_buckets: int):
    # another hash than the slots', so that a bucket's keys stay spread over its groups
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).alias("bucket")


def write_store(docs: DataFrame, vocabulary: str, end_id: int) -> TokenStore:
    """Encode ``docs`` (doc_id, text) and write shards and index; see the module's text."""
    width = id_width(vocabulary, end_id)
    texts = whole_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = stored(ordered.mapInArrow(_shard_task(vocabulary, end_id, width), SHARDS), "token-shards")

    # running sums in two steps: partitions of the write, then shards within one
    counts = shards.select("shard", "n_ids", "n_docs", F.shiftright("shard", 32).alias("part"))
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    bases = stored(bases.select("shard", "n_docs", (F.col("base") + F.col("part_base")).alias("base")), "token-bases")

    n_docs = bases.agg(F.sum("n_docs")).first()[0] or 0
    n_buckets = max(1, math.ceil(n_docs / BUCKET_KEYS))
    # a key of many documents is one row before it reaches its bucket
    first = F.min(F.struct("shard", "position", "n_tokens")).alias("first")
    entries = directory(shards).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(first, F.count("*").alias("copies"))
    index = entries.select("doc_id", "first.*", "copies").withColumn("bucket", _bucket(n_buckets)).groupBy("bucket").applyInPandas(_build_bucket, INDEX)
    return TokenStore(shards, bases, stored(index, "token-index"), n_buckets)


def directory(shards: DataFrame) -> DataFrame:
    """Place of every stored document, in no order; only keys and ends are read."""
    return shards.select("shard", "keys", "ends").mapInArrow(_directory, PLACES)


def _look_up(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    names = ["doc_id", "shard", "position", "n_tokens", "copies"]
    if keys.empty or index.empty:
        return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
    row, wanted = index.iloc[0], keys["doc_id"].to_numpy()
    hashes = _key_hash(wanted)
    slot = find_slots(hashes, np.frombuffer(row["seeds"], "<i8"), int(row["n_keys"]))
    same = np.frombuffer(row["prints"], "<u4")[slot] == _prints(hashes)
    slot = slot[same]
    found = [np.frombuffer(row[c], "<i8")[slot] for c in ("shards", "offsets", "lengths", "copies")]
    return pd.DataFrame(dict(zip(names, [wanted[same], *found], strict=True)))


def look_up(store: TokenStore, keys: DataFrame) -> DataFrame:
    """First place of each distinct key of ``keys`` (doc_id): shard, position, length, and number of documents, in one probe of the index."""
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    wanted = wanted.withColumn("bucket", _bucket(store.n_buckets))
    return wanted.groupBy("bucket").cogroup(store.index.groupBy("bucket")).applyInPandas(
        _look_up, f"{PLACES}, copies long")


def _read_shard(places: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
    if places.empty or shards.empty:
        return pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "shard": pd.Series(dtype="int64"), "position": pd.Series(dtype="int64"), "ids": pd.Series(dtype="object")})
    row = shards.iloc[0]
    flat = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").tobytes()
    cut = [flat[4 * p : 4 * (p + n)] for p, n in zip(places["position"], places["n_tokens"], strict=True)]
    return places[["doc_id", "shard", "position"]].assign(ids=cut)


def _read_places(store: TokenStore, places: DataFrame) -> DataFrame:
    """Ids at ``places`` (doc_id, shard, position, n_tokens): doc_id, start among all ids, ids as little-endian 32-bit bytes."""
    payload = store.shards.select("shard", "width", "ids")
    found = places.groupBy("shard").cogroup(payload.groupBy("shard")).applyInPandas(
        _read_shard, "doc_id long, shard long, position long, ids binary")
    placed = found.join(store.bases.select("shard", "base"), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("position")).alias("start"), "ids")


def read_ids(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Ids of all documents that the ``keys`` (doc_id) name; a null key names those without id."""
    found = stored(look_up(store, keys), "places")
    places = found.filter("copies = 1").drop("copies")
    several = found.filter("copies > 1").select("doc_id")
    if not several.isEmpty():
        places = places.union(directory(store.shards).join(several, "doc_id", "left_semi"))
    if not keys.filter("doc_id IS NULL").isEmpty():
        places = places.union(directory(store.shards).filter("doc_id IS NULL"))
    return _read_places(store, places)


def token_index(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as a store, read every document back by the keys, and describe it: one row per row of ``docs``."""
    read = read_ids(write_store(docs, vocabulary, end_id), docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
