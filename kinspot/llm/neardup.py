"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. One pass over the texts gives every document the size and a 128-bit key of
   its set of hashed word shingles, a MinHash signature and its band buckets.
   Documents of equal sets are one class, which the smallest id stands for.
2. Class representatives that share a bucket are candidates. A bucket's
   members meet one hub, never each other all: the member that meets most
   others over all its buckets, as the text does that the others of a group
   were made of. Large groups are one component by then. Buckets that still
   hold several components are done exactly by what their members do not
   share, in two equi-joins:
   * A pair with a shingle that few open documents hold (``RARE`` at most) is
     found by this shingle, which makes a bounded number of pairs.
   * Of all others, each document is described by its difference from the
     hub: shingles added and missing. Two documents can be linked only if
     their differences overlap enough, which grows with the differences, and
     one of them is not linked to the hub. So a pair shares one of the
     rarest shingles of both differences (a prefix filter), and copies that
     differ from the hub each in its own way never meet.
3. Signatures of a pair are compared a batch of positions at a time. With a
   uniform prior, m matches in n positions make the chance of a similarity of
   at least t equal to P(Bin(n + 1, t) <= m); below ``miss`` the pair goes.
4. Surviving pairs are verified on the full shingle sets of their whole texts,
   each document's likeliest pair first and then the others; pairs within one
   component by then need no verification, since they can change nothing.

The number of bands is chosen so that a pair at the threshold shares none of
them with a chance below ``miss``.

Cases: null and empty texts and texts without words have the empty set, are
linked with nothing and kept. Fewer words than ``k`` make one shingle. Rows
without id are linked with nothing and kept, with a null component. Rows that
share an id are judged each by its own text. Copies of one text are one class.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinspot.llm.components import components
from kinspot.llm.stage import lean, stored, whole_text
from kinspot.llm.words import SPACE, hashed_words, mix, shingles

BAND_ROWS = 5
MISS = 1e-6
#: positions that are compared before the next look at the bounds
BATCH = 20
#: documents that hold a rare shingle, at most
RARE = 32
#: parts that the members of one hub are dealt to
SALTS = 16


def n_bands(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` positions so that a pair at ``threshold`` shares none with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def least_matches(n: int, threshold: float, miss: float = MISS) -> int:
    """Fewest matches in ``n`` positions that leave a posterior chance of ``miss`` for ``threshold`` or more."""
    total, log = 0.0, math.lgamma(n + 2)
    for m in range(n + 1):
        total += math.exp(log - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        if total >= miss:
            return m
    return n


def _sign_task(k: int, bands: int, rows: int, separators: np.ndarray):
    rng = np.random.default_rng(7)
    n = bands * rows
    flips = rng.integers(0, 2**32, n, dtype=np.uint32)
    factors = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, starts in hashed_words(batch.column("text"), separators):
                value, owner = shingles(words, starts, k)
                docs = last - first
                sizes = np.bincount(owner, minlength=docs)
                some = np.flatnonzero(sizes)
                begin = (np.cumsum(sizes) - sizes)[some]
                low = np.full((len(some), n), np.uint32(0xFFFFFFFF))
                key_a, key_b = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
                if len(some):
                    short = (value >> np.uint64(32)).astype(np.uint32)
                    for i in range(n):
                        low[:, i] = np.minimum.reduceat((short ^ flips[i]) * factors[i], begin)
                    key_a[some] = np.add.reduceat(mix(value), begin)
                    key_b[some] = np.add.reduceat(mix(~value), begin)
                buckets = np.full((docs, bands), np.uint64(0))
                for b in range(bands):
                    held = np.full(len(some), np.uint64(b))
                    for r in range(rows):
                        held = mix(held ^ low[:, b * rows + r].astype(np.uint64))
                    buckets[some, b] = held
                signs = np.zeros((docs, n), "<u2")
                signs[some] = (low & np.uint32(0xFFFF)).astype("<u2")
                flat = pa.array(buckets.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, docs), batch.column("text_key").slice(first, docs), pa.array(sizes, pa.int64()), pa.array(key_a.view(np.int64)), pa.array(key_b.view(np.int64)),
                     pa.array([s.tobytes() for s in signs], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * bands, pa.int32()), flat)],
                    ["doc_id", "text_key", "n_shingles", "key_a", "key_b", "signature", "buckets"])

    return run


def _prune_task(threshold: float, miss: float, batch_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hub, member = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("hub_signature", "signature"))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for at in range(0, hub.shape[1], batch_size):
                end = min(at + batch_size, hub.shape[1])
                matches[alive] += (hub[alive, at:end] == member[alive, at:end]).sum(1)
                alive = alive[matches[alive] >= least_matches(end, threshold, miss)]
            kept = batch.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays(
                [*(kept.column(c) for c in ("hub", "member", "hub_a", "hub_b", "key_a", "key_b")), pa.array(matches[alive])],
                ["hub", "member", "hub_a", "hub_b", "key_a", "key_b", "matches"])

    return run


PAIRS = "hub long, member long, hub_a long, hub_b long, key_a long, key_b long, matches long"


def _sets(column: pa.Array, k: int, separators: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for first, last, words, starts in hashed_words(column, separators):
        value, owner = shingles(words, starts, k)
        out += np.split(value, np.searchsorted(owner, np.arange(1, last - first)))
    return out


def _verify_task(k: int, percent: int, separators: np.ndarray):
    def same(own: np.ndarray, a: int, b: int) -> bool:
        return (int(mix(own).sum().view(np.int64)), int(mix(~own).sum().view(np.int64))) == (a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, members = (_sets(batch.column(c), k, separators) for c in ("hub_text", "text"))
            keys = [batch.column(c).to_pylist() for c in ("hub_a", "hub_b", "key_a", "key_b")]
            linked = []
            for x, y, a, b, c, d in zip(hubs, members, *keys, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                # where rows share an id, only the texts that were signed count
                linked.append(100 * both >= percent * (len(x) + len(y) - both) and same(x, a, b) and same(y, c, d))
            kept = pa.array(np.flatnonzero(linked))
            yield pa.RecordBatch.from_arrays([batch.column("hub").take(kept), batch.column("member").take(kept)], ["hub", "member"])

    return run


def _post_task(k: int, separators: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, starts in hashed_words(batch.column("text"), separators):
                value, owner = shingles(words, starts, k)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first).take(pa.array(owner)), pa.array(value.view(np.int64))], ["id", "shingle"])

    return run


def _least_common(n: Column, other: Column, percent: int) -> Column:
    """Fewest common shingles with which sets of these sizes can be linked."""
    return F.ceil(percent * (n + other) / (100 + percent))


def _rare_pairs(pool: DataFrame, own: DataFrame, k: int, percent: int, separators: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pool`` with the number of each document's rare shingles, these shingles, and the pairs that can be linked by sharing some."""
    open_docs = pool.select(F.col("id").alias("doc_id"), "n", "component").distinct()
    texts = own.join(open_docs.select("doc_id").distinct(), "doc_id", "left_semi")
    held = stored(texts.mapInArrow(lean(_post_task(k, separators)), "id long, shingle long"), "open-shingles")
    few = held.groupBy("shingle").agg(F.count("*").alias("holders")).filter(F.col("holders") <= RARE)
    rare = stored(held.join(few, "shingle"), "rare-shingles")
    # rows that share an id count as one document here, whose rare shingles prove nothing about either text
    once = texts.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"))
    counted = rare.groupBy("id").agg(F.count("*").alias("rare")).join(once.filter("rows = 1"), "id").select("id", "rare")
    pool = stored(pool.drop("rare").join(counted, "id", "left").withColumn("rare", F.coalesce("rare", F.lit(0))).select(*pool.columns), "bucket-members")
    about = pool.select("id", "n", "rare", "component").distinct()
    posted = rare.filter("holders > 1").select("id", "shingle").join(about, "id")
    left = posted.toDF("hub", "shingle", "hub_n", "hub_rare", "hub_component")
    right = posted.withColumnRenamed("id", "member")
    met = left.join(right, "shingle").filter("hub < member AND hub_component <> component")
    met = met.groupBy("hub", "member", "hub_n", "n", "hub_rare", "rare").agg(F.count("*").alias("shared"))
    least = _least_common(F.col("hub_n"), F.col("n"), percent)
    enough = F.col("shared") >= F.greatest(F.col("hub_rare") - F.col("hub_n"), F.col("rare") - F.col("n")) + least
    return pool, rare.select("shingle").distinct(), met.filter(enough).select("hub", "member")


def _difference_task(k: int, separators: np.ndarray):
    """Shingles of each text that its hub lacks (added) and the other way round, for rows (hub, id, hub_text, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, members = (_sets(batch.column(c), k, separators) for c in ("hub_text", "text"))
            for row, (h, a) in enumerate(zip(hubs, members, strict=True)):
                added, missing = np.setdiff1d(a, h, True), np.setdiff1d(h, a, True)
                n = len(added) + len(missing)
                if not n:
                    continue
                same = [batch.column(c).slice(row, 1).take(pa.array(np.zeros(n, np.int64))) for c in ("hub", "id")]
                numbers = [int(mix(x).sum().view(np.int64)) for x in (h, a)] + [len(h), len(a), len(added), len(missing)]
                yield pa.RecordBatch.from_arrays(
                    [*same, *(pa.array(np.full(n, x)) for x in numbers), pa.array(np.concatenate((added, missing)).view(np.int64)), pa.array(np.arange(n) < len(added))],
                    ["hub", "id", "hub_key", "key", "hub_n", "n", "n_added", "n_missing", "shingle", "added"])

    return run


DIFFERENCES = "hub long, id long, hub_key long, key long, hub_n long, n long, n_added long, n_missing long, shingle long, added boolean"


def _difference_pairs(pool: DataFrame, hubs: DataFrame, rare: DataFrame, own: DataFrame, k: int, percent: int, separators: np.ndarray) -> DataFrame:
    """Pairs of open documents of different components that can be linked without sharing a rare shingle.

    With all sizes times ``100 + percent``, x and y are linked if their
    differences from the hub share at least ``W(x) + W(y) - S`` shingles, where
    ``W = percent * added + 100 * missing`` and ``S = (100 - percent) * size of
    the hub``; a document is linked to the hub itself if ``W <= S``. So what is
    not linked to the hub has ``W > S``, and whoever meets it shares more than
    its own ``W``. Rare shingles are not shared, and count in ``W`` only.
    """
    scale = 100 + percent
    able = F.col("rare") <= F.col("n") - F.ceil(F.col("n") * percent / 100)
    # all buckets whose hubs are of one component refer to that component's most central hub
    first = hubs.groupBy("component").agg(F.min(F.struct("order", "id")).alias("h")).select("component", F.col("h.id").alias("hub"))
    refer = hubs.join(first, "component").select("bucket", "hub", F.col("component").alias("hub_component"))
    here = stored(pool.join(refer, "bucket").filter(able).select("hub", "hub_component", "id", "component", "rare").distinct(), "able-members")
    # where all are of the hub's component there is no pair left; a large group is dealt to SALTS parts
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    apart = here.filter("component <> hub_component").select("hub").distinct().select("hub", copies)
    here = here.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(apart, ["hub", "salt"], "left_semi")
    hub_texts = own.toDF("hub", "hub_text").join(apart.select("hub").distinct(), "hub", "left_semi").select("hub", "hub_text", copies)
    both = here.select("hub", "salt", "id").join(own.toDF("id", "text"), "id").join(hub_texts, ["hub", "salt"]).drop("salt")
    different = stored(both.mapInArrow(lean(_difference_task(k, separators)), DIFFERENCES), "differences")
    shared = different.join(rare.withColumn("added", F.lit(True)), ["shingle", "added"], "left_anti")
    holders = shared.groupBy("hub", "hub_key", "shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    member = ["hub", "hub_key", "id", "key"]
    sizes = shared.groupBy(*member).agg(F.count("*").alias("d"))
    rows = shared.join(sizes, member).join(here.drop("salt"), ["hub", "id"]).withColumn("w", percent * F.col("n_added") + 100 * F.col("n_missing"))
    inner = F.col("component") == F.col("hub_component")
    beyond = F.col("d") - F.floor(F.col("w") / scale)  # the prefix where the partner is not linked to the hub
    least = F.greatest(F.lit(1), F.ceil((F.col("w") - (100 - percent) * F.col("hub_n")) / scale))
    rows = rows.withColumn("beyond", beyond).withColumn("prefix", F.when(inner, beyond).otherwise(F.col("d") - least + 1)).filter("prefix > 0")
    # shingles that one difference holds come first in the order and make no pair
    rows = rows.join(holders, ["hub", "hub_key", "shingle"], "left")
    alone = F.count(F.when(F.col("holders").isNull(), 1)).over(Window.partitionBy(*member))
    place = F.row_number().over(Window.partitionBy(*member).orderBy(F.asc_nulls_first("holders"), "shingle"))
    rows = rows.withColumn("alone", alone).filter(F.col("alone") < F.col("prefix")).withColumn("place", place)
    rows = rows.filter((F.col("place") <= F.col("prefix")) & F.col("holders").isNotNull())
    rows = stored(rows.select(*member[:2], "shingle", "id", "n", "rare", "component", inner.alias("inner"), (F.col("place") <= F.col("beyond")).alias("close")), "difference-prefixes")
    names = ["id", "n", "rare", "component", "inner", "close"]
    left = rows.filter("NOT inner").withColumnsRenamed({c: f"hub_{c}" for c in names}).withColumnRenamed("hub", "of")
    met = left.join(rows.withColumnRenamed("hub", "of"), ["of", "hub_key", "shingle"])
    met = met.filter("hub_component <> component AND (inner OR (close AND hub_close AND hub_id < id))")
    common = _least_common(F.col("hub_n"), F.col("n"), percent)
    near = (F.least("n", "hub_n") >= common) & (F.col("rare") <= F.col("n") - common) & (F.col("hub_rare") <= F.col("hub_n") - common)
    return met.filter(near).select(F.col("hub_id").alias("hub"), F.col("id").alias("member")).distinct()


def _open(pool: DataFrame) -> DataFrame:
    """Members of buckets that hold several components."""
    several = pool.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket")
    return pool.join(several, "bucket", "left_semi")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS, separators: np.ndarray = SPACE) -> DataFrame:
    """Components of documents linked by ``100 * intersection >= percent * union`` of their k-word shingle sets.

    Returns per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id (smallest id reachable), kept (the component's own id) and
    text_key (hash of the text, which tells rows of one id apart).
    """
    threshold = percent / 100
    bands = n_bands(threshold, BAND_ROWS, miss)
    texts = whole_text(docs)
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    signed = stored(keyed.mapInArrow(lean(_sign_task(k, bands, BAND_ROWS, separators)), "doc_id long, text_key long, n_shingles long, key_a long, key_b long, signature binary, buckets array<long>"), "signatures")
    narrow = signed.select("doc_id", "text_key", "n_shingles", "key_a", "key_b")
    keys = ["key_a", "key_b"]
    classes = narrow.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.min("doc_id").alias("doc_id"))
    reps = signed.join(classes, [*keys, "doc_id"]).dropDuplicates([*keys, "doc_id"])
    reps = stored(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), *keys, "signature", "buckets"), "representatives")

    posted = reps.select(F.explode("buckets").alias("bucket"), "id", "n")
    shared = posted.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    pool = stored(posted.join(shared, "bucket"), "bucket-members")
    central = pool.groupBy("id").agg(F.sum("members").alias("met"))
    pool = stored(pool.join(central, "id").select("bucket", "id", "n", F.lit(0).cast("long").alias("rare"), "met", F.col("id").alias("component")), "bucket-members")
    # never a broadcast, as the number of members grows with the documents
    own = stored(texts.join(pool.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "candidate-texts")
    signs = reps.select("id", *keys, "signature")
    labels = reps.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)

    def linked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """``labels`` with the links that ``pairs`` really are."""
        both = pairs.join(own.toDF("member", "text"), "member").join(own.toDF("hub", "hub_text"), "hub")
        found = stored(both.mapInArrow(lean(_verify_task(k, percent, separators)), "hub long, member long"), "links")
        return labels if found.isEmpty() else stored(components(labels.union(found)), "components")

    def pruned(pairs: DataFrame) -> DataFrame:
        """``pairs`` (hub, member) whose signatures leave them a chance."""
        signed_pairs = pairs.join(signs.toDF("hub", "hub_a", "hub_b", "hub_signature"), "hub").join(signs.withColumnRenamed("id", "member"), "member")
        return stored(signed_pairs.mapInArrow(lean(_prune_task(threshold, miss, BATCH)), PAIRS), "survivors")

    def settled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """``labels`` with the links among ``pairs`` (hub, member), which are pruned by their signatures and verified."""
        pairs = pruned(pairs)
        if pairs.isEmpty():
            return labels
        likeliest = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("matches"), "hub", "hub_a", "hub_b", "key_a", "key_b"))
        ranked = pairs.withColumn("turn", likeliest)
        labels = linked(ranked.filter("turn = 1"), labels)
        left = ranked.filter("turn > 1").join(labels.toDF("hub", "hub_component"), "hub", "left").join(labels.toDF("member", "component"), "member", "left")
        left = left.filter(F.coalesce("hub_component", "hub") != F.coalesce("component", "member")).select(*pairs.columns)
        left = stored(left, "survivors")
        return labels if left.isEmpty() else linked(left, labels)

    def still_open(pool: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of buckets of several components, which have nothing left to find otherwise."""
        now = pool.drop("component").join(labels.withColumnRenamed("node", "id"), "id", "left")
        return stored(_open(now.withColumn("component", F.coalesce("component", "id")).select(*pool.columns)), "bucket-members")

    # one hub a bucket
    drawn = F.struct((-F.col("met")).alias("order"), F.xxhash64("id", "bucket").alias("draw"), "id", "n")
    hubs = stored(pool.groupBy("bucket").agg(F.min(drawn).alias("h")).select("bucket", "h.id", "h.n", "h.order"), "hubs")
    met = pool.join(hubs.select("bucket", F.col("id").alias("hub"), F.col("n").alias("hub_n")), "bucket")
    met = met.filter((F.col("hub") != F.col("id")) & (F.least("n", "hub_n") >= _least_common(F.col("hub_n"), F.col("n"), percent)))
    pairs = met.groupBy(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).agg(F.max(F.struct("hub", F.col("id").alias("member"))).alias("p")).select("p.*")
    labels = settled(pairs, labels)
    pool = still_open(pool, labels)
    if not pool.isEmpty():
        pool, rare, pairs = _rare_pairs(pool, own, k, percent, separators)
        known = hubs.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        pairs = pairs.union(_difference_pairs(pool, known, rare, own, k, percent, separators)).distinct()
        # few are left, so all are verified at once
        labels = linked(pruned(pairs), labels)

    by_class = reps.select(*keys, F.col("id").alias("node")).join(labels, "node", "left")
    by_class = by_class.select(*keys, F.coalesce("component", "node").alias("component_id"))
    named = narrow.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(by_class, keys)
    alone = narrow.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key"]
    return named.select(*columns).union(alone.select(*columns))
