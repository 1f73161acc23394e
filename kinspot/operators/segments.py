"""BM25 over a corpus that grows: segments of block postings, exact top-k by block bounds.

**Segments.** Every batch of documents is written as a segment of its own and
never changed. A batch that brings new texts for known ids, or names ids to
remove, leaves marks: which documents of which segments are gone, and how many
documents each of their terms has lost. All statistics are sums (documents,
tokens, document frequencies), so those of the whole corpus are the segments'
less the marks'. A batch tokenises its own texts only; of the older segments
it reads the list of ids and, where documents go, the lanes of the forward
table that hold them. ``merge_segments`` writes several segments as one,
without the documents that are gone and without reading a text.

**Blocks.** Documents of a segment are dealt to regions of similar length,
about ``REGION_DOCS`` in each. The postings of a term in a region are one row,
a block, so a term that is in every document is many rows. Blocks lie in lanes
(folders) by a hash of the term, sorted by term: a query reads the lanes of its
terms, and of few terms only the row groups that hold them.

**Bounds.** BM25's saturation ``tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))``
grows with ``tf`` and falls with ``dl / tf``. A block keeps its largest
``tf`` and smallest ``dl / tf``, which bound its saturations at whatever mean
length the corpus has by the time it is asked. A query's terms add up to a
bound for each region; the regions of the highest bounds are scored first and
give the k-th best score, and then only regions whose bound reaches it. Every
block is read for one of the two, and the result is the exact top k.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from kinspot.functions.text import token_batches, tokenised, tokenize
from kinspot.functions.vectors import SCORE_DIGITS
from kinspot.operators.sparse import B, EPSILON, K1, SLACK
from kinspot.operators.topk import top_k
from kinspot.session import table_exists, written

#: documents of a region, about
REGION_DOCS = 1024
#: rows that one lane, and one task that writes lanes, should hold
LANE_DOCS, LANE_POSTINGS, TASK_POSTINGS = 50_000, 100_000, 1_000_000
#: bytes of a text for each of its postings, at least, about
POSTING_BYTES = 4
#: tokens of a region, about: fewer than ``REGION_DOCS`` documents where these are long
REGION_TOKENS = 4_000_000
#: lanes of a segment, at most; lanes are a power of two
MOST_LANES = 4096
#: bytes of a row group, small enough that a term's blocks fill several
ROW_GROUP = 4 << 20
#: regions of each query that are scored for its threshold
PROBE_REGIONS = 4
#: queries whose terms meet the blocks of a region in one task, about
SLOT_QUERIES = 1024
#: terms that are named to the reader, so that it can skip row groups
NAMED_TERMS = 64


@dataclass(frozen=True)
class Segment:
    name: str
    docs: int
    tokens: int
    doc_lanes: int
    term_lanes: int
    parts: tuple[tuple[int, int], ...] = ()  # regions of each band of lengths; counted again where an older index lacks them


@dataclass(frozen=True)
class SegmentedIndex:
    """State of an index at ``path``: its segments, the marks on them, and sums over the corpus."""

    path: str
    id_type: str
    version: int = 0
    segments: tuple[Segment, ...] = ()
    marks: tuple[str, ...] = ()
    n: int = 0
    tokens: int = 0
    n_terms: int = 0
    avg_idf: float | None = None
    spark: SparkSession = field(default=None, compare=False, repr=False)

    @property
    def avgdl(self) -> float | None:
        return self.tokens / self.n if self.n else None

    # --- tables ---------------------------------------------------------------

    def _table(self, segment: Segment, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/segments/{segment.name}/{name}")

    def _union(self, name: str, schema: str, lanes: dict[str, list[int]] | None = None) -> DataFrame:
        """A table of all segments with the name of the ``segment``; of ``lanes`` only, where given."""
        parts = []
        for s in self.segments:
            part = self._table(s, name, schema).withColumn("segment", F.lit(s.name))
            parts.append(part if lanes is None else part.where(F.col("lane").isin(lanes.get(s.name, []))))
        if not parts:
            return _none(self.spark, f"{schema}, segment string")
        return reduce(DataFrame.unionByName, parts)

    def _marked(self, name: str, schema: str) -> DataFrame:
        """Marks on the segments of now; those of segments that were merged are past."""
        if not self.marks:
            return _none(self.spark, schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/marks/{m}/{name}" for m in self.marks])
        return rows.where(F.col("segment").isin([s.name for s in self.segments]))

    def gone(self) -> DataFrame:
        """``segment, doc_id, dl`` of documents that were removed or have a newer text."""
        return self._marked("gone", f"segment string, doc_id {self.id_type}, dl int")

    def lost(self) -> DataFrame:
        """``segment, term, df``: documents that a term of a segment has lost."""
        return self._marked("lost", "segment string, term string, df bigint")

    def alive(self, rows: DataFrame) -> DataFrame:
        """``rows`` (segment, doc_id, ...) without documents that are gone."""
        return rows.join(self.gone().select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")

    def documents(self) -> DataFrame:
        """``doc_id, dl, segment`` of the documents of now."""
        return self.alive(self._union("docs", f"doc_id {self.id_type}, dl int"))

    def beside(self, name: str, schema: str) -> DataFrame:
        """Rows of a table beside the segments, of the documents of now."""
        return self.alive(self._union(name, schema))

    def forward(self, lanes: dict[str, list[int]] | None = None) -> DataFrame:
        """``doc_id, dl, terms, tfs, lane, segment``, documents that are gone included."""
        return self._union("forward", _forward_schema(self.id_type), lanes)

    def blocks(self, lanes: dict[str, list[int]] | None = None) -> DataFrame:
        return self._union("blocks", _block_schema(self.id_type), lanes)

    def term_stats(self) -> DataFrame:
        """``term, df, idf`` of the corpus of now."""
        held = self._union("terms", "term string, df bigint").select("term", "df")
        df = held.unionByName(self.lost().select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        return df.where("df > 0").withColumn("idf", _floored(_raw_idf(self.n), self.avg_idf))


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows; ``createDataFrame`` would start Python tasks for them."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in DataType.fromDDL(schema).fields])


def _forward_schema(id_type: str) -> str:
    return f"doc_id {id_type}, dl int, terms array<string>, tfs array<bigint>, lane int"


def _block_schema(id_type: str) -> str:
    posting = f"struct<doc_id:{id_type},tf:bigint,dl:int>"
    return f"term string, region bigint, n bigint, max_tf bigint, least_ratio double, postings array<{posting}>, lane int"


def _raw_idf(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _floored(idf: Column, avg_idf: float | None) -> Column:
    return F.when(idf < 0, F.lit(EPSILON * (avg_idf or 0.0))).otherwise(idf)


def _lanes(rows: int, each: int) -> int:
    return min(MOST_LANES, 1 << max(0, math.ceil(math.log2(max(1, rows / each)))))


def _lane(key: str, lanes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


# --- building ---------------------------------------------------------------------


def document_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, dl, terms, tfs``: the distinct terms of each document and how often it holds them."""
    texts = tokenised(docs, text_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lambda batches: _nest(token_batches(batches)), f"doc_id {id_type}, dl int, terms array<string>, tfs array<bigint>")


def _nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False)
        coded = batch.column("tokens").flatten().dictionary_encode()
        n_terms = max(1, len(coded.dictionary))
        owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), lengths)
        pairs, tf = np.unique(owner * n_terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        offsets = pa.array(np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) * n_terms).astype(np.int32))
        terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(pairs % n_terms)))
        tfs = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int32()), terms, tfs], names=["doc_id", "dl", "terms", "tfs"])


def _band() -> Column:
    return F.floor(2 * F.log2(F.greatest("dl", F.lit(1)))).cast("bigint")


def _region_parts(docs: DataFrame, most_tokens: int | None = None) -> dict[int, int]:
    """Bands of similar length, half powers of two, and the number of parts of about equal size that each is cut into."""
    counts = docs.groupBy(_band().alias("band")).agg(F.count("*").alias("n"), F.sum("dl").alias("tokens")).collect()  # at most 64
    return {r["band"]: max(1, round(r["n"] / REGION_DOCS), -(-r["tokens"] // most_tokens) if most_tokens else 1) for r in counts}


def _region(parts: dict[int, int]) -> Column:
    """The band of a document, and its part by a hash."""
    part = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[_band()] if parts else F.lit(None)
    return _band() * F.lit(1 << 32) + F.pmod(F.xxhash64("doc_id"), F.coalesce(part, F.lit(1)))


def _region_blocks(docs: pa.Table) -> pa.Table:
    """Blocks of one region from its documents (region, doc_id, dl, terms, tfs)."""
    lists = docs["terms"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(docs.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[order]
    tf, dl = docs["tfs"].combine_chunks().flatten().to_numpy()[order], docs["dl"].to_numpy()[owner]
    n = np.bincount(code, minlength=len(coded.dictionary))
    ends = np.cumsum(n)
    at = ends - n
    cuts = pa.array(np.append(0, ends), pa.int32())
    posting = {"doc_id": docs["doc_id"].combine_chunks().take(pa.array(owner)), "tf": pa.array(tf), "dl": pa.array(dl)}
    return pa.table(
        {
            "term": coded.dictionary, "region": pa.array(np.full(len(n), docs["region"][0].as_py(), np.int64)), "n": pa.array(n, pa.int64()),
            "max_tf": np.maximum.reduceat(tf, at) if len(n) else tf, "least_ratio": np.minimum.reduceat(dl / tf, at) if len(n) else np.zeros(0),
            **{name: pa.ListArray.from_arrays(cuts, values) for name, values in posting.items()},
        }
    )


def _dealt(rows: DataFrame, tasks: int, lanes: int, share: Column | None = None) -> DataFrame:
    """``rows`` with a ``lane`` in ``tasks`` tasks, about: neighbouring lanes in one task, or shares of a lane in several."""
    if tasks <= lanes:
        return rows.repartitionById(tasks, F.floor(F.col("lane") * F.lit(tasks) / F.lit(lanes)).cast("int"))
    shares = -(-tasks // lanes)
    return rows.repartitionById(lanes * shares, F.col("lane") * F.lit(shares) + F.pmod(share, F.lit(shares)).cast("int"))


def _write_segment(spark: SparkSession, path: str, docs: DataFrame, n: int, about: int, nest: Callable[[DataFrame], DataFrame]) -> Segment:
    """Tables of one segment from ``docs``, ``n`` rows of a ``doc_id`` each and ``about`` so many postings.

    ``nest`` makes ``doc_id, dl, terms, tfs`` of them; what is moved before are ``docs``, so texts and not their terms.
    """
    name = f"segment-{uuid.uuid4().hex}"
    root = f"{path}/segments/{name}"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    doc_lanes, lane = _lanes(n, LANE_DOCS), lambda: _lane("doc_id", doc_lanes)
    held = _dealt(docs.withColumn("lane", lane()), max(1, -(-about // TASK_POSTINGS), -(-n // LANE_DOCS)), doc_lanes, F.hash("doc_id"))
    nested = nest(held.drop("lane")).withColumns({"n_terms": F.size("terms"), "lane": lane()})
    nested.write.partitionBy("lane").parquet(f"{root}/forward")
    forward = spark.read.schema(f"{_forward_schema(id_type)}, n_terms int").parquet(f"{root}/forward")
    tokens, postings = forward.agg(F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    term_lanes, tasks = _lanes(postings, LANE_POSTINGS), max(1, -(-postings // TASK_POSTINGS))
    lengths = written(forward.select("doc_id", "dl"), "docs", f"{root}/docs")

    parts = _region_parts(lengths, REGION_TOKENS)
    # whole documents meet by region, where their postings become blocks; no posting is a row
    regions = forward.select(_region(parts).alias("region"), "doc_id", "dl", "terms", "tfs").repartition(tasks, "region")
    kinds = f"term string, region bigint, n bigint, max_tf bigint, least_ratio double, doc_id array<{id_type}>, tf array<bigint>, dl array<int>"
    blocks = regions.groupBy("region").applyInArrow(_region_blocks, kinds).withColumn("lane", _lane("term", term_lanes))
    # a term of every document may fill several tasks; postings are flat arrays on the way, a third of the bytes
    blocks = _dealt(blocks, tasks, term_lanes, F.col("region")).sortWithinPartitions("lane", "term", "region")
    blocks = blocks.select("term", "region", "n", "max_tf", "least_ratio", F.arrays_zip("doc_id", "tf", "dl").alias("postings"), "lane")
    blocks.write.option("parquet.block.size", ROW_GROUP).partitionBy("lane").parquet(f"{root}/blocks")
    sizes = spark.read.schema(_block_schema(id_type)).parquet(f"{root}/blocks") if postings else _none(spark, _block_schema(id_type))
    written(sizes.groupBy("term").agg(F.sum("n").alias("df")), "terms", f"{root}/terms")
    return Segment(name, n, tokens, doc_lanes, term_lanes, tuple(parts.items()))


def _commit(index: SegmentedIndex) -> SegmentedIndex:
    """``index`` as the next version, with its sums; of two writers that started from one version the second fails."""
    lost = index.gone().agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    index = replace(
        index, version=index.version + 1,
        n=sum(s.docs for s in index.segments) - lost[0], tokens=sum(s.tokens for s in index.segments) - lost[1],
    )
    n_terms, avg_idf = index.term_stats().agg(F.count("*"), F.avg(_raw_idf(index.n))).first()
    index = replace(index, n_terms=n_terms, avg_idf=avg_idf)
    state = {k: v for k, v in asdict(replace(index, spark=None)).items() if k not in ("path", "spark")}
    row = index.spark.range(1).coalesce(1).select(F.lit(index.version).cast("bigint").alias("version"), F.lit(json.dumps(state)).alias("state"))
    row.write.mode("errorifexists").parquet(f"{index.path}/manifest/version-{index.version}")
    return index


def load_segments(spark: SparkSession, path: str) -> SegmentedIndex:
    """The last version of the index at ``path``."""
    rows = spark.read.schema("version bigint, state string").parquet(f"{path}/manifest/*")
    state = json.loads(rows.agg(F.max_by("state", "version")).first()[0])
    segments = tuple(Segment(**s | {"parts": tuple(map(tuple, s.get("parts", ())))}) for s in state.pop("segments"))
    return SegmentedIndex(path=path, spark=spark, segments=segments, marks=tuple(state.pop("marks")), **state)


def _started(spark: SparkSession, path: str, id_type: str) -> SegmentedIndex:
    if table_exists(spark, f"{path}/manifest"):
        return load_segments(spark, path)
    return SegmentedIndex(path=path, id_type=id_type, spark=spark)


def add_documents(
    docs: DataFrame, path: str, removed: DataFrame | None = None, text_col: str = "text",
    beside: Mapping[str, DataFrame | Callable[[DataFrame], DataFrame]] | None = None,
) -> SegmentedIndex:
    """Add a batch ``(doc_id, text)`` to the index at ``path``, which is made if there is none.

    Ids must be unique in a batch and not null. A known id gets the new text;
    ids of ``removed`` (doc_id) go, unless the batch brings them. Tables
    ``beside`` (by name, with a ``doc_id``) become part of the segment; a
    function makes one from :func:`document_terms` of the batch.
    """
    spark = docs.sparkSession
    index = _started(spark, path, docs.schema["doc_id"].dataType.simpleString())
    each = docs.groupBy("doc_id").agg(F.count("*").alias("count"), F.sum(F.octet_length(text_col)).alias("size"))
    n, size, wrong = each.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.expr("count > 1 OR doc_id IS NULL"))).first()
    if wrong:
        raise ValueError("doc_id is not unique or null")
    ids = docs.select("doc_id")
    if removed is not None:
        ids = ids.unionByName(removed.select(F.col("doc_id").cast(index.id_type).alias("doc_id"))).distinct()
    marks = _mark(index, ids)
    texts = docs.select("doc_id", F.col(text_col).alias("text"))
    segment = _write_segment(spark, path, texts, n, size // POSTING_BYTES, document_terms)
    terms = index._table(segment, "forward", _forward_schema(index.id_type)).drop("lane")
    for name, table in (beside or {}).items():
        written(table(terms) if callable(table) else table, name, f"{path}/segments/{segment.name}/{name}")
    return _commit(replace(index, segments=(*index.segments, segment), marks=(*index.marks, *marks)))


def _mark(index: SegmentedIndex, ids: DataFrame) -> list[str]:
    """Write which documents of ``index`` the ``ids`` name, and what their terms lose; the name of these marks."""
    if not index.segments:
        return []
    name = f"marks-{uuid.uuid4().hex}"
    gone = written(index.documents().join(ids, "doc_id", "left_semi").select("segment", "doc_id", "dl"), "gone", f"{index.path}/marks/{name}/gone")
    lanes = {s.name: _lane("doc_id", s.doc_lanes) for s in index.segments}
    lane = reduce(lambda c, s: c.when(F.col("segment") == s, lanes[s]), lanes, F)
    touched: dict[str, list[int]] = {}
    for r in gone.select("segment", lane.alias("lane")).distinct().collect():  # numbers of lanes
        touched.setdefault(r["segment"], []).append(r["lane"])
    old = index.forward(touched).join(gone.select("segment", "doc_id"), ["segment", "doc_id"], "left_semi")
    lost = old.select("segment", F.explode("terms").alias("term")).groupBy("segment", "term").agg(F.count("*").alias("df"))
    written(lost, "lost", f"{index.path}/marks/{name}/lost")
    return [name]


def merge_segments(spark: SparkSession, path: str, names: list[str] | None = None, beside: Mapping[str, str] | None = None) -> SegmentedIndex:
    """Write the segments ``names`` (all) as one, without documents that are gone.

    ``beside`` names the tables that were added beside the segments, with their schemas.
    """
    index = load_segments(spark, path)
    chosen = replace(index, segments=tuple(s for s in index.segments if names is None or s.name in names))
    kept = tuple(s for s in index.segments if s not in chosen.segments)
    nested = chosen.alive(chosen.forward()).select("doc_id", "dl", "terms", "tfs")
    n, tokens = chosen.documents().agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    segment = _write_segment(spark, path, nested, n, tokens, lambda rows: rows)
    for name, schema in (beside or {}).items():
        written(chosen.beside(name, schema).drop("segment"), name, f"{path}/segments/{segment.name}/{name}")
    return _commit(replace(index, segments=(*kept, segment), marks=index.marks if kept else ()))


def small_segments(index: SegmentedIndex, most: int = 8) -> list[str]:
    """Names of the segments to merge so that at most ``most`` are left: the smallest ones."""
    by_size = sorted(index.segments, key=lambda s: (s.docs, s.name))
    extra = len(by_size) - most
    return [s.name for s in by_size[: extra + 1]] if extra > 0 else []


# --- searching --------------------------------------------------------------------


def _saturation(tf: Column, ratio: Column, avgdl: float) -> Column:
    """BM25's saturation by ``tf`` and ``dl / tf``."""
    return (K1 + 1) / (1 + K1 * (1 - B) / tf + K1 * B / avgdl * ratio)


def _blocks_of(index: SegmentedIndex, terms: DataFrame) -> DataFrame:
    """Blocks of the lanes that hold ``terms``; few terms are named to the reader."""
    widest = max((s.term_lanes for s in index.segments), default=1)
    hashes = [r[0] for r in terms.select(_lane("term", widest)).distinct().collect()]  # at most MOST_LANES
    blocks = index.blocks({s.name: sorted({h % s.term_lanes for h in hashes}) for s in index.segments})
    few = terms.limit(NAMED_TERMS + 1).collect()
    if 0 < len(few) <= NAMED_TERMS:
        blocks = blocks.where(reduce(lambda a, b: a | b, (F.col("term") == r["term"] for r in few)))
    return blocks


def segmented_topk(index: SegmentedIndex, queries: DataFrame, k: int = 10, probe_regions: int = PROBE_REGIONS) -> DataFrame:
    """Exact BM25 top-k per query ``(query_id, text)``: ``query_id, doc_id, score, rank``.

    Queries without a known term have no rows; null texts are empty.
    """
    counted = queries.select("query_id", F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("term"))
    asked = written(counted.groupBy("query_id", "term").agg(F.count("*").alias("qtf")), "query_terms")
    terms = asked.select("term").distinct()
    if not index.n:
        return top_k(asked.select("query_id", F.lit(None).cast(index.id_type).alias("doc_id"), F.lit(0.0).alias("score")).limit(0), k)
    blocks = _blocks_of(index, terms)
    about = blocks.select("segment", "term", "region", "n", _saturation(F.col("max_tf"), F.col("least_ratio"), index.avgdl).alias("bound"))
    about = written(about.join(terms, "term"), "block_bounds")

    lost = index.lost().join(terms, "term", "left_semi").select("term", (-F.col("df")).alias("n"))
    df = about.select("term", "n").unionByName(lost).groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
    weight = F.col("qtf") * _floored(_raw_idf(index.n), index.avg_idf)
    weighted = written(asked.join(df, "term").select("query_id", "term", weight.alias("weight")), "weighted_terms")

    reach = F.sum(F.greatest(F.col("weight") * F.col("bound"), F.lit(0.0)))
    regions = weighted.join(about, "term").groupBy("query_id", "segment", "region").agg(reach.alias("reach"))
    regions = written(regions, "region_bounds")
    wanted = Wanted(k, regions.agg(F.count_distinct("query_id")).first()[0])
    by_reach = top_k(regions.withColumn("doc_id", F.struct("segment", "region")), probe_regions, "reach")
    probed = written(by_reach.select("query_id", "segment", "region"), "probed_regions")
    first = written(_region_scores(index, blocks, weighted, wanted, probed), "probe_scores")
    least = top_k(first, k).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") >= k)

    key = ["query_id", "segment", "region"]
    left = regions.join(probed, key, "left_anti").join(least, "query_id", "left")
    left = written(left.where(F.col("least").isNull() | (F.col("reach") >= F.col("least") - SLACK)).select(*key), "regions_in_reach")
    return top_k(first.unionByName(_region_scores(index, blocks, weighted, wanted, left)), k)


class Wanted(NamedTuple):
    """Number of hits of a query, and of queries."""

    k: int
    queries: int


def _regions_of_gone(index: SegmentedIndex) -> DataFrame:
    """``segment, region, doc_id`` of documents that are gone."""
    gone, region = index.gone(), F
    for s in index.segments:
        parts = dict(s.parts) or _region_parts(index._table(s, "docs", f"doc_id {index.id_type}, dl int"))
        region = region.when(F.col("segment") == s.name, _region(parts))
    return gone.select("segment", region.alias("region"), "doc_id")


def _region_scores(index: SegmentedIndex, blocks: DataFrame, weighted: DataFrame, wanted: Wanted, regions: DataFrame) -> DataFrame:
    """Whole scores of the best ``wanted.k`` documents, and their equals, in each of the given regions ``(query_id, segment, region)``.

    Blocks and queries meet by region, ``SLOT_QUERIES`` queries at a time, and
    are added up there: what leaves a task is k rows for a query and region.
    """
    key = ["segment", "region", "slot"]
    slot = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-wanted.queries // SLOT_QUERIES)))).cast("int")
    met = regions.withColumn("slot", slot)
    held = [F.col(f"postings.{name}").alias(name) for name in ("doc_id", "tf", "dl")]  # flat arrays are a third of the bytes
    here = blocks.join(weighted.select("term").distinct(), "term", "left_semi").select("segment", "region", "term", *held)
    here = here.join(met.select(*key).distinct(), ["segment", "region"])
    asked = met.join(weighted, "query_id").withColumn("gone", F.lit(None).cast(index.id_type))
    if index.marks:
        gone = _regions_of_gone(index).join(met.select(*key).distinct(), ["segment", "region"]).withColumnRenamed("doc_id", "gone")
        asked = asked.unionByName(gone, allowMissingColumns=True)
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # both sides come from the same regions
    kind = weighted.schema["query_id"].dataType.simpleString()
    scores = here.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        _score_region(index.avgdl, wanted.k), f"query_id {kind}, doc_id {index.id_type}, score double"
    )
    return scores.withColumn("score", F.round("score", SCORE_DIGITS))


def _score_region(avgdl: float, k: int):
    """Scores of one region from its blocks (term, doc_id, tf, dl) and rows (query_id, term, weight) or (gone)."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        ids, documents, scores = [], [], []
        wanted = asked.filter(pc.is_valid(asked["term"])).combine_chunks()
        at = pc.index_in(wanted["term"], value_set=blocks["term"].combine_chunks())
        wanted, at = wanted.filter(pc.is_valid(at)), at.drop_null().to_numpy()
        if wanted.num_rows:
            lists = {name: blocks[name].combine_chunks() for name in ("doc_id", "tf", "dl")}
            tf, dl = (lists[name].flatten().to_numpy(zero_copy_only=False) for name in ("tf", "dl"))
            saturation = (K1 + 1) / (1 + K1 * (1 - B) / tf + K1 * B / avgdl * (dl / tf))
            coded = lists["doc_id"].flatten().dictionary_encode()
            code, n = coded.indices.to_numpy(), len(coded.dictionary)
            alive = ~pc.is_in(coded.dictionary, value_set=asked["gone"].drop_null().combine_chunks()).to_numpy(zero_copy_only=False)
            lengths = lists["doc_id"].value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            queries = wanted["query_id"].combine_chunks().dictionary_encode()
            order = np.argsort(queries.indices.to_numpy(), kind="stable")
            cuts = np.searchsorted(queries.indices.to_numpy()[order], np.arange(len(queries.dictionary) + 1))
            weights = wanted["weight"].to_numpy()
            for query in range(len(queries.dictionary)):
                rows = order[cuts[query] : cuts[query + 1]]
                size = lengths[at[rows]]
                posting = np.repeat(starts[at[rows]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                total = np.bincount(code[posting], np.repeat(weights[rows], size) * saturation[posting], n)
                found = np.flatnonzero((np.bincount(code[posting], minlength=n) > 0) & alive)
                if len(found) > k:
                    found = found[total[found] >= np.partition(total[found], len(found) - k)[len(found) - k] - SLACK]
                ids.append(np.full(len(found), query))
                documents.append(found)
                scores.append(total[found])
        if not ids:
            return pa.table({"query_id": asked["query_id"].slice(0, 0), "doc_id": asked["gone"].slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.table(
            {
                "query_id": queries.dictionary.take(pa.array(np.concatenate(ids))),
                "doc_id": coded.dictionary.take(pa.array(np.concatenate(documents))), "score": np.concatenate(scores),
            }
        )

    return run
