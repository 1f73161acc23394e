"""Mixing sources to target weights, by capped water-filling.

Targets: every source gets its weight's share of the words asked for. A source
whose share is above ``epochs`` times its size is clamped there, and what it
leaves is dealt to the others by weight, until none is above. A round is one
aggregate over the table of sources; two numbers go to the driver.

Sampling: a target is some whole repetitions of its source and a fractional
one. The fractional one takes documents in the order of a seeded hash until
its words are reached, the last one up to the very word. Where the order is
cut is found digit by digit, never by sorting a source: words are summed by
the leading digits of the hash, which names the digits that hold the cut, then
by whole hash among these, and, only for rows that are alike, by spread row
numbers. So a source, and even a document repeated in a third of all rows, is
summed before it is shuffled, and no task holds more than a small share of it.

Cases: a null text has no words; documents without words are rows that give
nothing. Null is a source of its own, after all others. A null id draws like
an id without digits. Rows that share id, source and size are alike; which of
them is cut makes no difference to the result. A source without words has the
target 0. No rows give no rows. If all sources are clamped, the mix is smaller
than asked for. With ``epochs`` that are not whole a document is repeated up
to the next whole number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinspot.llm.stage import stored

#: fixed by the contract: words, and the weights of sources in the order of their names
WORD = r"[^\x20\x09-\x0D]+"
BLANK_AND_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: sources numbered in one task
SPAN = 100_000
#: groups that rows which are alike are spread over
SPREAD = 65_536


def numbered(docs: DataFrame, seed: int, *keep: str) -> DataFrame:
    """The rows of ``docs`` with what the order of sampling needs, and a number of their own, in a written table."""
    number = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    draw = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), number), 256), 1, 16)
    return stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *keep,
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        draw.alias("draw"), F.monotonically_increasing_id().alias("row")), "numbered-documents")


def _spread() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(SPREAD))


def _levels() -> list[tuple[str, Column]]:
    """Keys by which the order is refined: one after another they order all rows."""
    return [("head", F.substring("draw", 1, 4)), ("whole", F.struct("draw", "size")), ("spread", _spread()), ("last", F.col("row"))]


def _place() -> Column:
    return F.struct(*(key.alias(name) for name, key in _levels()))


def source_weights(rows: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``source``, ``source_size`` and ``weight``: the weights repeat over the sources in the order of their names."""
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    spans = max(1, -(-sums.count() // SPAN))
    by_name = F.asc_nulls_last("source")
    ranged = sums.repartitionByRange(spans, by_name).sortWithinPartitions(by_name)
    placed = stored(ranged.select("source", "source_size", F.spark_partition_id().alias("span"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "placed-sources")
    counts = placed.groupBy("span").agg(F.count("*").alias("held"))  # one row for each SPAN sources
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("span", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    place = F.pmod(F.col("offset") + F.col("at"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)
    return stored(placed.join(offsets, "span").select("source", "source_size", weight.alias("weight")), "weighted-sources")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """``sources`` with their ``target`` words; together they make ``share`` of all words if the caps allow it."""
    totals = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    asked, rest, weight = totals[0] * share, totals[0] * share, totals[1]
    cap = F.col("source_size") * F.lit(float(epochs))
    while weight > 0:
        even = F.lit(rest) * F.col("weight") / F.lit(weight)
        clamped = cap < even
        spent, left = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0))).first()
        if left == weight or left == 0:
            return sources.withColumn("target", F.when(clamped, cap).otherwise(even))
        rest, weight = asked - spent, left
    return sources.withColumn("target", F.lit(0.0))


@dataclass(frozen=True)
class Mix:
    """How much of each source is taken.

    ``targets``: source, source_size, weight, target, repeats (whole ones) and
    ``extra`` (words of the fractional one). ``cuts``: source, place of the
    last document of the fractional repetition in the order of sampling, and
    the words taken of it.
    """

    targets: DataFrame
    cuts: DataFrame


def plan_mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: float = 2) -> Mix:
    """Targets of the sources of ``rows`` (as ``numbered`` gives them) and where their fractional repetitions end."""
    targets = water_fill(source_weights(rows, weights), share, epochs)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("repeats", repeats)
    targets = stored(targets.withColumn("extra", F.round("target").cast("long") - F.col("repeats") * F.col("source_size")), "targets")
    cuts, keys = targets.filter("extra > 0").select("source", F.col("extra").alias("left")), []
    some = rows.filter("size > 0")
    for name, key in _levels():
        keyed = some.select("source", "size", *(k.alias(n) for n, k in _levels()[: len(keys) + 1]))
        same = keyed["source"].eqNullSafe(cuts["source"])
        for known in keys:
            same &= keyed[known] == cuts[known]
        held = keyed.join(cuts, same).select(cuts["source"], *(cuts[k] for k in keys), "left", keyed[name], "size")
        sums = held.groupBy("source", *keys, "left", name).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        found = found.filter("before < `left` AND upto >= `left`").select("source", *keys, name, (F.col("left") - F.col("before")).alias("left"))
        cuts, keys = stored(found, f"cuts-{name}"), [*keys, name]
    return Mix(targets, cuts.select("source", F.struct(*keys).alias("place"), "left"))


def taken(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, ``repeats`` and ``part``: the words of the fractional repetition."""
    goal = mix.targets.select(F.col("source").alias("of"), "source_size", "target", "repeats")
    ends = mix.cuts.select(F.col("source").alias("cut_of"), F.col("place").alias("end"), F.col("left").alias("left"))
    both = rows.join(goal, rows["source"].eqNullSafe(goal["of"]))
    # "end" is null where a source has no fractional repetition, also where the source itself is null
    both = both.join(ends, both["source"].eqNullSafe(ends["cut_of"]), "left")
    part = F.when(_place() < F.col("end"), F.col("size")).when(_place() == F.col("end"), F.col("left")).otherwise(0).cast("long")
    return both.withColumn("part", part).drop("of", "cut_of", "end", "left")


def mix_report(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: float = 2, seed: int = 7) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    rows = numbered(docs, seed)
    words = (F.col("repeats") * F.col("size") + F.col("part")).alias("taken")
    return taken(rows, plan_mix(rows, weights, share, epochs)).select("doc_id", "size", "source_size", "target", words, "source")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: float = 2, seed: int = 7) -> DataFrame:
    """The mix itself: doc_id, source, repetition (from 1), words and text, a row for each repetition with words.

    The text of a whole repetition is the document's; of a part, its beginning up to the last word taken.
    """
    rows = numbered(docs, seed, "text")
    both = taken(rows, plan_mix(rows, weights, share, epochs))
    whole = F.transform(F.sequence(F.lit(1), F.col("repeats")), lambda i: F.struct(i.alias("repetition"), F.col("size").alias("words")))
    whole = F.when(F.col("repeats") > 0, whole).otherwise(F.array().cast("array<struct<repetition:bigint,words:bigint>>"))
    part = F.array(F.struct((F.col("repeats") + 1).alias("repetition"), F.col("part").alias("words")))
    each = F.filter(F.concat(whole, part), lambda x: x["words"] > 0)
    spread = both.select("doc_id", "source", "size", "text", F.explode(each).alias("one"))
    words = F.col("one.words")
    begin = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(BLANK_AND_WORD), F.lit(0)), F.lit(1), words.cast("int")), "")
    return spread.select("doc_id", "source", F.col("one.repetition").alias("repetition"), words.alias("words"), F.when(words < F.col("size"), begin).otherwise(F.col("text")).alias("text"))
