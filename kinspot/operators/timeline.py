"""A keyed table at many positions of its log at once.

A row version is valid over an interval of positions, and a position asks for
all rows valid there. Joined directly that is a range join, which compares
every version with every position. Here the asked positions are numbered in
their order, an interval becomes a range of these numbers, and the range is
cut into dyadic pieces: nodes of the binary tree over the numbers, at most two
a level. A position lies in one node a level, so a version and a position meet
in exactly one node if the version is valid there, and in none if not: an
equi-join on (filter, level, node). Versions valid at no asked position have
no pieces. The role a position filters by is part of the key, so rows of other
roles never meet it.

All rows of all positions are as many as both numbers multiplied. Where only
their totals are wanted, the versions of a node are added up before they meet
its positions, so the work grows with versions and positions alone. Names are
numbered in their order for this, as first and last of numbers need no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspot.operators.ordered import DEFAULT_SPAN, running_sum
from kinspot.session import written

#: parts that the versions of one node are dealt to, as a node near the root may hold most of the table
SALTS = 8


def _numbered(positions: DataFrame, versions: DataFrame, span: int) -> tuple[DataFrame, DataFrame, int]:
    """Positions with their number, versions with the numbers ``[low, high)`` they are valid at, and how many numbers there are."""
    asked = positions.select(F.col("position").alias("at")).distinct().select("at", F.lit(0).alias("kind"))
    ends = versions.select(F.explode(F.array("valid_from", "valid_to")).alias("at")).dropna().distinct()
    # a position counts before an end at the same place
    line = asked.unionByName(ends.select("at", F.lit(1).alias("kind")))
    upto = running_sum(line, [], "at", {"n": F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint")}, span, then=["kind"])
    upto = written(upto, "numbered_positions")
    total = upto.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    numbers = upto.where("kind = 0").select(F.col("at").alias("position"), (F.col("n") - 1).alias("number"))
    first = upto.where("kind = 1").select(F.col("at").alias("valid_from"), F.col("n").alias("low"))
    last = upto.where("kind = 1").select(F.col("at").alias("valid_to"), F.col("n").alias("high"))
    placed = versions.join(first, "valid_from").join(last, "valid_to", "left").withColumn("high", F.coalesce("high", F.lit(total)))
    return positions.join(numbers, "position"), placed.where("low < high"), total


def _pieces(low: Column, high: Column, levels: int) -> Column:
    """Nodes (level, node) that make up the range ``[low, high)``."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        left, right = F.floor((low + size - 1) / size), F.floor(high / size)
        some = left < right
        return F.filter(
            F.array(
                F.struct(level.alias("level"), left.alias("node"), (some & (left % 2 == 1)).alias("used")),
                F.struct(level.alias("level"), (right - 1).alias("node"), (some & (right % 2 == 1)).alias("used")),
            ),
            lambda piece: piece["used"],
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def tables_as_of(versions: DataFrame, positions: DataFrame, span: int = DEFAULT_SPAN, totals: bool = False) -> DataFrame:
    """The rows seen from each of ``positions`` (position, role): ``position, asked_role, id, name, role, salary``.

    ``versions`` is the result of ``row_versions``: valid after ``valid_from``
    up to ``valid_to`` (null: still valid). A null or empty role asks for all
    rows. Positions that are asked twice are answered once; one that sees no
    row has none. Null positions see nothing.

    With ``totals`` there is one row for each role seen from a position, in
    place of its rows: ``position, asked_role, role, n_rows, id_total,
    salary_total, first_name, last_name``.
    """
    asked = positions.select(F.col("position").cast("bigint").alias("position"), F.when(F.col("role") != "", F.col("role")).alias("asked_role"))
    asked = written(asked.where("position IS NOT NULL").distinct(), "asked_positions")
    asked, placed, total = _numbered(asked, versions.select("id", "name", "role", "salary", "valid_from", "valid_to"), span)
    levels = max(0, (max(1, total) - 1).bit_length())
    scope = F.coalesce(F.concat(F.lit("="), "asked_role"), F.lit("*"))
    nodes = F.transform(
        F.sequence(F.lit(0), F.lit(levels)),
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("number"), level).alias("node")),
    )
    wanted = asked.select("position", "asked_role", scope.alias("scope"), F.inline(nodes))
    # only filters that some position has
    scopes = asked.select(scope.alias("scope")).distinct()
    row = placed.withColumn("scope", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), "role")))).join(scopes, "scope", "left_semi")
    if totals:
        return _totals(row, wanted, levels, span)
    wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")
    held = row.select("id", "name", "role", "salary", "scope", salt.alias("salt"), F.inline(_pieces(F.col("low"), F.col("high"), levels)))
    met = held.join(wanted, ["scope", "level", "node", "salt"])
    return met.select("position", "asked_role", "id", "name", "role", "salary")


def _totals(row: DataFrame, wanted: DataFrame, levels: int, span: int) -> DataFrame:
    """Totals of the nodes, and of the nodes of each position."""
    names = row.select("name").dropna().distinct()
    names = written(running_sum(names, [], "name", {"number": F.lit(1).cast("bigint")}, span), "numbered_names")
    held = row.join(names, "name", "left").select("id", "role", "salary", "number", "scope", F.inline(_pieces(F.col("low"), F.col("high"), levels)))
    nodes = held.groupBy("scope", "level", "node", "role").agg(
        F.count("*").alias("n_rows"), F.sum("id").alias("id_total"), F.sum("salary").alias("salary_total"),
        F.min("number").alias("first"), F.max("number").alias("last"),
    )
    seen = wanted.join(nodes, ["scope", "level", "node"]).groupBy("position", "asked_role", "role").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("id_total").alias("id_total"), F.sum("salary_total").alias("salary_total"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    for end in ("first", "last"):
        seen = seen.join(names.select(F.col("number").alias(end), F.col("name").alias(f"{end}_name")), end, "left").drop(end)
    return seen.select("position", "asked_role", "role", "n_rows", "id_total", "salary_total", "first_name", "last_name")
