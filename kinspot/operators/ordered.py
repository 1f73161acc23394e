"""Ordered running state that stays parallel when one key holds most rows.

A window partitioned by key alone puts a hot key into a single task. Here the
rows are range partitioned by the order column into spans of about ``span``
rows, however sparse its values are, and written once; each (key, span) is
summarised with a map-side combined aggregate, the short summaries are scanned
per key, and the state at the start of each span is joined back. Rows are only
ever grouped by (key, span), and a key has one summary for each ``span`` rows
of the whole table at most. Rows of equal order stay in one span.

Several steps over the same rows share their spans: what :func:`spanned` gives
may be filtered and widened, and goes through any number of steps without
being written or range partitioned again.

Rows of equal order stand in the order of the columns ``then``, after that by
a hash of all their columns, so that a rerun finds the same order; only rows
that agree in all columns may change places. A null order comes first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from kinspot.session import written

#: rows of a span, about
DEFAULT_SPAN = 100_000
#: number of the span, and place in the order
SPAN, PLACE = "_span", "_place"


def _can_be_hashed(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_can_be_hashed(f.dataType) for f in kind.fields)
    return _can_be_hashed(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def spanned(df: DataFrame, order: str, span: int = DEFAULT_SPAN, then: Sequence[str] = ()) -> DataFrame:
    """Rows with the number of their span and their place in the order, in a written table.

    ``df`` is read up to three times: to count, to find the ranges, and to
    write. What is dear to compute should be a written table already.
    """
    n = max(1, -(-df.count() // span))
    hashed = F.xxhash64(*[f.name for f in df.schema.fields if _can_be_hashed(f.dataType)])
    ranged = df.repartitionByRange(n, order).withColumn(SPAN, F.spark_partition_id())
    return written(ranged.withColumn(PLACE, F.struct(order, *then, hashed.alias("_hash"))), "spans")


def _spans_of(df: DataFrame, order: str, span: int, then: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows with spans, and the columns of the result."""
    return (df if SPAN in df.columns else spanned(df, order, span, then)), df.columns


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    span: int = DEFAULT_SPAN,
    then: Sequence[str] = (),
    backwards: bool = False,
) -> DataFrame:
    """Add, per output name, the last non-null value of earlier rows of the key.

    ``backwards`` gives the next value of later rows.
    """
    keys = list(keys)
    rows, columns = _spans_of(df, order, span, then)
    rows = rows.select("*", *[value.alias(f"_v_{out}") for out, value in values.items()])
    ends, turn = (F.min_by, F.desc) if backwards else (F.max_by, F.asc)
    summary = rows.groupBy(*keys, SPAN).agg(
        *[ends(f"_v_{out}", F.when(F.col(f"_v_{out}").isNotNull(), F.col(PLACE))).alias(f"_s_{out}") for out in values]
    )
    over_spans = Window.partitionBy(*keys).orderBy(turn(SPAN)).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        SPAN,
        *[F.last(f"_s_{out}", ignorenulls=True).over(over_spans).alias(f"_c_{out}") for out in values],
    )
    inside = Window.partitionBy(*keys, SPAN).orderBy(turn(PLACE)).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, [*keys, SPAN])
    return joined.select(
        *columns,
        *[
            F.coalesce(F.last(f"_v_{out}", ignorenulls=True).over(inside), F.col(f"_c_{out}")).alias(out)
            for out in values
        ],
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Mapping[str, Column],
    span: int = DEFAULT_SPAN,
    then: Sequence[str] = (),
) -> DataFrame:
    """Add running sums up to and including the row, per key (or over all rows)."""
    keys = list(keys)
    rows, columns = _spans_of(df, order, span, then)
    rows = rows.select("*", *[F.coalesce(value, F.lit(0)).alias(f"_v_{out}") for out, value in values.items()])
    summary = rows.groupBy(*keys, SPAN).agg(*[F.sum(f"_v_{out}").alias(f"_s_{out}") for out in values])
    over_spans = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        SPAN,
        *[F.coalesce(F.sum(f"_s_{out}").over(over_spans), F.lit(0)).alias(f"_c_{out}") for out in values],
    )
    inside = Window.partitionBy(*keys, SPAN).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, [*keys, SPAN]).select(
        *columns,
        *[(F.sum(f"_v_{out}").over(inside) + F.col(f"_c_{out}")).alias(out) for out in values],
    )
