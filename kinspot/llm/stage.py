"""Tables written between the steps of an operator."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinspot.session import written

#: settings while an operator's own table is written: shuffle files go with the plan that made them, and
#: batches of whole texts stay small in the Python workers
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``written`` under ``SETTINGS``; the session gets its own settings back.

    ``batch_rows`` overrides the rows of a batch, for rows that are large blocks.
    """
    conf = df.sparkSession.conf
    settings = SETTINGS | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {})
    before = {key: conf.get(key, None) for key in settings}
    for key, value in settings.items():
        conf.set(key, value)
    try:
        return written(df, name)
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def whole_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, null text as the empty text; other columns do not travel."""
    return df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def give_back() -> None:
    """Return freed memory that Arrow and the C library hold to the system.

    Python workers serve the tasks of all operators, one after the other, and
    what one of them has held at most would stay beside the executor's heap.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that gives freed memory back when it ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
