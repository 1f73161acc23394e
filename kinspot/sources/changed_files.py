"""Functions of a folder of source files, parsed only where files have changed.

A store keeps which files were parsed (path, size, time of change) and the
functions found in each such version of a file. A scan lists the folder
without opening a file, compares the listing with the store, and parses what
is new there. The reader is told the earliest time of change among these, so
that it opens no file that is older. Functions of files that are gone or have
changed are no longer in the result; the store only grows, and a scan that
fails leaves nothing behind that a later one would take for parsed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspot.functions.text import MAX_TOKENS, MIN_TOKENS
from kinspot.session import table_exists, written
from kinspot.sources.code_files import extract_functions

VERSION = ["file_path", "size", "changed"]
FILES = "file_path string, size bigint, changed timestamp, batch string"
FUNCTIONS = "doc_id string, id string, code string, file_path string, function_name string, token_count int, size bigint, changed timestamp, batch string"


def list_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """``file_path, size, changed`` of every matching file below ``root``; no file is opened."""
    return _files(spark, root, pattern).select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def _parsed(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/files"
    if not table_exists(spark, path):
        spark.createDataFrame([], FILES).write.mode("ignore").parquet(path)
    return spark.read.schema(FILES).parquet(path)


def scan_changed_files(
    spark: SparkSession, root: str, store: str, pattern: str = "*.py", low: int = MIN_TOKENS, high: int = MAX_TOKENS
) -> DataFrame:
    """Functions of all files below ``root`` now, as ``extract_functions`` gives them; the ``store`` belongs to this band."""
    now = written(list_files(spark, root, pattern), "listing")
    todo = written(now.join(_parsed(spark, store), VERSION, "left_anti"), "changed_files")
    since = todo.agg(F.min("changed")).first()[0]
    if since is not None:
        batch = uuid.uuid4().hex
        opened = _files(spark, root, pattern).where(F.col("modificationTime") >= F.lit(since))
        opened = opened.select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"), "content")
        content = opened.join(todo, VERSION, "left_semi")
        found = extract_functions(content, low, high).join(todo, "file_path").withColumn("batch", F.lit(batch))
        found.write.mode("append").parquet(f"{store}/functions")
        # after the functions: only now do these files count as parsed
        todo.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{store}/files")
    if not table_exists(spark, f"{store}/functions"):
        return spark.createDataFrame([], FUNCTIONS).drop("size", "changed", "batch")
    # two scans at a time may parse one version twice: one batch of it counts
    counted = _parsed(spark, store).groupBy(*VERSION).agg(F.min("batch").alias("batch")).join(now, VERSION, "left_semi")
    functions = spark.read.schema(FUNCTIONS).parquet(f"{store}/functions")
    return functions.join(counted, [*VERSION, "batch"], "left_semi").drop("size", "changed", "batch")
