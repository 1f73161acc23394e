"""Source files, and the functions defined in them."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspot.functions.text import MAX_TOKENS, MIN_TOKENS, path_tail
from kinspot.operators.corpus import token_band

_FUNCTIONS = "file_path string, function_name string, line int, code string"


LINE_END = re.compile(r"\r\n|\r|\n")
#: fields of statements that hold statements, or what holds these, in the order of ast.walk
BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def scan_files(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """Every matching file below ``root``: ``file_path, content`` (binary)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(F.col("path").alias("file_path"), "content")
    )


def defined_functions(content: bytes | str) -> list[tuple[str, int, str]]:
    """(name, line, source) of each plain function in one file; none if it does not parse."""
    text = content if isinstance(content, str) else bytes(content).decode("utf-8", errors="ignore")
    try:
        tree, lines = ast.parse(text), LINE_END.split(text)  # the lines that the parser counts
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found, level = [], [tree]
    while level:  # as ast.walk goes, but functions stand in statements only, so no expression is entered
        level = [child for node in level for name in BLOCKS for child in getattr(node, name, ())]
        found += [node for node in level if isinstance(node, ast.FunctionDef)]
    return [(f.name, f.lineno, "\n".join(lines[f.lineno - 1 : f.end_lineno])) for f in found]


def extract_functions(files: DataFrame, low: int = MIN_TOKENS, high: int = MAX_TOKENS) -> DataFrame:
    """Public functions of ``(file_path, content)`` files within the token band.

    Parsing is per file in the tasks, and a task holds the functions of one
    file at a time; everything else is columns. ``doc_id`` comes from the full
    path, ``id`` is for display and may repeat.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["file_path"], frame["content"]):
                rows = [(path, *function) for function in defined_functions(content)]
                if rows:
                    yield pd.DataFrame(rows, columns=["file_path", "function_name", "line", "code"])

    functions = files.select("file_path", "content").mapInPandas(run, _FUNCTIONS)
    line = F.col("line").cast("string")
    return (
        token_band(functions.where(~F.startswith("function_name", F.lit("_"))), "code", low, high)
        .select(
            F.md5(F.to_json(F.struct("file_path", "function_name", "line"))).alias("doc_id"),
            F.concat_ws("::", path_tail("file_path"), "function_name", line).alias("id"),
            "code",
            "file_path",
            "function_name",
            "token_count",
        )
    )
