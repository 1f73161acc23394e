"""A keyed table that outlives a run: logs are replayed one after another, each from the state the one before left.

The state at a path is a version folder for each log: the table, its row count
and salary total per role, the largest id ever given, and the last position. A
new log is joined to the rows whose names it mentions; rows it does not
mention are carried over as they are, and no earlier log is read again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspot.operators import replay as rp
from kinspot.operators.ordered import DEFAULT_SPAN
from kinspot.session import table_exists, written

SUMS = "role string, rows bigint, total bigint"
ABOUT = "version bigint, folder string, last_seq bigint, max_id bigint"
LATE = "Position is not after the last log"


@dataclass(frozen=True)
class TableState:
    table: DataFrame  # id, name, role, salary
    sums: DataFrame  # role, rows, total
    version: int
    last_seq: int
    max_id: int


@dataclass(frozen=True)
class LogRun:
    """What a log did: ``commands`` as validated, ``replayed`` states, ``statuses``, ``list_calls``, and the state it left."""

    commands: DataFrame
    replayed: DataFrame
    statuses: DataFrame
    list_calls: DataFrame
    state: TableState


def load_state(spark: SparkSession, path: str) -> TableState:
    """The state that the last finished log left; an empty table if there was none."""
    if not table_exists(spark, f"{path}/versions"):
        return TableState(spark.createDataFrame([], rp.TABLE_SCHEMA), spark.createDataFrame([], SUMS), 0, -1, 0)
    last = spark.read.schema(ABOUT).parquet(f"{path}/versions/*").orderBy(F.desc("version")).first()
    folder = f"{path}/{last['folder']}"
    table, sums = (spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in (("table", rp.TABLE_SCHEMA), ("sums", SUMS)))
    return TableState(table, sums, last["version"], last["last_seq"], last["max_id"])


def start_table(base: DataFrame, path: str) -> TableState:
    """Make ``base`` (id, name, role, salary; names unique) the state at ``path``, which must have none."""
    spark = base.sparkSession
    if load_state(spark, path).version:
        raise ValueError(f"there is a table at {path}")
    rows = base.select("id", "name", "role", F.col("salary").cast("bigint").alias("salary"))
    sums = rows.groupBy("role").agg(F.count("*").alias("rows"), F.sum("salary").alias("total"))
    return _left(path, 0, rows, sums, -1, rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])


def _left(path: str, before: int, table: DataFrame, sums: DataFrame, last_seq: int, max_id: int) -> TableState:
    """Write a state; of two logs that started from one state the second fails."""
    spark, folder = table.sparkSession, f"state-{uuid.uuid4().hex}"
    table = written(table.select("id", "name", "role", "salary"), "table", f"{path}/{folder}/table")
    sums = written(sums.select("role", "rows", "total"), "sums", f"{path}/{folder}/sums")
    about = spark.createDataFrame([(before + 1, folder, last_seq, max_id)], ABOUT).coalesce(1)
    about.write.mode("errorifexists").parquet(f"{path}/versions/version-{before + 1}")
    return TableState(table, sums, before + 1, last_seq, max_id)


def run_log(log: DataFrame, path: str, span: int = DEFAULT_SPAN) -> LogRun:
    """Replay ``log`` (seq, tool, arguments) on the table at ``path`` and leave the new state there.

    Positions go on from log to log; a command that is not after the last
    position of the logs before is an error row and changes nothing.
    """
    state = load_state(log.sparkSession, path)
    late = F.coalesce(F.col("seq") <= state.last_seq, F.lit(False))
    checked = rp.validate(log).withColumn("error", F.when(late, F.lit(LATE)).otherwise(F.col("error")))
    commands = written(checked, "commands")
    named = commands.where("error IS NULL AND name IS NOT NULL").select("name").distinct()
    touched = state.table.join(named, "name", "left_semi")
    replayed = written(rp.replay(commands, touched, max_id=state.max_id, span=span), "replayed")
    statuses = written(rp.statuses(commands, replayed), "statuses")
    list_calls = written(rp.list_calls_as_of(commands, replayed, span, start=state.sums), "list_calls")
    rest = state.table.join(named, "name", "left_anti")
    changes = rp.role_changes(replayed).where("seq >= 0").select("role", "rows", "total").unionByName(state.sums)
    sums = changes.groupBy("role").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).where("rows <> 0 OR total <> 0")
    last, most = commands.agg(F.max("seq")).first()[0], replayed.agg(F.max("id")).first()[0]
    left = _left(
        path, state.version, rest.unionByName(rp.final_table(replayed)), sums,
        max(x for x in (state.last_seq, last) if x is not None), max(x for x in (state.max_id, most) if x is not None),
    )
    return LogRun(commands, replayed, statuses, list_calls, left)
