"""Replaying a log of commands against a keyed table, as one Spark job.

The table is ``(id, name, role, salary)`` with a unique name. Names are
independent of each other, and whether a name is present before a command
depends only on the last earlier add or delete of that name, whether or not
that command succeeded. So the state every command saw comes from ordered
"last value before" steps, which :mod:`kinspot.operators.ordered` keeps
parallel even when one name holds most of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspot.functions.text import whole_json
from kinspot.operators.ordered import DEFAULT_SPAN, PLACE, SPAN, last_before, running_sum, spanned
from kinspot.session import table_exists, written

# --- fixed values: commands, their arguments, and messages ---------------------
INIT, ADD, DELETE, LIST, LOOKUP, UPDATE = (
    "init_db", "add_employee", "delete_employee", "get_employees", "get_employee_salary", "update_employee_salary",
)
TOOLS = {  # tool -> (required arguments, optional arguments)
    INIT: ([], []),
    ADD: (["name", "role", "salary"], []),
    DELETE: (["name"], []),
    LIST: ([], ["role"]),
    LOOKUP: (["name"], []),
    UPDATE: (["name", "salary"], []),
}
TABLE_SCHEMA = "id bigint, name string, role string, salary bigint"
ARGUMENTS = {"name": ("STRING", "string"), "role": ("STRING", "string"), "salary": ("BIGINT", "bigint")}  # kind in JSON, type
OK, ERROR = "success", "error"
UNKNOWN_TOOL = "Unknown tool: "
NOT_AN_OBJECT, MISSING, UNEXPECTED, BAD_VALUE = (
    f"Invalid arguments: {x}" for x in ("not a JSON object", "missing argument", "unexpected argument", "bad value")
)
EMPLOYEE, ADDED, WITH_ID, EXISTS, NOT_FOUND, DELETED, UPDATED, NEW_SALARY, INITIALIZED = (
    "Employee ", "Added ", " with ID ", " already exists", " not found", "Deleted ", "Updated ", "'s salary to $", "Database initialized",
)
# -------------------------------------------------------------------------------

_KEYED = (ADD, DELETE, LOOKUP, UPDATE)


def create_table(spark, path: str) -> DataFrame:
    """Create the empty table at ``path`` unless there is one; return it."""
    if not table_exists(spark, path):
        spark.createDataFrame([], TABLE_SCHEMA).write.parquet(path)
    return spark.read.schema(TABLE_SCHEMA).parquet(path)


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def validate(log: DataFrame) -> DataFrame:
    """Decode ``(seq, tool, arguments)``; ``error`` is null for a runnable command.

    Rejected are unknown (and null) tools, arguments that are not one JSON
    object and nothing else, missing or unexpected names, and values of the
    wrong type: names and roles are strings, salaries integers of 64 bits. A
    required value may not be null. An object that names a key twice is no
    valid object.
    """
    required = F.create_map(*[x for t, (req, _) in TOOLS.items() for x in (F.lit(t), _names(req))])
    allowed = F.create_map(*[x for t, (req, opt) in TOOLS.items() for x in (F.lit(t), _names(req + opt))])
    rows = log.select(
        "seq",
        "tool",
        whole_json("arguments").alias("_json"),
        F.try_element_at(required, F.col("tool")).alias("_required"),
        F.try_element_at(allowed, F.col("tool")).alias("_allowed"),
    ).withColumn("_given", F.try_variant_get("_json", "$", "map<string,variant>"))
    for name, (kind, _) in ARGUMENTS.items():
        value = F.try_element_at("_given", F.lit(name))
        rows = rows.withColumn(f"_kind_{name}", F.schema_of_variant(value))
        rows = rows.withColumn(name, F.when(F.col(f"_kind_{name}") == kind, F.try_variant_get(value, "$", ARGUMENTS[name][1])))
    keys = F.map_keys("_given")

    def bad(name: str) -> Column:
        """Given, not of its type, and not an optional null."""
        kind, must = F.col(f"_kind_{name}"), F.array_contains("_required", name)
        return kind.isNotNull() & F.col(name).isNull() & (must | (kind != "VOID"))

    problem = (
        F.when(F.col("_allowed").isNull(), F.concat(F.lit(UNKNOWN_TOOL), F.coalesce("tool", F.lit("null"))))
        .when(F.col("_given").isNull(), F.lit(NOT_AN_OBJECT))
        .when(F.size(F.array_except("_required", keys)) > 0, F.lit(MISSING))
        .when(F.size(F.array_except(keys, "_allowed")) > 0, F.lit(UNEXPECTED))
        .when(bad("name") | bad("role") | bad("salary"), F.lit(BAD_VALUE))
    )
    return rows.select("seq", "tool", *ARGUMENTS, problem.alias("error"))


def _is(*tools: str) -> Column:
    return F.col("tool").isin(*tools)


def replay(
    commands: DataFrame, base: DataFrame | None = None, max_id: int | None = None, span: int = DEFAULT_SPAN
) -> DataFrame:
    """State and outcome of every valid keyed command, and of the base rows.

    ``commands`` is the result of :func:`validate`. Base rows come first, as
    adds at position -1. Output: ``seq, tool, name, role, salary, ok, id`` (of
    new rows), and what the command saw: ``old_id, old_role, old_salary``.
    """
    keyed = commands.where(F.col("error").isNull() & _is(*_KEYED)).select("seq", "tool", "name", "role", "salary")
    keyed = keyed.withColumn("base_id", F.lit(None).cast("bigint"))
    if base is not None:
        keyed = keyed.unionByName(
            base.select(
                F.lit(-1).cast("bigint").alias("seq"), F.lit(ADD).alias("tool"), "name", "role",
                F.col("salary").cast("bigint").alias("salary"), F.col("id").alias("base_id"),
            )
        )
    # the commands are written twice, in their spans and with their outcome; all three steps share the spans
    keyed = spanned(keyed, "seq", span)
    stands = F.when(_is(ADD), F.lit(True)).when(_is(DELETE), F.lit(False))
    seen = last_before(keyed, ["name"], "seq", {"_present": stands})
    present = F.coalesce("_present", F.lit(False))
    judged = written(
        seen.withColumn("ok", F.when(_is(ADD), ~present).otherwise(present)).drop("_present"), "judged_commands"
    )

    if max_id is not None:
        first = F.lit(max_id)
    elif base is not None:
        first = F.coalesce(base.agg(F.max("id")).scalar(), F.lit(0))
    else:
        first = F.lit(0)
    # only new rows are numbered; base rows all share one position
    is_new = _is(ADD) & F.col("ok") & F.col("base_id").isNull()
    new = running_sum(judged.where(is_new), [], "seq", {"_n": F.lit(1).cast("bigint")})
    numbered = new.withColumn("id", first + F.col("_n")).drop("_n").unionByName(
        judged.where(~is_new).withColumn("id", F.col("base_id"))
    )
    done = F.col("ok")
    replayed = last_before(
        numbered.drop("base_id"),
        ["name"],
        "seq",
        {
            "old_id": F.when(_is(ADD) & done, F.col("id")),
            "old_role": F.when(_is(ADD) & done, F.col("role")),
            "old_salary": F.when(_is(ADD, UPDATE) & done, F.col("salary")),
        },
    )
    return replayed.drop(SPAN, PLACE)


def statuses(commands: DataFrame, replayed: DataFrame) -> DataFrame:
    """Outcome of every command of the log, one row each: ``seq, tool, status, message, salary``."""
    done = replayed.where(F.col("seq") >= 0).select("seq", "tool", "name", "salary", "ok", "id", "old_salary")
    name = F.col("name")
    message = (
        F.when(_is(ADD) & F.col("ok"), F.concat(F.lit(ADDED), name, F.lit(WITH_ID), F.col("id").cast("string")))
        .when(_is(ADD), F.concat(F.lit(EMPLOYEE), name, F.lit(EXISTS)))
        .when(~F.col("ok"), F.concat(F.lit(EMPLOYEE), name, F.lit(NOT_FOUND)))
        .when(_is(DELETE), F.concat(F.lit(DELETED), name))
        .when(
            _is(UPDATE),
            F.concat(F.lit(UPDATED), name, F.lit(NEW_SALARY), F.col("salary").cast("string")),
        )
    )
    status = F.when(F.col("ok"), F.lit(OK)).otherwise(F.lit(ERROR))
    keyed = done.select(
        "seq", "tool", status.alias("status"), message.alias("message"),
        F.when(_is(LOOKUP) & F.col("ok"), F.col("old_salary")).alias("salary"),
    )
    other = commands.where(F.col("error").isNotNull() | ~F.coalesce(_is(*_KEYED), F.lit(False))).select(
        "seq", "tool",
        F.when(F.col("error").isNotNull(), F.lit(ERROR)).otherwise(F.lit(OK)).alias("status"),
        F.coalesce("error", F.when(_is(INIT), F.lit(INITIALIZED))).alias("message"),
        F.lit(None).cast("bigint").alias("salary"),
    )
    return keyed.unionByName(other)


def final_table(replayed: DataFrame) -> DataFrame:
    """The table after the last command."""
    done = F.col("ok")

    def latest(value: str, when: Column) -> Column:
        return F.max_by(value, F.when(when, F.col("seq")))

    written_by = _is(ADD, DELETE) & done
    return (
        replayed.where(_is(ADD, DELETE, UPDATE) & done)
        .groupBy("name")
        .agg(
            latest("tool", written_by).alias("_last"),
            latest("id", _is(ADD)).alias("id"),
            latest("role", _is(ADD)).alias("role"),
            latest("salary", _is(ADD, UPDATE)).alias("salary"),
        )
        .where(F.col("_last") == ADD)
        .select("id", "name", "role", "salary")
    )


def lookups_as_of(replayed: DataFrame) -> DataFrame:
    """What each lookup saw at its place in the log; null when the name was absent."""
    return replayed.where(_is(LOOKUP)).select(
        "seq", "name", F.col("ok").alias("found"), F.when(F.col("ok"), F.col("old_salary")).alias("salary")
    )


def row_versions(replayed: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Every state of every row: valid after ``valid_from`` up to ``valid_to`` (null: still valid)."""
    changes = replayed.where(_is(ADD, DELETE, UPDATE) & F.col("ok"))
    ended = last_before(changes, ["name"], "seq", {"valid_to": F.col("seq")}, span, backwards=True)
    return ended.where(_is(ADD, UPDATE)).select(
        F.coalesce("id", "old_id").alias("id"),
        "name",
        F.when(_is(ADD), F.col("role")).otherwise(F.col("old_role")).alias("role"),
        "salary",
        F.col("seq").alias("valid_from"),
        "valid_to",
    )


def table_as_of(versions: DataFrame, seq: Column) -> DataFrame:
    """The table a command at position ``seq`` saw."""
    return versions.where((F.col("valid_from") < seq) & (F.col("valid_to").isNull() | (F.col("valid_to") >= seq))).select(
        "id", "name", "role", "salary"
    )


def role_changes(replayed: DataFrame) -> DataFrame:
    """``seq, role, rows, total``: by how much each successful write changes a role's number of rows and salary total."""
    salary, old = F.col("salary"), F.col("old_salary")
    return replayed.where(F.col("ok") & _is(ADD, DELETE, UPDATE)).select(
        "seq",
        F.when(_is(ADD), F.col("role")).otherwise(F.col("old_role")).alias("role"),
        F.when(_is(ADD), F.lit(1)).when(_is(DELETE), F.lit(-1)).otherwise(F.lit(0)).cast("bigint").alias("rows"),
        F.when(_is(ADD), salary).when(_is(DELETE), -old).otherwise(salary - old).alias("total"),
    )


def list_calls_as_of(
    commands: DataFrame, replayed: DataFrame, span: int = DEFAULT_SPAN, start: DataFrame | None = None
) -> DataFrame:
    """Number of rows and salary total every list call saw, role filter included.

    Each successful write changes a role's count and total by a known amount,
    so a list call reads running sums; no call is joined with the rows it saw.
    ``start`` (role, rows, total) are sums before the log; base rows among
    ``replayed`` are then part of them.
    """
    done = role_changes(replayed)
    if start is not None:
        begin = start.select(F.lit(-1).cast("bigint").alias("seq"), "role", "rows", "total")
        done = done.where(F.col("seq") >= 0).unionByName(begin)
    # base rows share one position, so they are summed up first
    changes = done.groupBy("seq", "role").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    # every change counts for its role and for the unfiltered table
    both = changes.withColumn("scope", F.explode(F.array(F.struct(F.col("role").alias("r")), F.struct(F.lit(None).cast("string").alias("r")))))
    deltas = both.groupBy("seq", F.col("scope.r").alias("role")).agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total")
    )
    calls = commands.where(F.col("error").isNull() & _is(LIST)).select(
        "seq",
        F.when(F.col("role") != "", F.col("role")).alias("role"),
        F.lit(None).cast("bigint").alias("rows"),
        F.lit(None).cast("bigint").alias("total"),
        F.lit(True).alias("is_call"),
    )
    line = deltas.withColumn("is_call", F.lit(False)).unionByName(calls).select(
        "seq", F.coalesce(F.concat(F.lit("="), "role"), F.lit("*")).alias("scope"), "role", "rows", "total", "is_call"
    )
    summed = running_sum(line, ["scope"], "seq", {"n_rows": F.col("rows"), "salary_total": F.col("total")}, span)
    return summed.where("is_call").select("seq", "role", "n_rows", "salary_total")


def summary(outcome: DataFrame) -> DataFrame:
    """Commands per tool and status."""
    return outcome.groupBy("tool", "status").agg(F.count("*").alias("n_commands"))


# --- batch forms ------------------------------------------------------------------


def apply_adds(base: DataFrame, adds: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Insert ``(seq, name, role, salary)`` rows; the first of a new name wins.

    Returns the new rows only, with ids after the largest existing one.
    """
    first = adds.groupBy("name").agg(F.min_by(F.struct("seq", "role", "salary"), "seq").alias("_first"))
    fresh = first.join(base.select("name"), "name", "left_anti").select(
        F.col("_first.seq").alias("seq"), "name", "_first.role", "_first.salary"
    )
    start = F.coalesce(base.agg(F.max("id")).scalar(), F.lit(0))
    counted = running_sum(fresh, [], "seq", {"_n": F.lit(1).cast("bigint")}, span)
    return counted.select((start + F.col("_n")).alias("id"), "name", "role", "salary")


def apply_deletes(base: DataFrame, names: DataFrame) -> DataFrame:
    """Rows that remain when the given names are deleted."""
    return base.join(names.select("name").distinct(), "name", "left_anti").select(base.columns)


def apply_updates(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Set each row's salary to the last update ``(seq, name, salary)`` of its name."""
    last = updates.groupBy("name").agg(F.max_by("salary", "seq").alias("_new"))
    return base.join(last, "name", "left").select(
        *[F.coalesce("_new", "salary").alias("salary") if c == "salary" else F.col(c) for c in base.columns]
    )


def filter_optional(table: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """Rows with the value; all rows when it is None or empty."""
    return table.where(F.col(column) == value) if value else table


def point_lookups(table: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """One outcome per asked key; an unknown key is an error row, not a missing one."""
    found = table.select(F.col(key), F.col(value), F.lit(True).alias("_found"))
    return names.select(key).join(found, key, "left").select(
        key,
        F.when(F.col("_found"), F.lit(OK)).otherwise(F.lit(ERROR)).alias("status"),
        F.when(F.col("_found").isNull(), F.concat(F.lit(EMPLOYEE), key, F.lit(NOT_FOUND))).alias("message"),
        value,
    )
