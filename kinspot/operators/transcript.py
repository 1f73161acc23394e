"""Ordered conversation transcripts and tool-call pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspot.operators.ordered import DEFAULT_SPAN, running_sum

# --- fixed values -----------------------------------------------------------
SYSTEM_MESSAGE = (
    "You are an HR database assistant. Execute user requests directly using the available tools. "
    "When users reference people from earlier in the conversation (like 'fire him'), "
    "use that context to determine who they mean."
)
# ----------------------------------------------------------------------------


def assemble(messages: DataFrame, system: str = SYSTEM_MESSAGE, span: int = DEFAULT_SPAN) -> DataFrame:
    """Messages in order, with a default system message first where there is none.

    ``messages`` has ``conv_id, turn, role, content`` and may have more
    columns. The result stays one row per message with its 0-based
    ``position``, so a conversation of any length is spread over the tasks.
    Messages of one turn stand in the order of role and content; a null turn
    comes first.
    """
    without = (
        messages.groupBy("conv_id")
        .agg(
            F.count_if(F.col("role") == "system").alias("n"),
            F.when(F.count_if(F.col("turn").isNull()) == 0, F.min("turn") - 1).alias("turn"),
        )
        .where(F.col("n") == 0)
        .select("conv_id", "turn", F.lit("system").alias("role"), F.lit(system).alias("content"))
    )
    rest = F.lit(True).alias("_rest")  # what the default message comes before, whatever its turn
    every = messages.select("*", rest).unionByName(without.withColumn("_rest", F.lit(False)), allowMissingColumns=True)
    numbered = running_sum(every, ["conv_id"], "turn", {"_n": F.lit(1).cast("bigint")}, span, then=["_rest", "role", "content"])
    return numbered.withColumn("position", F.col("_n") - 1).drop("_n", "_rest")


def pages(transcripts: DataFrame, page_size: int = 1000) -> DataFrame:
    """Transcripts as arrays of at most ``page_size`` messages per row; a message keeps all its columns."""
    message = F.struct("position", *[c for c in transcripts.columns if c not in ("conv_id", "position")])
    in_order = F.array_sort(F.collect_list(message), lambda a, b: F.sign(a["position"] - b["position"]).cast("int"))
    return (
        transcripts.withColumn("_page", F.floor(F.col("position") / page_size))
        .groupBy("conv_id", F.col("_page").alias("page"))
        .agg(in_order.alias("messages"))
    )


def pair_calls(messages: DataFrame) -> DataFrame:
    """Every tool call with the content of the message that answers it, or null.

    ``messages`` has ``conv_id, turn, role, content, tool_calls, tool_call_id``.
    """
    calls = messages.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.explode("tool_calls").alias("call")
    ).select("conv_id", "turn", F.col("call.id").alias("tool_call_id"), F.col("call.name").alias("tool"), "call.arguments")
    answers = messages.where(F.col("role") == "tool").select(
        "conv_id", "tool_call_id", F.col("content").alias("result")
    )
    return calls.join(answers, ["conv_id", "tool_call_id"], "left")
