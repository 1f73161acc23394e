"""Chat transcripts from reply trees.

Messages point to the message they reply to. Root-to-leaf paths are found by
iterative self-joins whose reach doubles: after i joins a message knows its
ancestor 2**i replies up and the summed score of the replies between, so a
tree of any depth needs as many joins as its depth has binary digits. Leaves
are ranked within their tree by the score of their path, and the chosen paths
only are spelled out, again by one join for each binary digit: every distance
from the leaf is reached once.

A path becomes one text, a turn being ``### role: text</turn>`` and a newline.
Inside texts a backslash goes before ``\\``, ``#`` and ``<``, in roles before
``:`` too, so nothing in a text can look like a mark, and parsing gives back
exactly what was formatted. The loss mask covers assistant texts.

Cases: null texts and roles are empty ones. A message whose parent is not
there is a root; messages on a circle of parents are left out. Equal ids of
messages do not occur, as they are numbered here. Turns of one conversation
with equal numbers stand in the order of role, then text; a null number comes
first. Rows without conversation id are one conversation. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinspot.llm.stage import stored

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
LEARNT = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL)
_MARKS, _ROLE_MARKS, _ESCAPED = re.compile(r"([\\#<])"), re.compile(r"([\\#<:])"), re.compile(r"\\(.)", re.DOTALL)


def format_turns(turns: list[tuple[str, str]], learnt: str = LEARNT) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns, and begin and end of each masked range in it."""
    out, masks, at = [], [], 0
    for role, text in turns:
        head = OPEN + _ROLE_MARKS.sub(r"\\\1", role) + BETWEEN
        body = _MARKS.sub(r"\\\1", text)
        at += len(head)
        if role == learnt:
            masks.append((at, at + len(body)))
        out += [head, body, CLOSE]
        at += len(body) + len(CLOSE)
    return "".join(out), masks


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """The turns that ``format_turns`` was given."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def root_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``leaf``, ``node``, ``up`` (replies from the leaf) on the ``branches`` best root-to-leaf paths of each tree.

    ``nodes``: tree, node (unique), parent (null at roots), score. Of equal
    path scores the smaller leaf is the better.
    """
    reach = stored(nodes.select("node", F.col("parent").alias("above"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")), "reach-0")
    n = reach.count()
    jumps: list[DataFrame] = []
    going, rooted = reach.filter("above IS NOT NULL"), reach.filter("above IS NULL")
    while len(jumps) <= math.log2(max(n, 1)) + 1 and not going.isEmpty():
        jumps.append(going.select("node", "above"))
        # messages whose whole way up is known are looked up, but go no further
        upper = going.union(rooted).select(F.col("node").alias("above"), F.col("above").alias("higher"), F.col("total").alias("more"))
        further = going.join(upper, "above", "left").select("node", F.col("higher").alias("above"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"))
        reach = stored(further, f"reach-{len(jumps)}")
        going, rooted = reach.filter("above IS NOT NULL"), rooted.union(reach.filter("above IS NULL"))
    rooted = rooted.select("node", "total")
    parents = nodes.select(F.col("parent").alias("node")).dropna().distinct()
    leaves = nodes.select("tree", "node").join(parents, "node", "left_anti").join(rooted, "node")
    best = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("place", best).filter(F.col("place") <= branches)
    paths = stored(chosen.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    for i in reversed(range(len(jumps))):
        further = paths.join(jumps[i], "node").select("leaf", F.col("above").alias("node"), (F.col("up") + (1 << i)).alias("up"))
        paths = stored(paths.union(further), "paths")
    return paths


def _format_task(learnt: str):
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, tree, turns = None, None, []

        def conversation() -> pa.RecordBatch:
            text, masks = format_turns(turns, learnt)
            spans = [{"begin": a, "end": b} for a, b in masks]
            return pa.RecordBatch.from_arrays([pa.array([tree], pa.int64()), pa.array([leaf], pa.int64()), pa.array([text], pa.string()), pa.array([spans], kind)], ["tree", "leaf", "formatted", "loss_mask"])

        for batch in batches:
            for own_leaf, own_tree, role, text in zip(*(batch.column(c).to_pylist() for c in ("leaf", "tree", "role", "text")), strict=True):
                if own_leaf != leaf and leaf is not None:
                    yield conversation()
                    turns = []
                leaf, tree = own_leaf, own_tree
                turns.append((role, text))
        if leaf is not None:
            yield conversation()

    return run


def format_trees(messages: DataFrame, branches: int = 1, learnt: str = LEARNT) -> DataFrame:
    """One conversation for each of the best paths of each tree: tree, leaf, formatted, loss_mask.

    ``messages``: tree, node, parent, score, role, text. Rows of a path reach
    a task in order and are formatted one path after another.
    """
    paths = root_paths(messages.select("tree", "node", "parent", "score"), branches)
    said = messages.select("node", F.col("tree").cast("long").alias("tree"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, "node").repartition("leaf").sortWithinPartitions("leaf", F.desc("up"))
    return turns.select("leaf", "tree", "role", "text").mapInArrow(_format_task(learnt), "tree long, leaf long, formatted string, loss_mask array<struct<begin:long,end:long>>")


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Numbered conversations as trees: each turn replies to the one before it; its score is its length."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id()), "messages")
    before = F.lag("node").over(Window.partitionBy("tree").orderBy("turn", "role", "text", "node"))
    return stored(rows.select("tree", "node", before.alias("parent"), F.coalesce(F.length("text"), F.lit(0)).alias("score"), "role", "text"), "replies")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            turns = parse_turns(row["formatted"])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(unescape(row["formatted"][m["begin"] : m["end"]]) for m in row["loss_mask"])
            rows.append((row["tree"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"])))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def conversation_report(conversations: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations give back when they are parsed."""
    formatted = stored(format_trees(reply_chain(conversations)), "formatted")
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
