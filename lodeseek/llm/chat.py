"""Chat formatting of reply trees.

A message names its parent; a message without one, or whose parent isn't there, is a root. Conversation and node become one
number. Root-to-leaf paths come from self-joins that double the jump: a step k joins every path to its ancestors 2^k further
up, so the number of joins grows with the logarithm of the depth. Branches of a conversation are ranked by the summed scores of their messages; the best
``branches`` are formatted, one string each, with the spans of the assistant's text as loss mask.

Null text is empty, null role is empty. Messages with a null conv_id are one conversation. Control strings can't occur inside a text or role: backslash becomes two, ``<|``
becomes ``<\\|``, and a line break in a role becomes ``\\n``; reading back undoes it. Messages in a parent cycle have no root and no
path. Equal scores go to the smaller leaf. Rows with one conv_id and node are one message: that of the least parent, score
and digest of role and text. Very long texts travel twice, into the numbered table and to their chosen branches. Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodeseek.llm.common import Scratch, setting

#: The turn markers of the template.
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
LEARNED = "assistant"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, end) spans of its learned texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role or '', True)}\n", escape(text or "")
        if (role or "") == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns and the learned text of a formatted conversation."""
    turns = [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]
    return turns, "".join(unescape(formatted[a:b]) for a, b in spans)


def paths(nodes: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """``nodes`` (id, up: id of the parent or null; longs) -> (leaf, id, at, root): all messages from each leaf upwards.

    ``at`` counts the steps from the leaf, ``root`` marks the row of a root; a leaf whose way ends in a cycle has no such row
    (its way is followed for ``most`` steps, the messages of the largest conversation).
    Keys are single longs and unique on one side of each join. Joins are shuffled: nothing is gathered at the driver in the loop.
    """
    with setting(nodes.sparkSession, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        above = nodes.select(F.col("id").alias("up"), F.col("up").isNull().alias("top"))
        jumps = scratch.put(nodes.where("up is not null").select("id", "up").join(above, "up"), "jumps")
        leaves = nodes.join(jumps.select(F.col("up").alias("id")), "id", "left_anti")
        found = scratch.put(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("at"), F.col("up").isNull().alias("root")), "paths")
        far, rows = 1, found.count()
        while far <= most:
            more = found.join(jumps, "id").select("leaf", F.col("up").alias("id"), (F.col("at") + far).alias("at"), F.col("top").alias("root"))
            longer = scratch.put(found.unionByName(more), "paths")
            scratch.drop(found)
            found, size = longer, longer.count()
            if size == rows:
                break
            rows = size
            ahead = jumps.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("top").alias("_top"))
            twice = scratch.put(jumps.select("id", "up").join(ahead, "up").select("id", F.col("_next").alias("up"), F.col("_top").alias("top")), "jumps")
            scratch.drop(jumps)
            jumps, far = twice, far * 2
    return found


def _render_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array([d[0] for d in done], pa.string()),
             pa.array([[{"start": a, "end": b} for a, b in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["conv_id", "leaf", "score", "formatted", "loss"])


def format_conversations(messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """``messages`` (conv_id, node, parent, role, text, score) -> conv_id, leaf, score, formatted, loss (spans)."""
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    told = messages.select(
        F.struct("conv_id").alias("conv"), "node", "parent", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))  # as a field of a struct, null equals null in the joins
    told = scratch.put(told.withColumn("id", F.monotonically_increasing_id()), "messages")
    # of rows under one node the first counts; texts stay out until the branches are chosen
    first = F.min(F.struct("parent", "score", F.md5(F.concat_ws(":", "role", "text").cast("binary")).alias("words"), "id")).alias("m")
    named = scratch.put(told.groupBy("conv", "node").agg(first).select("conv", "node", "m.parent", "m.score", "m.id"), "named")
    parents = named.select("conv", F.col("node").alias("parent"), F.col("id").alias("up"))
    with setting(messages.sparkSession, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        nodes = scratch.put(named.join(parents, ["conv", "parent"], "left").select("id", "up"), "nodes")
        most = named.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        found = paths(nodes, most, scratch)
        scores = found.join(named.select("id", "score"), "id").groupBy("leaf").agg(F.sum("score").alias("score"), F.bool_or("root").alias("root"))
        ranked = scores.where("root").join(named.select(F.col("id").alias("leaf"), "conv", "node"), "leaf")
        best = Window.partitionBy("conv").orderBy(F.desc("score"), "node")
        chosen = ranked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= branches)
        chosen = scratch.put(chosen.select("leaf", "score", "conv", "node"), "chosen")
        turns = found.select("leaf", "id", "at").join(chosen, "leaf").join(told.select("id", "role", "text"), "id")
        gathered = turns.groupBy("leaf").agg(
            F.first("conv").alias("conv"), F.first("node").alias("node"), F.first("score").alias("score"),
            F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("at"), "role", "text"))).alias("turns"))
        gathered = gathered.select(F.col("conv.conv_id").alias("conv_id"), F.col("node").alias("leaf"), "score", "turns")
        return scratch.put(gathered.mapInArrow(
            _render_rows, f"conv_id {kinds['conv_id']}, leaf {kinds['node']}, score double, formatted string, loss array<struct<start: bigint, end: bigint>>"), "formatted")


def linear(rows: DataFrame) -> DataFrame:
    """Conversations given as numbered turns (conv_id, turn, role, text): each message answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
