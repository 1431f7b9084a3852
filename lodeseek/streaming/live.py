"""The event parser and fold as Structured Streaming operators with keyed state."""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "stream_id string, event_no long, event string, data string"
# Carried between batches: text after the last blank line, blank lines so far, and whether a CR came last.
STATE = "pending string, blanks long, after_cr boolean"
# Events that end a result stream.
FINAL = ("done", "error")
_FIELD = re.compile(r"^(event|data):(.*)$", re.M)


def advance(pending: str, blanks: int, after_cr: bool, text: str) -> tuple[tuple[str, int, bool], list[tuple[int, str, str]]]:
    """Add ``text`` to an open stream: the new state, and (event_no, event, data) of the events it closed.

    Numbering is that of ``events.tokenize``: an event's number is the count of blank lines before it.
    """
    if not text:
        return (pending, blanks, after_cr), []
    ends_cr = text.endswith("\r")
    if after_cr:
        text = text.removeprefix("\n")
    # a blank line is a break at the start of the open text or right after another break
    blocks = re.split(r"(?<=\n)\n|^\n", pending + re.sub(r"\r\n?", "\n", text))
    closed = []
    for number, block in enumerate(blocks[:-1], blanks):
        fields = pd.DataFrame(_FIELD.findall(block), columns=["name", "value"])
        values = fields["value"].str.strip().groupby(fields["name"]).agg(list)
        if "data" in values:
            closed.append((number, (values.get("event") or [""])[-1] or "message", "\n".join(values["data"])))
    return (blocks[-1], blanks + len(blocks) - 1, ends_cr), closed


def _advancer(idle_ms: int | None):
    columns = ["stream_id", "event_no", "event", "data"]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        carried, closed = advance(*(state.get if state.exists else ("", 0, False)), "".join(rows["chunk"]))
        if closed and closed[-1][1] in FINAL and not carried[0]:
            if state.exists:
                state.remove()
        else:
            state.update(carried)
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *event) for event in closed], columns=columns)

    return run


def tokenize_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming counterpart of ``events.tokenize`` for (stream_id, seq, chunk).

    State per stream is one open event. It is dropped when the stream's final event closes, or after ``idle_ms`` of silence
    where that is given (for queries that run on; a run over what is available would wait for the timeouts).
    Chunks of one stream must arrive in ``seq`` order across batches.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("stream_id").applyInPandasWithState(_advancer(idle_ms), EVENTS, STATE, "append", timeout)


def emit_batches(answers: DataFrame, write_events, checkpoint: str):
    """Start a query that turns each micro-batch of answers into events and hands them on."""
    from lodeseek.streaming.events import emit_events

    def run(batch: DataFrame, batch_id: int) -> None:
        write_events(emit_events(batch).withColumn("batch_id", F.lit(batch_id)), batch_id)

    return answers.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
