"""Answers to server-sent events and back, as ordered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.functions.text import LINE_BREAK, blank_to_null, col_of
from lodeseek.operators.ordered import running_total

# Event names in the order a search emits them.
STAGES = ("missing", "source", "summary", "code", "done")
CODE = "struct<lang:string,code:string,explain:string,source:string>"
SOURCE = "struct<type:string,ref:string,url:string,score:double,fetched_at:string>"
PAYLOAD = (
    f"missing_sources array<string>, summary string, code_examples array<{CODE}>, sources array<{SOURCE}>, "
    "used_models map<string,string>, query string, error string, "
    "type string, ref string, url string, score double, fetched_at string, "
    "lang string, code string, explain string, source string"
)


def source_payload(s: Column) -> Column:
    """JSON of one source; empty ref, url and fetched_at are left out."""
    return F.to_json(F.struct(
        s["type"].alias("type"), F.coalesce(s["score"], F.lit(0.0)).alias("score"), blank_to_null(s["ref"]).alias("ref"),
        blank_to_null(s["url"]).alias("url"), blank_to_null(s["fetched_at"]).alias("fetched_at")),
        {"ignoreNullFields": "true"})


def emit_events(answers: DataFrame) -> DataFrame:
    """(stream_id, seq, event, data): missing, each source, summary, each code example, done.

    ``seq`` is unique and rising within a stream.
    """
    sid = F.col("query_id").alias("stream_id")
    keep = {"ignoreNullFields": "false"}
    answer = F.struct("query", "summary", "code_examples", "sources", "missing_sources", "used_models")

    size = lambda array: F.greatest(F.coalesce(F.size(array), F.lit(0)), F.lit(0)).cast("bigint")
    listed, shown = size("sources"), size("code_examples")
    # Each event's place follows from the lengths of the lists before it.
    first = (F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), 1 + listed, 2 + listed, 2 + listed + shown)

    def rows(stage: int, data: Column) -> DataFrame:
        return answers.select(sid, first[stage].alias("seq"), F.lit(STAGES[stage]).alias("event"), data.alias("data"))

    def each(stage: int, array: str, payload) -> DataFrame:
        items = answers.select(sid, first[stage].alias("_first"), F.posexplode(array).alias("p", "item"))
        return items.select("stream_id", (F.col("_first") + F.col("p")).alias("seq"),
                            F.lit(STAGES[stage]).alias("event"), payload(F.col("item")).alias("data"))

    parts = [
        rows(0, F.to_json(F.struct("missing_sources"), keep)),
        each(1, "sources", source_payload),
        rows(2, F.to_json(F.struct("summary"), keep)),
        each(3, "code_examples", lambda item: F.to_json(item, keep)),
        rows(4, F.to_json(answer, keep)),
    ]
    return reduce(DataFrame.unionByName, parts)


def wire_text(event, data) -> Column:
    """One event as it goes over the wire; each line of the data gets its own field."""
    lines = F.array_join(F.transform(F.split(col_of(data), LINE_BREAK), lambda l: F.concat(F.lit("data: "), l)), "\n")
    return F.concat(F.lit("event: "), col_of(event), F.lit("\n"), lines, F.lit("\n\n"))


def tokenize(chunks: DataFrame, group_rows: int | None = None) -> DataFrame:
    """(stream_id, event_no, event, data) of byte chunks (stream_id, seq, chunk).

    Lines may break anywhere, also inside CR LF. Line numbers are a running count of
    breaks and event numbers a running count of blank lines, so a stream is split
    across tasks when it is long and only single lines and events are gathered.
    A line without its break and an event without its blank line stay open and are
    not returned; events without data are dropped; other fields are ignored.
    """
    rows = chunks.where(F.col("chunk") != "").select("stream_id", "seq", "chunk")
    numbered = running_total(rows, ["stream_id"], ["seq"], F.lit(1), "n", group_rows=group_rows)
    ends = numbered.select("stream_id", (F.col("n") + 1).alias("n"), F.col("chunk").endswith("\r").alias("after_cr"))
    # The LF of a CR LF split over two chunks belongs to the break already counted.
    text = F.when(F.col("after_cr") & F.col("chunk").startswith("\n"), F.expr("substring(chunk, 2)")).otherwise(F.col("chunk"))
    cut = numbered.join(ends, ["stream_id", "n"], "left").select(
        "stream_id", "n", F.split(text, LINE_BREAK, -1).alias("pieces")).withColumn("breaks", F.size("pieces") - 1)
    placed = running_total(cut, ["stream_id"], ["n"], "breaks", "end", group_rows=group_rows)
    pieces = placed.select(
        "stream_id", "n", "end", "breaks", F.posexplode("pieces").alias("p", "piece")
    ).select("stream_id", "n", "piece", (F.col("end") - F.col("breaks") + F.col("p")).alias("line_no"),
             (F.col("p") < F.col("breaks")).alias("closed"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "")
    lines = pieces.groupBy("stream_id", "line_no").agg(body.alias("line"), F.bool_or("closed").alias("closed"))
    lines = lines.where("closed").withColumn("blank", F.when(F.col("line") == "", 1).otherwise(0))
    known = None if group_rows is None else group_rows
    counted = running_total(lines, ["stream_id"], ["line_no"], "blank", "seen", group_rows=known)
    fields = counted.withColumn("event_no", F.col("seen") - F.col("blank"))
    is_event, is_data = F.col("line").startswith("event:"), F.col("line").startswith("data:")
    value = F.regexp_replace(F.regexp_replace("line", "^(event|data):", ""), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    data = F.array_sort(F.collect_list(F.when(is_data, F.struct("line_no", value.alias("v")))))
    events = fields.groupBy("stream_id", "event_no").agg(
        F.max_by(F.when(is_event, value), F.when(is_event, F.col("line_no"))).alias("event"),
        data.alias("d"), F.max("blank").alias("closed"))
    return events.where((F.col("closed") == 1) & (F.size("d") > 0)).select(
        "stream_id", "event_no", F.coalesce(blank_to_null("event"), F.lit("message")).alias("event"),
        F.array_join(F.transform("d", lambda x: x["v"]), "\n").alias("data"))


def dispatch(events: DataFrame) -> DataFrame:
    """Adds ``kind`` and the parsed ``payload``; unreadable JSON becomes kind ``error``.

    Events with other names pass by with kind null.
    """
    parsed = F.from_json("data", PAYLOAD, {"mode": "PERMISSIVE"})
    readable = F.try_parse_json("data").isNotNull()
    known = F.when(F.col("event").isin(*STAGES, "error"), F.col("event"))
    message = F.when(readable, F.when(F.col("event") == "error", F.get_json_object("data", "$.error"))).otherwise(
        F.concat(F.lit("SSE 데이터 파싱 실패: "), F.col("data")))
    return events.withColumn("kind", F.when(readable, known).otherwise(F.lit("error"))).withColumn(
        "payload", parsed).withColumn("error", message)


def fold_state(dispatched: DataFrame) -> DataFrame:
    """One row per stream: the latest shown state.

    Sources and code examples count up, summary and missing replace, ``done``
    overwrites all, an error keeps what was there. Sums and latest values only, so
    a long stream is pre-aggregated where it lies.
    """
    p, kind, no = F.col("payload"), F.col("kind"), F.col("event_no")
    of = lambda k: kind == k
    last = lambda value, *kinds: F.max_by(F.when(kind.isin(*kinds), value), F.when(kind.isin(*kinds), no))
    done = F.max(F.when(of("done"), no))
    state = dispatched.groupBy("stream_id").agg(
        done.alias("done_no"),
        last(p["summary"], "summary", "done").alias("summary"),
        F.array_join(last(p["missing_sources"], "missing", "done"), ",").alias("missing_sources"),
        F.count_if(of("source")).alias("partial_sources"), F.count_if(of("code")).alias("partial_code"),
        last(F.size(p["sources"]), "done").alias("done_sources"),
        last(F.size(p["code_examples"]), "done").alias("done_code"),
        last(p["used_models"], "done").alias("used_models"),
        last(F.col("error"), "error").alias("error"))
    late = dispatched.join(state.select("stream_id", "done_no"), "stream_id").where(no > F.col("done_no"))
    extra = late.groupBy("stream_id").agg(F.count_if(of("source")).alias("more_s"), F.count_if(of("code")).alias("more_c"))
    n = lambda done_n, part, more: F.when(
        F.col("done_no").isNotNull(), F.coalesce(done_n, F.lit(0)) + F.coalesce(more, F.lit(0))).otherwise(F.col(part))
    return state.join(extra, "stream_id", "left").select(
        "stream_id", F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("missing_sources", F.lit("")).alias("missing_sources"),
        n("done_sources", "partial_sources", "more_s").cast("bigint").alias("n_sources"),
        n("done_code", "partial_code", "more_c").cast("bigint").alias("n_code"),
        F.col("done_no").isNotNull().alias("is_done"), "used_models", "error")


def fold_sources(dispatched: DataFrame) -> DataFrame:
    """(stream_id, event_no, pos, type, ref, url, score, fetched_at) shown, in arrival order.

    Partial sources before ``done`` give way to the list inside it.
    """
    names = ("type", "ref", "url", "score", "fetched_at")
    done = dispatched.where("kind = 'done'").groupBy("stream_id").agg(F.max("event_no").alias("done_no"))
    marked = dispatched.join(done, "stream_id", "left")
    partial = marked.where((F.col("kind") == "source") & (F.col("done_no").isNull() | (F.col("event_no") > F.col("done_no"))))
    final = marked.where((F.col("kind") == "done") & (F.col("event_no") == F.col("done_no"))).select(
        "stream_id", "event_no", F.posexplode("payload.sources").alias("pos", "s"))
    return partial.select("stream_id", "event_no", F.lit(0).alias("pos"), *(F.col(f"payload.{n}") for n in names)).unionByName(
        final.select("stream_id", "event_no", "pos", *(F.col(f"s.{n}") for n in names)))
