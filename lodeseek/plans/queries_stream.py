"""Event streams made from conversations and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.plans.queries_answer import EXAMPLES_SQL, SOURCES_SQL, answers
from lodeseek.plans.registry import query, table
from lodeseek.runtime import stage
from lodeseek.streaming.events import dispatch, emit_events, fold_sources, fold_state, tokenize, wire_text

# A conversation on the wire: every turn is one event named by its role.
STRIP = "regexp_replace(@, '^[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+|[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+$', '', 'g')"


def cut_stream(frames, chars: int = 61):
    """Wire text of ordered frames (stream_id, seq, wire), cut into pieces that ignore line ends."""
    starts = F.sequence(F.lit(1), F.length("wire"), F.lit(chars))
    piece = frames.select("stream_id", "seq", "wire", F.posexplode(starts).alias("n", "at"))
    return piece.select("stream_id", (F.shiftleft(F.col("seq").cast("bigint"), 31) + F.col("n")).alias("seq"),
                        F.substring(F.col("wire"), F.col("at"), F.lit(chars)).alias("chunk"))


def conversation_chunks(spark, d):
    turns = table(spark, d, "conversations")
    return cut_stream(turns.select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), wire_text("role", "text").alias("wire")))


@query("sse_tokenize", f"""
SELECT conv_id AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event_no, role AS event,
       array_to_string([{STRIP.replace('@', 'x')} FOR x IN string_split_regex(text, '\\r\\n|\\r|\\n')], chr(10)) AS data
FROM conversations
""")
def sse_tokenize(spark, d):
    """Parsing the cut wire text gives the turns back."""
    return tokenize(conversation_chunks(spark, d))


@query("sse_dispatch", """
SELECT user_id AS stream_id, event_id AS event_no,
       CASE event_type WHEN 'click' THEN 'source' WHEN 'view' THEN 'summary' ELSE 'error' END AS kind,
       CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN NULL WHEN 'error' THEN event_type
            ELSE 'SSE 데이터 파싱 실패: ' || event_type || ' ' || props END AS error
FROM events
""")
def sse_dispatch(spark, d):
    """Clicks are sources, views summaries, errors errors; the rest carries broken JSON."""
    e = F.col("event_type")
    name = F.when(e == "click", "source").when(e == "view", "summary").when(e == "error", "error").otherwise("code")
    data = (F.when(e.isin("click", "view"), F.col("props")).when(e == "error", F.to_json(F.struct(e.alias("error"))))
            .otherwise(F.concat(e, F.lit(" "), F.col("props"))))
    events = table(spark, d, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("event_no"), name.alias("event"), data.alias("data"))
    return dispatch(events).select("stream_id", "event_no", "kind", "error")


EMIT_SQL = f"""
WITH {SOURCES_SQL}, {EXAMPLES_SQL}, asked AS (SELECT DISTINCT conv_id AS query_id FROM conversations)
"""


@query("sse_emit", f"""{EMIT_SQL}
SELECT query_id AS stream_id, unnest(['missing', 'summary', 'done']) AS event, 1::BIGINT AS n FROM asked
UNION ALL SELECT query_id, 'source', count(*) FROM reranked SEMI JOIN asked USING (query_id) GROUP BY query_id
UNION ALL SELECT query_id, 'code', count(*) FROM supported GROUP BY query_id
""")
def sse_emit(spark, d):
    events = emit_events(answers(spark, d))
    return events.groupBy("stream_id", "event").agg(F.count(F.lit(1)).alias("n"))


def answer_events(spark, d):
    """Answers on the wire, cut, parsed and dispatched again."""
    frames = emit_events(answers(spark, d)).select("stream_id", "seq", wire_text("event", "data").alias("wire"))
    return stage(dispatch(tokenize(stage(cut_stream(frames, 997), "wire"))), "dispatched")


@query("sse_fold", f"""{EMIT_SQL}
SELECT query_id AS stream_id, '' AS summary,
       (SELECT count(*) FROM reranked r WHERE r.query_id = a.query_id) AS n_sources,
       (SELECT count(*) FROM supported s WHERE s.query_id = a.query_id) AS n_code, true AS is_done FROM asked a
""")
def sse_fold(spark, d):
    return fold_state(answer_events(spark, d)).select("stream_id", "summary", "n_sources", "n_code", "is_done")


@query("sse_sources", f"""{EMIT_SQL}
SELECT query_id AS stream_id, (rank - 1)::INT AS pos, source_type AS type, coalesce(ref, url) AS ref, round(score, 6) AS score
FROM reranked SEMI JOIN asked USING (query_id)
""")
def sse_sources(spark, d):
    shown = fold_sources(answer_events(spark, d))
    return shown.select("stream_id", "pos", "type", F.coalesce("ref", "url").alias("ref"), F.round("score", 6).alias("score"))
