"""Event streams: emit, tokenize, dispatch, fold, and the live operator."""

import json

import pytest
from pyspark.sql import functions as F

from lodeseek.streaming import events as V
from lodeseek.streaming.live import emit_batches, advance, tokenize_stream

CHUNK = "stream_id string, seq long, chunk string"

CASES = {
    "single": (["event: summary\ndata: {\"a\":1}\n\n"], [("summary", '{"a":1}')]),
    "several": (["event: a\ndata: 1\n\nevent: b\ndata: 2\n\n"], [("a", "1"), ("b", "2")]),
    "inside an event": (["event: a\nda", "ta: 1\n\n"], [("a", "1")]),
    "inside the blank line": (["event: a\ndata: 1\n", "\n"], [("a", "1")]),
    "no name": (["data: x\n\n"], [("message", "x")]),
    "CRLF": (["event: a\r\ndata: 1\r\n\r\n"], [("a", "1")]),
    "CRLF cut in two": (["event: a\r", "\ndata: 1\r", "\n", "\r", "\n"], [("a", "1")]),
    "CR only": (["event: a\rdata: 1\r\r"], [("a", "1")]),
    "multi-line data": (["data: 1\ndata: 2\n\n"], [("message", "1\n2")]),
    "no data": (["event: a\n\ndata: 1\n\n"], [("message", "1")]),
    "blank data": (["event: a\ndata:\n\n"], [("a", "")]),
    "other fields": (["id: 7\nretry: 1\n: note\ndata:x\n\n"], [("message", "x")]),
    "last name wins": (["event: a\nevent: b\ndata: 1\n\n"], [("b", "1")]),
    "open event": (["event: a\ndata: 1\n\nevent: b\ndata: 2\n"], [("a", "1")]),
    "open line": (["data: 1\n\ndata: 2"], [("message", "1")]),
    "empty pieces": (["", "data: 1", "", "\n\n", ""], [("message", "1")]),
}


@pytest.mark.parametrize("rows", [None, 5_000_000])
def test_tokenize_cases(spark, rows, monkeypatch):
    if rows:  # force the sliced plan for every running count
        monkeypatch.setattr(V, "running_total", lambda df, keys, order, value, out, group_rows=None: __import__(
            "lodeseek.operators.ordered", fromlist=["x"]).running_total(df, keys, order, value, out, limit=3))
    data = [(name, n, c) for name, (pieces, _) in CASES.items() for n, c in enumerate(pieces)]
    got = V.tokenize(spark.createDataFrame(data, CHUNK)).orderBy("stream_id", "event_no").collect()
    found = {name: [(r["event"], r["data"]) for r in got if r["stream_id"] == name] for name in CASES}
    assert found == {name: expected for name, (_, expected) in CASES.items()}


@pytest.mark.parametrize("name", CASES)
def test_feed_cases(name):
    pieces, expected = CASES[name]
    state, out = ("", 0, False), []
    for piece in pieces:
        state, closed = advance(*state, piece)
        out += [(e, d) for _, e, d in closed]
    assert out == expected


def wire(spark, rows):
    return spark.createDataFrame([("s", n, e, d) for n, (e, d) in enumerate(rows)], "stream_id string, event_no long, event string, data string")


def test_dispatch(spark):
    rows = [("summary", '{"summary": "s"}'), ("source", "{bad"), ("ping", '{"x": 1}'), ("error", '{"error": "boom"}'), ("code", "")]
    got = V.dispatch(wire(spark, rows)).orderBy("event_no").collect()
    assert [r["kind"] for r in got] == ["summary", "error", None, "error", "error"]
    assert got[1]["error"] == "SSE 데이터 파싱 실패: {bad" and got[3]["error"] == "boom" and got[0]["payload"]["summary"] == "s"


PARTIAL = [("missing", '{"missing_sources": ["web"]}'), ("source", '{"type": "code", "ref": "r", "score": 0.5}'),
           ("source", '{"type": "web", "url": "u", "score": 0.9}'), ("summary", '{"summary": "first"}'), ("summary", '{"summary": "second"}'),
           ("code", '{"lang": "py", "code": "c", "explain": "", "source": "r"}')]
DONE = {"query": "q", "summary": "final", "code_examples": [], "missing_sources": [], "used_models": {"summary": "m"},
        "sources": [{"type": "textbook", "ref": "ent_x", "score": 0.7}]}


def test_fold_partial_done_and_error(spark):
    part = V.fold_state(V.dispatch(wire(spark, PARTIAL))).first()
    assert (part["summary"], part["missing_sources"], part["n_sources"], part["n_code"], part["is_done"]) == ("second", "web", 2, 1, False)
    done = V.dispatch(wire(spark, PARTIAL + [("done", json.dumps(DONE))]))
    state = V.fold_state(done).first()
    assert (state["summary"], state["missing_sources"], state["n_sources"], state["n_code"], state["is_done"]) == ("final", "", 1, 0, True)
    assert state["used_models"] == {"summary": "m"} and [r["ref"] for r in V.fold_sources(done).collect()] == ["ent_x"]
    broken = V.dispatch(wire(spark, PARTIAL[:4] + [("error", '{"error": "late"}')]))
    failed = V.fold_state(broken).first()
    assert (failed["error"], failed["summary"], failed["n_sources"]) == ("late", "first", 2)
    assert [r["type"] for r in V.fold_sources(broken).orderBy("event_no").collect()] == ["code", "web"]


ANSWER = (f"query_id string, query string, summary string, code_examples array<{V.CODE}>, sources array<{V.SOURCE}>, "
          "missing_sources array<string>, used_models map<string,string>")


def answers(spark):
    return spark.createDataFrame([("a", "질문", "요약", [("py", "x = 1", "e", "s")], [("code", "r", "", .5, None), ("web", None, "u", .4, "t")],
                                   ["youtube"], {"summary": "m"})], ANSWER)


def test_emit_order_and_payloads(spark):
    got = V.emit_events(answers(spark)).orderBy("seq").collect()
    assert [r["event"] for r in got] == ["missing", "source", "source", "summary", "code", "done"]
    assert json.loads(got[0]["data"]) == {"missing_sources": ["youtube"]}
    assert json.loads(got[1]["data"]) == {"type": "code", "score": 0.5, "ref": "r"}
    assert json.loads(got[2]["data"]) == {"type": "web", "score": 0.4, "url": "u", "fetched_at": "t"}
    assert '"요약"' in got[3]["data"] and set(json.loads(got[5]["data"])) == {
        "query", "summary", "code_examples", "sources", "missing_sources", "used_models"}


def test_live_tokenizer(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "cp")
    for n, rows in enumerate([[("s", 0, "event: a\r"), ("t", 0, "data: 1\n")], [("s", 1, "\ndata: 1\r\n\r\nda"), ("t", 1, "\n")], [("s", 2, "ta: 2\n\n")]]):
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).json(str(source))
    query = tokenize_stream(stream).writeStream.format("memory").queryName("live_events").outputMode("append").option(
        "checkpointLocation", out).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = {tuple(r) for r in spark.table("live_events").collect()}
    assert got == {("s", 0, "a", "1"), ("s", 1, "message", "2"), ("t", 0, "message", "1")}


def test_live_emit(spark, tmp_path):
    source = str(tmp_path / "answers")
    answers(spark).write.json(source)
    seen = []
    query = emit_batches(spark.readStream.schema(ANSWER).json(source), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 6
