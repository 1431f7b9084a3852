"""Merge, rerank, context, evidence, routing and whole answers."""

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.vectors import embed_text
from lodeseek.operators import answer as A
from lodeseek.operators.routing import Providers, analyzed, planned_providers, resolve_provider, used_models
from lodeseek.plans.search import Hooks, Sources, health, search
from lodeseek.runtime import stage
from lodeseek.sources.tables import CHUNK_TABLE
from tests.test_graph import retrieval_graph

WEB = "query_id string, rank int, title string, url string, snippet string, text string, score double, fetched_at string"
VIDEO = "query_id string, rank int, title string, url string, transcript string, score double, fetched_at string"


def four(spark):
    code = spark.createDataFrame([("q", 0, "p#f#1", "def f()", "body" * 300, "python"), ("q", 3, "p#g#9", None, None, "python")],
                                 "query_id string, rank int, chunk_id string, signature string, text string, lang string")
    ents = spark.createDataFrame([("q", 0, "ent_a", "A", None, 0.87654)],
                                 "query_id string, rank int, id string, name string, description string, score double")
    web = spark.createDataFrame([("q", 0, "T", "http://u", "snip", "", 1.0, "t0")], WEB)
    video = spark.createDataFrame([("q", 0, "V", "https://youtu.be/v", "words", .5, "t0")], VIDEO)
    return code, ents, web, video


def test_merge_contract(spark):
    rows = A.merge_candidates(*four(spark)).orderBy("pos").collect()
    assert [r["source_type"] for r in rows] == ["code", "code", "textbook", "web", "youtube"]
    assert [r["score"] for r in rows] == [1.0, 0.7, 0.8765, 1.0, 0.5]
    assert rows[0]["rerank_text"] == "def f()\n" + ("body" * 300)[:600] and rows[1]["rerank_text"] == "\n"
    assert rows[2]["rerank_text"] == "A: " and rows[3]["rerank_text"] == "T\nsnip"
    assert rows[0]["ref"] == "p#f#1" and rows[0]["url"] is None and rows[3]["ref"] is None and rows[4]["url"].endswith("/v")


def candidates(spark, scores):
    rows = [("q", n, "code", f"r{n}", None, None, f"text {n}", s) for n, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id string, pos long, source_type string, ref string, url string, fetched_at string, rerank_text string, score double")


def test_rerank_fallback_is_stable_and_cut(spark):
    assert [r["ref"] for r in A.rerank(candidates(spark, [.2, .9, .5])).orderBy("rank").collect()] == ["r1", "r2", "r0"]
    many = A.rerank(candidates(spark, [.5] * 10)).orderBy("rank").collect()
    assert [r["ref"] for r in many] == [f"r{n}" for n in range(8)]
    assert A.rerank(candidates(spark, [.5]).limit(0)).count() == 0


def test_rerank_with_scorer(spark):
    asked = spark.createDataFrame([("q", "text 2")], "query_id string, query string")
    got = A.rerank(candidates(spark, [.2, .9, .5]), lambda q, t: [0.123456 if a == b else 0.0 for a, b in zip(q, t)], asked)
    first = got.where("rank = 1").first()
    assert first["ref"] == "r2" and first["score"] == 0.1235


def test_context_and_tail(spark):
    reranked = A.rerank(candidates(spark, [.9, .8])).withColumn("rerank_text", F.lit(" a\nb "))
    context = A.build_context(reranked)
    assert context.first()["context"] == "[1] (code:r0) a b\n[2] (code:r1) a b"
    chunks = spark.createDataFrame([("q", n, f"chunk_{n}", "x" * 500) for n in range(1, 7)] + [("only", 1, "c", "t")],
                                   "query_id string, rank int, chunk_id string, text string")
    out = {r["query_id"]: r["context"] for r in A.add_textbook_tail(context, chunks).collect()}
    assert out["q"].count("[교재청크") == 4 and "x" * 401 not in out["q"] and out["only"] == "\n[교재청크 c] t"


def test_evidence_drops_invented_sources(spark):
    code = four(spark)[0]
    rows = [("q", n, "py", "c", "e", s) for n, s in enumerate(["fake#g#9", "p#f#1", "p#g#9", "p#f#1", "p#f#1"])]
    examples = spark.createDataFrame(rows, "query_id string, ord int, lang string, code string, explain string, source string")
    kept = A.supported_examples(examples, code).orderBy("rank").collect()
    assert [r["source"] for r in kept] == ["p#f#1", "p#g#9", "p#f#1"]


def test_missing_and_called(spark):
    code, ents, web, video = four(spark)
    asked = spark.createDataFrame([("q", "x"), ("other", "y")], "query_id string, query string")
    flags = A.reached(asked, {"code": [code], "textbook": [ents.limit(0), ents], "web": [web], "youtube": [video.limit(0)]})
    got = {r["query_id"]: r["missing_sources"] for r in A.missing_sources(flags).collect()}
    assert got == {"q": ["youtube"], "other": ["code", "textbook", "web", "youtube"]}
    called = spark.createDataFrame([(["web", "code", "youtube", "textbook"],), (["web"],)], "c array<string>")
    assert [r[0] for r in called.select(A.all_called("c")).collect()] == [True, False]


def test_provider_rules(spark):
    df = spark.createDataFrame([("summary", None), ("code", None), ("code", "gemini"), ("summary", "bogus"), ("odd", None)], "t string, h string")
    keys = {"groq": True, "openai": True, "claude": True, "gemini": False}
    assert [r[0] for r in df.select(resolve_provider("t", "h", keys)).collect()] == ["openai", "claude", "groq", "openai", "openai"]
    assert df.select(resolve_provider("t", "h", {"groq": False})).first()[0] is None
    plan = df.select(planned_providers("h").alias("p")).collect()
    assert tuple(plan[0]["p"]) == ("openai", "claude") and tuple(plan[2]["p"]) == ("gemini", "gemini")
    models = spark.range(1).select(used_models(F.lit("groq"), F.lit("claude"), {"groq": "g", "claude": "c"})).first()[0]
    assert models == {"routing": "groq/g", "summary": "groq/g", "code_synthesis": "claude/c"}


def test_provider_calls_fall_back(spark):
    def boom(text):
        raise RuntimeError

    df = spark.createDataFrame([("hi", "openai"), ("hi", "claude"), ("hi", "gone")], "p string, who string")
    got = Providers({"openai": boom, "claude": str.upper, "groq": lambda t: "g:" + t}).invoke(df, "p", "who").collect()
    assert [(r["output"], r["used"]) for r in got] == [("g:hi", "groq"), ("HI", "claude"), ("g:hi", "groq")]
    none = Providers({"openai": boom}).invoke(df.limit(1), "p", "who").first()
    assert (none["output"], none["used"]) == (None, "openai")
    with pytest.raises(ValueError):
        Providers({}).build("x")


def test_rewrite(spark):
    df = spark.createDataFrame([("good",), ("blank",), ("bad",)], "query string")

    def rewriter(q):
        if q == "bad":
            raise RuntimeError
        return (" better " if q == "good" else " "), ["hyde", "unknown"]

    got = {r["query"]: (r["rewritten_query"], r["techniques"]) for r in analyzed(df, rewriter).collect()}
    assert got == {"good": ("better", ["hyde"]), "blank": ("blank", ["hyde"]), "bad": ("bad", [])}


def test_presentation(spark):
    df = spark.createDataFrame([("web", None, "http://u", .876), ("code", "r", "", .995), ("odd", None, None, 0.0)],
                               "source_type string, ref string, url string, score double")
    got = A.shown_source(df).collect()
    assert [(r["display_ref"], r["linkable"], r["label"], r["percent"]) for r in got] == [
        ("http://u", True, "웹", 88), ("r", False, "코드", 100), ("-", False, "odd", 0)]
    flags = spark.createDataFrame([("", 0, 0), ("s", 0, 0), (None, 0, 1)], "s string, c int, n int")
    assert [r[0] for r in flags.select(A.has_results("s", "c", "n")).collect()] == [False, True, True]


def test_search_end_to_end(spark):
    rows = [(f"f{n}.py#fn{n}#1", f"f{n}.py", "python", f"fn{n}", f"def fn{n}()", 1, 2, "t", f"graph topic{n} state") for n in range(12)]
    names = [f.name for f in CHUNK_TABLE][:-1]
    code = stage(spark.createDataFrame(rows, names).withColumn("embedding", embed_text("document"))
                 .withColumn("start_line", F.col("start_line").cast("int")).withColumn("end_line", F.col("end_line").cast("int")))
    asked = spark.createDataFrame([(1, "topic3", None), (2, "차이 topic4", "gemini"), (3, "", None), (4, "x", "bad"), (5, "topic5", "auto")],
                                  "query_id long, query string, llm string")
    import numpy as np

    def embed4(texts):
        return np.ones((len(texts), 4))

    def web(queries):
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit("T").alias("title"), F.lit("http://w").alias("url"),
                              F.lit("s").alias("snippet"), F.lit("body").alias("text"), F.lit(1.0).alias("score"), F.lit("t0").alias("fetched_at"))

    only_code = {r["query_id"]: r for r in search(spark, asked, Sources(code=code, web=web)).collect()}
    assert sorted(only_code) == ["1", "2", "5"]
    first = only_code["1"]
    assert set(first.asDict()) == {"query_id", "query", "summary", "code_examples", "sources", "missing_sources", "used_models"}
    assert first["missing_sources"] == ["textbook", "youtube"] and len(first["code_examples"]) == 3
    assert "f3.py#fn3#1" in {e["source"] for e in first["code_examples"]} and first["sources"][0]["type"] == "code"
    assert {s["type"] for s in first["sources"]} == {"code", "web"}
    graph = search(spark, asked.where("query_id = 2"), Sources(graph=retrieval_graph(spark)),
                   Hooks(embedder=embed4, summarizer=lambda q, c: f"about {q}", models={"groq": "g"})).first()
    assert graph["summary"] == "about 차이 topic4" and graph["missing_sources"] == ["code", "web", "youtube"]
    assert graph["sources"][0]["type"] == "textbook" and graph["used_models"]["summary"] == "groq/g"


def test_unanswered_queries_get_one_more_web_try(spark):
    calls = []

    def web(queries):
        calls.append(1)
        hits = queries.where(F.lit(len(calls) > 1))
        return hits.select("query_id", F.lit(0).alias("rank"), F.lit("T").alias("title"), F.lit("http://w").alias("url"),
                           F.lit("s").alias("snippet"), F.lit("b").alias("text"), F.lit(1.0).alias("score"), F.lit("t").alias("fetched_at"))

    asked = spark.createDataFrame([(1, "q", None)], "query_id long, query string, llm string")
    row = search(spark, asked, Sources(web=web)).first()
    assert len(calls) == 2 and [s["type"] for s in row["sources"]] == ["web"] and row["missing_sources"] == ["code", "textbook", "youtube"]


def test_health(spark):
    ok = health(spark, Sources(code=spark.range(3), graph=retrieval_graph(spark)), {"groq": True}).first()
    assert (ok["status"], ok["code_chunks"], ok["entities"], ok["providers"]) == ("ok", 3, 4, {"groq": True})
    assert health(spark, Sources(code=spark.range(3)), {}).first()["status"] == "degraded"
