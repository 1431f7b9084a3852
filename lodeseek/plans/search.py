"""Federated search for a batch of requests, and the service health row."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeseek.config import DEFAULTS, FALLBACK_PROVIDER, Tunables
from lodeseek.functions.vectors import Embedder, embed_text
from lodeseek.operators import answer as A
from lodeseek.operators.filters import valid_request
from lodeseek.operators.fusion import hybrid_retrieve
from lodeseek.operators.graph_build import PropertyGraph
from lodeseek.operators.graph_search import graph_retrieve, select_mode
from lodeseek.operators.manifest import normalized_hint
from lodeseek.operators.routing import analyzed, planned_providers, resolve_provider, used_models
from lodeseek.runtime import ship_package, stage

WEB = "query_id string, rank int, title string, url string, snippet string, text string, score double, fetched_at string"
VIDEO = "query_id string, rank int, title string, url string, transcript string, score double, fetched_at string"


@dataclass(frozen=True)
class Sources:
    """What a search reads: two corpora and two acquisition plans ``queries -> hits``."""

    code: DataFrame | None = None            # chunk_id, document, embedding and chunk metadata
    graph: PropertyGraph | None = None
    web: Callable[[DataFrame], DataFrame] | None = None
    video: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Hooks:
    """Model-backed steps; each has an offline default."""

    embedder: Embedder | None = None
    rewriter: Callable | None = None
    scorer: Callable | None = None
    summarizer: Callable | None = None
    examples: Callable[[DataFrame], DataFrame] | None = None
    models: Mapping[str, str] | None = None
    available: Mapping[str, bool] | None = None


def _empty(spark, schema):
    return spark.createDataFrame([], schema)


def _code_hits(spark, sources: Sources, asked: DataFrame, cfg: Tunables) -> DataFrame:
    names = ("path", "symbol", "signature", "lang", "start_line", "end_line")
    if sources.code is None or sources.code.isEmpty():
        return _empty(spark, "query_id string, chunk_id string, text string, path string, symbol string, "
                             "signature string, lang string, start_line int, end_line int, score double, rank int")
    corpus = sources.code.withColumnRenamed("document", "text")
    return hybrid_retrieve(corpus, asked, doc_id="chunk_id", carry=names, cfg=cfg)


def search(spark: SparkSession, requests: DataFrame, sources: Sources, hooks: Hooks = Hooks(),
           cfg: Tunables = DEFAULTS) -> DataFrame:
    """One answer row per valid (query_id, query, llm) request.

    The four sources are independent branches of one plan; a source that is absent
    or empty for a query is listed as missing, and a query nothing answered gets one
    more web attempt.
    """
    ship_package(spark)
    wanted = requests.withColumn("query_id", F.col("query_id").cast("string")).withColumn("llm", normalized_hint("llm"))
    wanted = wanted.where(valid_request("query", "llm"))
    rewritten = analyzed(wanted, hooks.rewriter).withColumn("mode", select_mode("query"))
    asked = stage(rewritten.withColumn("embedding", embed_text("rewritten_query", hooks.embedder)), "asked")
    probes = asked.select("query_id", F.col("rewritten_query").alias("query"), "embedding", "mode")

    code = stage(_code_hits(spark, sources, probes, cfg), "code-hits")
    if sources.graph is None:
        entities = _empty(spark, "query_id string, rank int, id string, name string, description string, score double")
        chunks = _empty(spark, "query_id string, rank int, chunk_id string, text string")
    else:
        hits = graph_retrieve(sources.graph, probes, cfg)
        entities = stage(hits.entities.withColumn("rank", F.col("rank") - 1), "entity-hits")
        chunks = stage(hits.chunks.select("query_id", "rank", "chunk_id", "text"), "chunk-hits")
    web = stage(sources.web(probes), "web-hits") if sources.web else _empty(spark, WEB)
    video = stage(sources.video(probes), "video-hits") if sources.video else _empty(spark, VIDEO)

    called = lambda w: A.reached(asked, {
        "code": [code], "textbook": [entities, chunks], "web": [w], "youtube": [video]})
    if sources.web:
        flags = stage(called(web), "flags")
        unanswered = probes.join(flags.where(~(F.col("has_code") | F.col("has_textbook") | F.col("has_web")
                                               | F.col("has_youtube"))), "query_id", "left_semi")
        if not unanswered.isEmpty():
            web = stage(A.web_fallback(web, sources.web(unanswered), flags), "web-hits")
    reranked = stage(A.rerank(A.merge_candidates(code, entities, web, video, cfg), hooks.scorer, asked, cfg), "reranked")
    context = A.add_textbook_tail(A.build_context(reranked, cfg), chunks, cfg)
    summaries = A.apply_summarizer(
        asked.select("query_id", "query").join(context, "query_id", "left")
        .withColumn("context", F.coalesce("context", F.lit(""))), hooks.summarizer)
    proposed = (hooks.examples or A.verbatim_examples)(code)
    examples = A.supported_examples(proposed, code, cfg)
    models = hooks.models or {}
    plan = planned_providers("llm")
    keys = hooks.available or {FALLBACK_PROVIDER: True}
    queries = asked.select("query_id", "query", "llm").withColumn("_s", resolve_provider(F.lit("summary"), "llm", keys))
    queries = queries.withColumn("_c", resolve_provider(F.lit("code"), "llm", keys)).withColumn(
        "_s", F.coalesce("_s", plan["summary"])).withColumn("_c", F.coalesce("_c", plan["code"]))
    return A.assemble_answers(queries, summaries, examples, reranked, A.missing_sources(called(web)),
                              used_models("_s", "_c", models))


def health(spark: SparkSession, sources: Sources, keys: Mapping[str, bool]) -> DataFrame:
    """One row: status, chunk and graph counts, keys; any failing part makes it ``degraded``."""
    status, chunks, counts = "ok", None, {}
    try:
        chunks = sources.code.count()
    except Exception:  # noqa: BLE001 - a health check reports faults
        status = "degraded"
    try:
        counts = {n: getattr(sources.graph, n).count() for n in ("entities", "documents", "communities")}
    except Exception:  # noqa: BLE001
        status = "degraded"
    row = (status, chunks, *(counts.get(n) for n in ("entities", "documents", "communities")), dict(keys))
    return spark.createDataFrame(
        [row], "status string, code_chunks long, entities long, documents long, communities long, "
               "providers map<string,boolean>")
