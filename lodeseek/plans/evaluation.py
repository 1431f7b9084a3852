"""Evaluate a retriever on a labelled set: samples, nDCG, judged metrics, report."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.functions.vectors import Embedder, embed_text
from lodeseek.operators import answer as A
from lodeseek.operators.evaluate import graph_context, hit_context, judge, mean_ndcg, metric_means, ndcg, ndcg_by_type
from lodeseek.operators.fusion import hybrid_retrieve
from lodeseek.operators.graph_build import PropertyGraph
from lodeseek.operators.graph_search import graph_retrieve, select_mode
from lodeseek.runtime import ship_package, stage


def _asked(items: DataFrame, embedder: Embedder | None) -> DataFrame:
    asked = items.select(F.col("id").alias("query_id"), "query").withColumn("mode", select_mode("query"))
    return stage(asked.withColumn("embedding", embed_text("query", embedder)), "asked")


def code_contexts(corpus: DataFrame, embedder: Embedder | None = None, cfg: Tunables = DEFAULTS) -> Callable:
    """Retrieval step over a chunk table: items -> (query_id, contexts, chunk ids)."""
    return lambda items: hit_context(hybrid_retrieve(
        corpus.withColumnRenamed("document", "text"), _asked(items, embedder), cfg.eval_top_k,
        doc_id="chunk_id", carry=("signature",), cfg=cfg), cfg)


def graph_contexts(graph: PropertyGraph, embedder: Embedder | None = None, cfg: Tunables = DEFAULTS) -> Callable:
    """Retrieval step over a property graph."""
    def run(items: DataFrame) -> DataFrame:
        hits = graph_retrieve(graph, _asked(items, embedder), cfg)
        return graph_context(hits.chunks, hits.communities, cfg)

    return run


def build_samples(spark: SparkSession, items: DataFrame, kind: str, retrieve: Callable, summarizer=None,
                  cfg: Tunables = DEFAULTS) -> DataFrame:
    """One row per item: contexts, retrieved ids, response, reference, ndcg (NaN without ground truth)."""
    ship_package(spark)
    found = stage(retrieve(items), "contexts")
    base = items.withColumnRenamed("id", "query_id").join(found, "query_id", "left")
    answers = A.apply_summarizer(base.select("query_id", "query", F.coalesce("context_text", F.lit("")).alias("context")),
                                 summarizer)
    ranked = found.select("query_id", F.posexplode("retrieved_chunk_ids").alias("rank", "id"))
    truth = items.select(F.col("id").alias("query_id"), F.explode("gt_chunk_ids").alias("id"))
    scores = ndcg(items.select(F.col("id").alias("query_id")), ranked, truth, cfg.eval_top_k)
    strings = F.array().cast("array<string>")
    return base.join(answers, "query_id").join(scores, "query_id").select(
        F.col("query_id").alias("id"), F.lit(kind).alias("kind"), "type", F.col("query").alias("user_input"),
        F.coalesce("retrieved_contexts", strings).alias("retrieved_contexts"),
        F.coalesce("retrieved_chunk_ids", strings).alias("retrieved_chunk_ids"),
        F.coalesce("summary", F.lit("")).alias("response"),
        F.coalesce("expected_answer", F.lit("")).alias("reference"),
        F.array_distinct(F.coalesce("gt_chunk_ids", strings)).alias("gt_chunk_ids"), "ndcg")


def evaluate(spark: SparkSession, items: DataFrame, kind: str, retrieve: Callable, samples_path: str, *,
             judges: dict | None = None, summarizer=None, limit: int | None = None,
             cfg: Tunables = DEFAULTS) -> dict[str, DataFrame]:
    """Write the samples as JSON Lines; returns the frames overall, by_type and metrics."""
    items = items.orderBy("id").limit(limit) if limit else items
    samples = stage(judge(build_samples(spark, items, kind, retrieve, summarizer, cfg), judges or {}), "samples")
    samples.write.mode("append").json(samples_path)
    overall = mean_ndcg(samples).withColumn("dataset", F.lit(kind)).withColumn("n", F.lit(samples.count()))
    out = {"overall": overall, "by_type": ndcg_by_type(samples)}
    if judges:
        out["metrics"] = metric_means(samples, list(judges))
    return out
