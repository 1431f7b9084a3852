"""Ranking quality: nDCG, context precision and recall, group means."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.functions.text import blank_to_null, head
from lodeseek.operators.ordered import top_k


def ideal_gain(relevant, k: int) -> Column:
    """DCG of ``min(relevant, k)`` hits at the top."""
    n = F.least(relevant, F.lit(k)).cast("int")
    terms = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i <= n, 1 / F.log2(i + 1)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def judged(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``rel`` (1.0 or 0.0) to (query_id, rank, id); truth is (query_id, id)."""
    hits = truth.select("query_id", "id").distinct().withColumn("_hit", F.lit(1.0))
    return ranked.join(hits, ["query_id", "id"], "left").withColumn("rel", F.coalesce("_hit", F.lit(0.0))).drop("_hit")


def ndcg(queries: DataFrame, ranked: DataFrame, truth: DataFrame, k: int = DEFAULTS.eval_top_k) -> DataFrame:
    """(query columns, ndcg): binary gain, log2 discount, NaN without ground truth.

    ``rank`` is 0-based. Only the first ``k`` rows per query are joined and the truth
    is only counted per query, so a large truth set never lands in one row.
    """
    few = judged(ranked.where(F.col("rank") < k), truth)
    gained = few.groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 2)).alias("dcg"))
    counts = truth.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    value = F.when(F.col("relevant").isNull(), F.lit(float("nan"))).otherwise(
        F.coalesce("dcg", F.lit(0.0)) / ideal_gain(F.col("relevant"), k))
    both = queries.join(counts, "query_id", "left").join(gained, "query_id", "left")
    return both.select(*queries.columns, value.alias("ndcg"))


def _known(metric: str) -> Column:
    return F.nanvl(F.col(metric), F.lit(None).cast("double"))


def mean_ndcg(samples: DataFrame) -> DataFrame:
    """One row: mean over samples with ground truth (null when none) and their number."""
    return samples.agg(F.avg(_known("ndcg")).alias("mean_ndcg"), F.count(_known("ndcg")).alias("n_with_gt"))


def ndcg_by_type(samples: DataFrame) -> DataFrame:
    """(type, mean_ndcg, n) over samples with ground truth; no type counts as ``?``."""
    return samples.where(~F.isnan("ndcg")).groupBy(
        F.coalesce(blank_to_null("type"), F.lit("?")).alias("type")
    ).agg(F.avg("ndcg").alias("mean_ndcg"), F.count(F.lit(1)).alias("n"))


def metric_means(samples: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each judged metric, NaN skipped."""
    return samples.agg(*(F.avg(_known(m)).alias(m) for m in metrics))


def context_scores(ranked: DataFrame, truth: DataFrame, k: int = DEFAULTS.eval_top_k) -> DataFrame:
    """(query_id, context_precision, context_recall) by id, for queries with ground truth.

    Recall is the share of the truth retrieved; precision averages precision at each
    relevant rank. Ranks are 0-based; sums run over at most ``k`` rows per query.
    """
    few = judged(ranked.where(F.col("rank") < k), truth)
    hits = F.array_sort(F.collect_list(F.when(F.col("rel") > 0, F.col("rank"))))
    rows = few.groupBy("query_id").agg(hits.alias("hits"))
    precision = F.aggregate(
        F.transform("hits", lambda r, i: (i + 1) / (r + 1)), F.lit(0.0), lambda acc, v: acc + v) / F.size("hits")
    counts = truth.select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    found = F.coalesce(F.size("hits"), F.lit(0))
    return counts.join(rows, "query_id", "left").select(
        "query_id", F.when(found > 0, precision).otherwise(0.0).alias("context_precision"),
        (found / F.col("relevant")).alias("context_recall"))


def hit_context(hits: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, contexts, chunk_ids, context_text) of code hits for one evaluation."""
    body = F.concat(F.coalesce("signature", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return _contexts(hits.select("query_id", F.lit(0).alias("part"), "rank", "chunk_id", body.alias("body")), cfg)


def graph_context(chunks: DataFrame, communities: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """The same for graph hits: chunk texts, then the first community summaries; ranks 1-based."""
    texts = chunks.select("query_id", F.lit(0).alias("part"), (F.col("rank") - 1).alias("rank"), "chunk_id", F.col("text").alias("body"))
    notes = top_k(communities, ["query_id"], [F.col("rank")], cfg.eval_communities, "_n").select(
        "query_id", F.lit(1).alias("part"), F.col("_n").alias("rank"), F.lit(None).cast("string").alias("chunk_id"),
        F.col("summary").alias("body"))
    return _contexts(texts.unionByName(notes), cfg, cfg.eval_top_k + cfg.eval_communities)


def _contexts(rows: DataFrame, cfg: Tunables, limit: int | None = None) -> DataFrame:
    gathered = rows.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "rank", "chunk_id", "body"))).alias("_r"))
    bodies = F.transform("_r", lambda r: r["body"])
    bodies = F.slice(bodies, 1, limit) if limit else bodies
    shown = F.slice(bodies, 1, cfg.eval_context_k)
    lines = F.transform(shown, lambda b, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] "), head(b, cfg.context_chars)))
    return gathered.select(
        "query_id", shown.alias("retrieved_contexts"),
        F.filter(F.transform("_r", lambda r: r["chunk_id"]), lambda c: c.isNotNull()).alias("retrieved_chunk_ids"),
        F.array_join(lines, "\n\n").alias("context_text"))


def judge(samples: DataFrame, judges: dict) -> DataFrame:
    """Add one column per plugged-in ``(question, contexts, response, reference) -> score``; a failure is NaN."""
    def column(call):
        @F.pandas_udf("double")
        def run(q: pd.Series, c: pd.Series, a: pd.Series, r: pd.Series) -> pd.Series:
            def one(*args):
                try:
                    return float(call(*args))
                except Exception:  # noqa: BLE001 - nDCG is still reported when a judge fails
                    return float("nan")

            return pd.Series([one(*row) for row in zip(q, c, a, r)], dtype="float64")

        return run("user_input", "retrieved_contexts", "response", "reference")

    return samples.select("*", *(column(call).alias(name) for name, call in judges.items()))
