"""Weighted reciprocal-rank fusion and the hybrid retriever built on it."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.operators.bm25 import bm25_topk
from lodeseek.operators.bounded import staged_hint
from lodeseek.operators.ordered import top_k
from lodeseek.operators.vector import mmr_topk
from lodeseek.runtime import stage
from lodeseek.sources.keyword_index import KeywordIndex


def rank_fusion(
    lists: Sequence[tuple[DataFrame, float]],
    k: int | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    cfg: Tunables = DEFAULTS,
) -> DataFrame:
    """(query_id, doc_id, text, score, rank): sum of ``w / (60 + rank)`` per document text.

    Input lists have query_id, ``doc_id``, ``text`` and a 1-based rank. Copies of one
    text are one candidate, shown under the id seen first (earlier list, better
    rank); equal scores keep that order too. ``rank`` of the result is 0-based.
    """
    tagged = [
        df.select("query_id", doc_id, text, "rank", F.lit(position).alias("list"), F.lit(float(weight)).alias("weight"))
        for position, (df, weight) in enumerate(lists)
    ]
    seen = F.struct("list", "rank", doc_id)
    fused = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("query_id", text)
        .agg(
            F.sum(F.col("weight") / (cfg.fusion_offset + F.col("rank"))).alias("score"),
            F.min(seen).alias("seen"),
        )
        .select("query_id", F.col(f"seen.{doc_id}").alias(doc_id), text, "score", "seen")
    )
    order = [F.round("score", 12).desc(), F.col("seen")]
    ranked = top_k(fused, ["query_id"], order, k or cfg.bm25_k + cfg.vector_k)
    return ranked.select("query_id", doc_id, text, "score", (F.col("rank") - 1).alias("rank"))


def hybrid_retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    top_k_hits: int | None = None,
    *,
    vectors: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    embedding: str = "embedding",
    carry: Sequence[str] = (),
    index: KeywordIndex | None = None,
    cfg: Tunables = DEFAULTS,
) -> DataFrame:
    """(query_id, doc_id, text, *carry, score, rank): keyword and vector lists, fused.

    ``queries`` has query_id, query and embedding. ``vectors`` (doc_id, embedding) may
    come from another table than the texts; without it the corpus holds them. ``index`` is the
    corpus's keyword index; without it one is made. The pool is at most
    ``bm25_k + vector_k`` documents whatever ``top_k_hits`` says. An empty corpus
    is an error.
    """
    if corpus.isEmpty():
        raise ValueError("the corpus is empty: build the index first")
    words_list = bm25_topk(corpus, queries, cfg.bm25_k, index, doc_id=doc_id, text=text, cfg=cfg)
    vector_list = mmr_topk(corpus if vectors is None else vectors, queries, vec_id=doc_id, embedding=embedding, cfg=cfg)
    both, hint = staged_hint(
        words_list.select("query_id", doc_id, "rank", F.lit(0).alias("list")).unionByName(
            vector_list.select("query_id", doc_id, "rank", F.lit(1).alias("list"))
        ),
        label="candidates",
    )
    candidates = stage(corpus.select(doc_id, *dict.fromkeys([text, *carry])).join(hint(both), doc_id), "candidate-texts")
    fused = rank_fusion(
        [(candidates.where(F.col("list") == 0), cfg.bm25_weight),
         (candidates.where(F.col("list") == 1), cfg.vector_weight)],
        top_k_hits or cfg.vector_k, doc_id=doc_id, text=text, cfg=cfg,
    )
    if not carry:
        return fused
    shown = candidates.select(doc_id, *carry).dropDuplicates([doc_id])
    return fused.join(hint(shown), doc_id).select("query_id", doc_id, text, *carry, "score", "rank")
