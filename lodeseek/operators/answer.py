"""Federated search: merge four sources, rerank, check evidence, assemble answers."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodeseek.config import DEFAULTS, SOURCE_TYPES, Tunables
from lodeseek.functions.text import blank_to_null, col_of, flatten_newlines, head, percent, py_strip
from lodeseek.operators.filters import first_filled
from lodeseek.operators.ordered import top_k

CANDIDATE = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("pos", T.LongType(), False),
    *(T.StructField(n, T.StringType()) for n in ("source_type", "ref", "url", "fetched_at", "rerank_text")),
    T.StructField("score", T.DoubleType(), False),
])
# Display label per source type.
SOURCE_LABELS = {"textbook": "교재", "code": "코드", "web": "웹", "youtube": "영상"}


def _null() -> Column:
    return F.lit(None).cast("string")


def rank_score(rank) -> Column:
    """Score of a 0-based rank in the code list."""
    return F.round(1 - col_of(rank) / 10.0, 4)


def position_score(rank, kept) -> Column:
    """Score of a 0-based rank among ``kept`` hits."""
    return F.round(1 - col_of(rank) / F.greatest(col_of(kept), F.lit(1)), 4)


#: Bits of a candidate's place that hold its rank; the source's number stands above them.
SOURCE_SHIFT = 48


def merge_candidates(code: DataFrame, entities: DataFrame, web: DataFrame, video: DataFrame,
                     cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, pos, source_type, ref, url, fetched_at, rerank_text, score).

    All rows of code, textbook entities, web and video in that order, no dedup.
    Each input has query_id and a 0-based rank; ``pos`` orders (source, rank).
    """
    cut = lambda c: head(c, cfg.context_chars)
    text = lambda c: F.coalesce(col_of(c), F.lit(""))
    shapes = [
        (code, "code", F.col("chunk_id"), _null(), _null(),
         F.concat(text("signature"), F.lit("\n"), cut(text("text"))), rank_score(F.coalesce("rank", F.lit(0)))),
        (entities, "textbook", F.col("id"), _null(), _null(),
         F.concat(text("name"), F.lit(": "), text("description")), F.round(F.coalesce("score", F.lit(0.0)), 4)),
        (web, "web", _null(), F.col("url"), F.col("fetched_at"),
         F.concat(text("title"), F.lit("\n"), cut(text(first_filled("text", "snippet")))), F.coalesce("score", F.lit(0.0))),
        (video, "youtube", _null(), F.col("url"), F.col("fetched_at"),
         F.concat(text("title"), F.lit("\n"), cut(text("transcript"))), F.coalesce("score", F.lit(0.0))),
    ]
    parts = [
        df.select(
            "query_id", (F.shiftleft(F.lit(order).cast("bigint"), SOURCE_SHIFT) + F.col("rank")).alias("pos"),
            F.lit(kind).alias("source_type"), ref.alias("ref"), url.alias("url"), fetched.alias("fetched_at"),
            body.alias("rerank_text"), score.cast("double").alias("score"))
        for order, (df, kind, ref, url, fetched, body, score) in enumerate(shapes)
    ]
    return reduce(DataFrame.unionByName, parts)


def rerank(candidates: DataFrame, scorer: Callable | None = None, queries: DataFrame | None = None,
           cfg: Tunables = DEFAULTS) -> DataFrame:
    """Best ``rerank_top_n`` candidates per query with a 1-based rank.

    A plugged-in ``(query texts, documents) -> scores`` is called once per query with all its candidates (a search has a few dozen)
    and replaces their scores (4 decimals). Where it fails, or leaves one out, all candidates of that query keep their own scores,
    so no ranking mixes two scales and no query suffers from another. Ties keep ``pos``.
    """
    if scorer is not None:
        names = candidates.columns

        def judge(group: pd.DataFrame) -> pd.DataFrame:
            try:
                scores = pd.Series(scorer(group["query"].tolist(), group["rerank_text"].fillna("").tolist()), dtype="float64")
            except Exception:  # any failure of the plugged-in model
                return group[names]
            whole = len(scores) == len(group) and scores.notna().all()
            return (group.assign(score=scores.round(4).to_numpy()) if whole else group)[names]

        asked = candidates.join(queries.select("query_id", "query"), "query_id")
        candidates = asked.groupBy("query_id").applyInPandas(judge, candidates.schema)
    return top_k(candidates, ["query_id"], [F.desc("score"), F.col("pos")], cfg.rerank_top_n)


def reached(queries: DataFrame, sources: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """(query_id, has_<source>...) where a source is reached by any row of its frames."""
    out = queries.select("query_id")
    for name in SOURCE_TYPES:
        seen = reduce(DataFrame.union, [df.select("query_id") for df in sources[name]]).distinct()
        out = out.join(seen.withColumn(f"has_{name}", F.lit(True)), "query_id", "left")
    return out.select("query_id", *(F.coalesce(f"has_{n}", F.lit(False)).alias(f"has_{n}") for n in SOURCE_TYPES))


def missing_sources(flags: DataFrame) -> DataFrame:
    """(query_id, missing_sources): sorted sources without a final result."""
    gaps = F.array(*(F.when(~F.col(f"has_{n}"), F.lit(n)) for n in SOURCE_TYPES))
    return flags.select("query_id", F.array_compact(gaps).alias("missing_sources"))


def all_called(called) -> Column:
    """True once every source was called: the fan-out may stop."""
    return F.size(F.array_except(F.array(*(F.lit(n) for n in SOURCE_TYPES)), col_of(called))) == 0


def web_fallback(web: DataFrame, retry: DataFrame, flags: DataFrame) -> DataFrame:
    """Web hits, plus a second web attempt for queries no source answered."""
    none = flags.where(~(F.col("has_code") | F.col("has_textbook") | F.col("has_web") | F.col("has_youtube")))
    return web.unionByName(retry.join(none.select("query_id"), "query_id", "left_semi").select(*web.columns))


def _ordered_join(df: DataFrame, order: str, line: Column, separator: str, out: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), separator).alias(out))


def build_context(reranked: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, context): ``[i] (type:ref) text`` lines of the first reranked hits."""
    few = reranked.where(F.col("rank") <= cfg.context_items)
    ref = F.coalesce(first_filled("ref", "url"), F.lit(""))
    body = head(flatten_newlines(py_strip(F.coalesce("rerank_text", F.lit("")))), cfg.context_chars)
    line = F.format_string("[%s] (%s:%s) %s", F.col("rank").cast("string"), F.coalesce("source_type", F.lit("?")), ref, body)
    return _ordered_join(few, "rank", line, "\n", "context")


def add_textbook_tail(context: DataFrame, chunks: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Append the first textbook chunks under the context."""
    few = chunks.where(F.col("rank") <= cfg.textbook_tail_chunks)
    line = F.format_string("[교재청크 %s] %s", "chunk_id", head(F.coalesce("text", F.lit("")), cfg.textbook_tail_chars))
    tail = _ordered_join(few, "rank", line, "\n", "tail")
    both = context.join(tail, "query_id", "full_outer")
    return both.select("query_id", F.concat(
        F.coalesce("context", F.lit("")), F.coalesce(F.concat(F.lit("\n"), "tail"), F.lit(""))).alias("context"))


def code_corpus(code: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, corpus): the code blocks shown to a code synthesiser."""
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    block = F.format_string("chunk_id: %s\nlang: %s\nsignature: %s\ncode:\n%s", shown("chunk_id"), shown("lang"),
                            shown("signature"), head(F.coalesce("text", F.lit("")), cfg.code_block_chars))
    return _ordered_join(code, "rank", block, "\n---\n", "corpus")


def supported_examples(examples: DataFrame, code: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Examples whose source was retrieved for the same query; the first few per query.

    ``examples`` has query_id, ord, lang, code, explain, source.
    """
    known = code.where(F.col("chunk_id") != "").select("query_id", F.col("chunk_id").alias("source")).distinct()
    kept = examples.join(known, ["query_id", "source"], "left_semi")
    return top_k(kept, ["query_id"], [F.col("ord")], cfg.max_code_examples)


def verbatim_examples(code: DataFrame) -> DataFrame:
    """Offline code synthesis: the retrieved chunks themselves."""
    return code.select("query_id", F.col("rank").alias("ord"), "lang", F.col("text").alias("code"),
                       F.lit("").alias("explain"), F.col("chunk_id").alias("source"))


def apply_summarizer(contexts: DataFrame, summarizer=None) -> DataFrame:
    """(query_id, summary): plugged-in ``(query, context) -> text``; a failure gives an empty summary."""
    if summarizer is None:
        return contexts.select("query_id", F.lit("").alias("summary"))
    @F.pandas_udf("string")
    def run(query: pd.Series, context: pd.Series) -> pd.Series:
        def one(q, c):
            try:
                return (summarizer(q, c) or "").strip()
            except Exception:  # noqa: BLE001 - a failed summary leaves it empty
                return ""

        return pd.Series([one(q, c) for q, c in zip(query, context)], dtype=object)

    return contexts.select("query_id", run("query", "context").alias("summary"))


def assemble_answers(queries: DataFrame, summaries: DataFrame, examples: DataFrame, reranked: DataFrame,
                     missing: DataFrame, models: Column) -> DataFrame:
    """One row per query: query, summary, code_examples, sources, missing_sources, used_models."""
    code = examples.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "lang", "code", "explain", "source"))),
        lambda e: F.struct(e["lang"].alias("lang"), e["code"].alias("code"), e["explain"].alias("explain"),
                           e["source"].alias("source"))).alias("code_examples"))
    found = reranked.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(
            F.col("source_type").alias("type"), "ref", "url", "score", "fetched_at").alias("s")))),
        lambda r: r["s"]).alias("sources"))
    out = queries.join(summaries, "query_id", "left").join(code, "query_id", "left").join(
        found, "query_id", "left").join(missing, "query_id", "left")
    filled = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("query_id", "query", F.coalesce("summary", F.lit("")).alias("summary"), filled("code_examples"),
                      filled("sources"), filled("missing_sources"), models.alias("used_models"))


# ---- presentation -------------------------------------------------------------

def shown_source(sources: DataFrame) -> DataFrame:
    """Display columns of a source: reference, link flag, label, percent."""
    label = F.coalesce(*(F.when(F.col("source_type") == k, F.lit(v)) for k, v in SOURCE_LABELS.items()),
                       F.col("source_type"))
    return (
        sources.withColumn("display_ref", F.coalesce(first_filled("url", "ref"), F.lit("-")))
        .withColumn("linkable", blank_to_null("url").isNotNull())
        .withColumn("label", label).withColumn("percent", percent("score"))
    )


def has_results(summary, n_examples, n_sources) -> Column:
    return (F.coalesce(col_of(summary), F.lit("")) != "") | (col_of(n_examples) > 0) | (col_of(n_sources) > 0)
