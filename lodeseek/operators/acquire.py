"""Web and video hits: filters, page text, position scores, cache."""

from __future__ import annotations

import time
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.functions.html import extract_text
from lodeseek.functions.text import blank_to_null, cache_key, has_text
from lodeseek.operators.answer import position_score
from lodeseek.operators.filters import first_filled, popular, recent
from lodeseek.operators.ordered import running_total, top_k

# HTTP statuses that mean the site refuses us.
BLOCKED = (403, 429)


class Blocked(RuntimeError):
    """The search service itself refuses us (403 or 429)."""


def is_blocked(message: str) -> bool:
    text = message.lower()
    return any(word in text for word in ("403", "forbidden", "429", "ratelimit", "rate limit"))


def search_hits(queries: DataFrame, search: Callable[[str], list[dict]], cfg: Tunables = DEFAULTS,
                sleep=time.sleep) -> DataFrame:
    """(query_id, hit_rank, title, href, link, url, body, snippet, status) from a plugged-in search.

    Up to ``web_retries`` attempts with doubling waits. A refusal is not retried and
    comes out as one row with status ``blocked``; giving up is status ``failed``.
    """
    fields = ("title", "href", "link", "url", "body", "snippet")
    schema = queries.schema["query_id"].dataType.simpleString()
    columns = ["query_id", "hit_rank", *fields, "status"]

    def ask(query: str):
        for attempt in range(1, cfg.web_retries + 1):
            try:
                return search(query)[:cfg.web_max_results], "ok"
            except Exception as error:  # noqa: BLE001 - refusals and faults are told apart below
                if isinstance(error, Blocked) or is_blocked(str(error)):
                    return [], "blocked"
                if attempt < cfg.web_retries:
                    sleep(cfg.web_base_delay * 2 ** (attempt - 1))
        return [], "failed"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, query in zip(batch["query_id"], batch["query"]):
                hits, status = ask(query)
                rows += [(query_id, n, *(h.get(f) for f in fields), status) for n, h in enumerate(hits)]
                if status != "ok":
                    rows.append((query_id, -1, *(None for _ in fields), status))
            yield pd.DataFrame(rows, columns=columns)

    return queries.select("query_id", "query").mapInPandas(
        run, f"query_id {schema}, hit_rank int, {', '.join(f'{f} string' for f in fields)}, status string")


def raise_if_blocked(hits: DataFrame) -> DataFrame:
    """A refused search is an error; refused pages are not (see :func:`with_page_text`)."""
    guard = F.when(F.col("status") == "blocked", F.raise_error(F.lit("web search refused (403/429)")).cast("boolean"))
    return hits.where(F.coalesce(guard, F.lit(True)))


def usable_hits(hits: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, hit_rank, title, url, snippet): first results, then only those with a URL."""
    few = hits.where(F.col("hit_rank").between(0, cfg.web_max_results - 1))
    return few.select(
        "query_id", "hit_rank", F.coalesce("title", F.lit("")).alias("title"),
        first_filled("href", "link", "url").alias("url"),
        F.coalesce(first_filled("body", "snippet"), F.lit("")).alias("snippet"),
    ).where(F.col("url").isNotNull())


def with_page_text(hits: DataFrame, pages: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Adds ``text``: page text, or the snippet when the page is refused, missing or empty.

    ``pages`` has url, status and html, one row per url; it is read once per wanted url.
    """
    wanted = pages.join(hits.select("url").distinct(), "url", "left_semi")
    ok = ~F.col("status").isin(*BLOCKED) & F.col("html").isNotNull()
    texts = wanted.where(ok).select("url", extract_text("html", cfg.web_text_chars).alias("page"))
    return hits.join(texts, "url", "left").withColumn("text", F.coalesce(blank_to_null("page"), "snippet")).drop("page")


def score_hits(hits: DataFrame, order: str = "hit_rank") -> DataFrame:
    """Adds 0-based ``rank`` and ``score`` over the hits kept per query (a short list)."""
    window = Window.partitionBy("query_id")
    return hits.withColumn("rank", F.row_number().over(window.orderBy(order)) - 1).withColumn(
        "score", position_score("rank", F.count(F.lit(1)).over(window)))


def web_search(queries: DataFrame, search: Callable, pages: DataFrame, fetched_at: Column,
               cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, rank, title, url, snippet, text, score, fetched_at).

    A refused query has no rows here and so counts as a missing source; the other queries of the batch go on.
    """
    hits = usable_hits(search_hits(queries, search, cfg), cfg)
    scored = score_hits(with_page_text(hits, pages, cfg)).withColumn("fetched_at", fetched_at)
    return scored.select("query_id", "rank", "title", "url", "snippet", "text", "score", "fetched_at")


def transcripts(segments: DataFrame, keys: list[str], order: list[str], text: str = "text",
                cfg: Tunables = DEFAULTS, **options) -> DataFrame:
    """(keys, transcript): non-blank segments joined by a space, cut at ``transcript_chars``.

    Only segments that start inside the cut are gathered, so a long recording costs
    no more than a short one.
    """
    filled = segments.where(has_text(text)).select(*keys, *order, F.col(text).alias("_t"))
    sized = filled.withColumn("_n", F.length("_t") + 1)
    placed = running_total(sized, keys, order, "_n", "_end", **options)
    # A segment starting right at the cut still brings the space before it.
    near = placed.where(F.col("_end") - F.col("_n") <= cfg.transcript_chars)
    parts = F.array_sort(F.collect_list(F.struct(F.col("_end"), F.col("_t"))))
    joined = F.array_join(F.transform(parts, lambda p: p["_t"]), " ")
    return near.groupBy(*keys).agg(F.substring(joined, 1, cfg.transcript_chars).alias("transcript"))


def rank_videos(found: DataFrame, statistics: DataFrame, as_of: Column, cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, rank, video_id, views, score, *rest): recent, popular, most viewed first.

    Score and rank use every candidate with enough views; at most ``video_max_results``
    rows per query come out. Ties keep the search order ``hit_rank``.
    """
    known = found.where(recent("published_at", as_of, cfg.video_months)).join(statistics, "video_id")
    enough = known.withColumn("views", F.coalesce(F.col("view_count").cast("bigint"), F.lit(0))).where(
        popular("view_count", cfg.video_min_views))
    counts = enough.groupBy("query_id").agg(F.count(F.lit(1)).alias("_kept"))
    best = top_k(enough, ["query_id"], [F.desc("views"), F.col("hit_rank")], cfg.video_max_results)
    ranked = best.join(counts, "query_id").withColumn("rank", F.col("rank") - 1)
    return ranked.withColumn("score", position_score("rank", "_kept")).drop("_kept")


def with_transcripts(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """Drop videos without a transcript, after ranks and scores are set."""
    return ranked.join(texts, "video_id").where(F.col("transcript") != "")


def cached(results: DataFrame, cache: DataFrame, queries: DataFrame, refused: DataFrame) -> DataFrame:
    """Results, with the cached rows standing in for queries whose service refused."""
    asked = queries.join(refused.select("query_id"), "query_id", "left_semi")
    stand_in = asked.select("query_id", cache_key("query").alias("cache_key")).join(cache, "cache_key").drop("cache_key")
    return results.unionByName(stand_in.select(*results.columns))


def to_cache(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows to store under their query's key; queries without results write nothing."""
    keyed = queries.select("query_id", cache_key("query").alias("cache_key"))
    return results.join(keyed, "query_id").drop("query_id")
