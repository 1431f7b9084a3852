"""Web pages and video-like events through the acquisition operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.functions.html import extract_text
from lodeseek.functions.text import cache_key, failure_reason, published_after
from lodeseek.operators.acquire import (
    rank_videos, score_hits, transcripts, usable_hits, with_page_text, with_transcripts,
)
from lodeseek.operators.ordered import top_k
from lodeseek.plans.queries_rank import six
from lodeseek.plans.registry import query, table

AS_OF = "2024-07-15 00:00:00"
LANG = r"^https?://[^/]+/([a-z]+)/"


@query("web_extract")
def web_extract(spark, d):
    """The whole readable text of every page; the parser is checked by its own tests."""
    return table(spark, d, "pages").select("page_id", extract_text("html").alias("text"))


# Pages answer a query per language of their address; a third of the hits names the url in another field.
HITS_SQL = f"""
hits AS (
  SELECT regexp_extract(url, '{LANG}', 1) AS query_id, page_id, url, 'about ' || page_id AS body,
         row_number() OVER (PARTITION BY regexp_extract(url, '{LANG}', 1) ORDER BY page_id) - 1 AS hit_rank
  FROM pages),
kept AS (SELECT * FROM hits WHERE hit_rank < 10 AND NOT starts_with(url, 'https://www.'))
"""


def page_hits(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", LANG, 1).alias("query_id"))
    first = top_k(pages, ["query_id"], [F.col("page_id")], 10)
    refused = F.col("url").startswith("https://www.")
    return first.select(
        "query_id", (F.col("rank") - 1).alias("hit_rank"), F.col("page_id").cast("string").alias("title"),
        F.lit("").alias("href"), F.lit(None).cast("string").alias("link"),
        F.when(~refused, F.col("url")).alias("url"),
        F.concat(F.lit("about "), F.col("page_id").cast("string")).alias("body"), F.lit("").alias("snippet"))


@query("web_score", f"""
WITH {HITS_SQL}
SELECT query_id, url, body AS snippet, rank::INT AS rank, round(1 - rank / n, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank) - 1 AS rank,
         count(*) OVER (PARTITION BY query_id) AS n FROM kept)
""")
def web_score(spark, d):
    scored = score_hits(usable_hits(page_hits(spark, d)))
    return scored.select("query_id", "url", "snippet", "rank", F.round("score", 4).alias("score"))


@query("web_snippets", f"""
WITH {HITS_SQL} SELECT query_id, url, body AS text FROM kept
""")
def web_snippets(spark, d):
    """Every page refused: the snippet stands in for its text."""
    pages = table(spark, d, "pages").select("url", F.lit(429).alias("status"), "html")
    return with_page_text(usable_hits(page_hits(spark, d)), pages).select("query_id", "url", "text")


VIDEO_SQL = f"""
found AS (
  SELECT event_type AS query_id, event_id AS video_id, floor(value * 100)::BIGINT AS views FROM events
  WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAYS AND floor(value * 100) >= 1000),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY views DESC, video_id) - 1 AS rank,
         count(*) OVER (PARTITION BY query_id) AS n FROM found)
"""


def videos(spark, d):
    events = table(spark, d, "events")
    found = events.select(F.col("event_type").alias("query_id"), F.col("event_id").alias("video_id"),
                          F.col("event_id").alias("hit_rank"), F.col("ts").alias("published_at"))
    stats = events.select(F.col("event_id").alias("video_id"), F.floor(F.col("value") * 100).alias("view_count"))
    return rank_videos(found, stats, F.lit(AS_OF).cast("timestamp"))


@query("video_rank", f"""
WITH {VIDEO_SQL}
SELECT query_id, video_id, views, rank::INT AS rank, round(1 - rank / n, 4) AS score FROM ranked WHERE rank < 10
""")
def video_rank(spark, d):
    return videos(spark, d).select("query_id", "video_id", "views", "rank", F.round("score", 4).alias("score"))


# Segments of a recording are the turns of a conversation, in order.
TRANSCRIPT_SQL = """
transcripts AS (
  SELECT conv_id, left(string_agg(text, ' ' ORDER BY turn), 3000) AS transcript FROM conversations
  WHERE regexp_matches(text, '\\S') GROUP BY conv_id)
"""


@query("transcripts", f"WITH {TRANSCRIPT_SQL} SELECT * FROM transcripts")
def transcripts_query(spark, d):
    return transcripts(table(spark, d, "conversations"), ["conv_id"], ["turn"])


@query("video_transcripts", f"""
WITH {TRANSCRIPT_SQL},
totals AS (SELECT user_id AS video_id, floor(sum(value) * 100)::BIGINT AS views FROM events GROUP BY user_id),
found AS (SELECT event_type AS query_id, user_id AS video_id FROM events GROUP BY ALL
          HAVING max(ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 180 DAYS),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY views DESC, video_id) - 1 AS rank,
                  count(*) OVER (PARTITION BY query_id) AS n FROM found JOIN totals USING (video_id) WHERE views >= 1000)
SELECT query_id, video_id, rank::INT AS rank, round(1 - rank / n, 4) AS score, transcript
FROM ranked JOIN transcripts ON conv_id = video_id WHERE rank < 10
""")
def video_transcripts(spark, d):
    """Users as videos; ranks keep their gaps when a video has no transcript."""
    events = table(spark, d, "events").withColumnRenamed("user_id", "video_id")
    found = events.groupBy(F.col("event_type").alias("query_id"), "video_id").agg(
        F.max("ts").alias("published_at")).withColumn("hit_rank", F.col("video_id"))
    stats = events.groupBy("video_id").agg(F.floor(F.sum("value") * 100).alias("view_count"))
    ranked = rank_videos(found, stats, F.lit(AS_OF).cast("timestamp"))
    texts = transcripts(table(spark, d, "conversations"), ["conv_id"], ["turn"]).withColumnRenamed("conv_id", "video_id")
    return with_transcripts(ranked, texts).select(
        "query_id", "video_id", "rank", F.round("score", 4).alias("score"), "transcript")


@query("cache_keys", "SELECT conv_id, turn, substr(sha256(text), 1, 16) AS key FROM conversations")
def cache_keys(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", cache_key("text").alias("key"))


@query("failure_reasons", """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN regexp_matches(lower('Error ' || event_id || ': ' || props), '429|rate limit|ratelimit|too many requests')
         THEN 'rate_limit' ELSE 'parse_error' END AS reason FROM events WHERE event_type = 'error') GROUP BY reason
""")
def failure_reasons(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'")
    text = F.concat(F.lit("Error "), F.col("event_id").cast("string"), F.lit(": "), F.col("props"))
    return errors.groupBy(failure_reason(text).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("recency_window", """
SELECT event_id, strftime(ts - INTERVAL 180 DAYS, '%Y-%m-%dT%H:%M:%SZ') AS published_after FROM events
""")
def recency_window(spark, d):
    return table(spark, d, "events").select("event_id", published_after("ts", 6).alias("published_after"))
