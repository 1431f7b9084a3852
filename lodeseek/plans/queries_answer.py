"""Federated answers: conversations ask, four tables answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.operators import answer as A
from lodeseek.operators.filters import valid_request
from lodeseek.operators.manifest import normalized_hint
from lodeseek.operators.ordered import top_k
from lodeseek.operators.routing import planned_providers, resolve_provider, used_models
from lodeseek.plans.registry import query, table
from lodeseek.runtime import stage

# Every conversation is a query. Its assistant turns are code hits, the suppliers of the nation with
# its number are entities, the page with its number is the web hit, its user's views are videos.
SOURCES_SQL = """
code AS (
  SELECT conv_id AS query_id, 'conv_' || conv_id || '#' || turn AS chunk_id, role AS signature, text, role AS lang, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rank FROM conversations WHERE role = 'assistant'
  ) WHERE rank < 5),
ents AS (
  SELECT s_nationkey::BIGINT AS query_id, 'ent_supplier_' || s_suppkey AS id, s_name AS name, s_acctbal / 10000 AS score,
         row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank
  FROM supplier QUALIFY rank < 8),
web AS (SELECT page_id AS query_id, url, 1.0::DOUBLE AS score, 0 AS rank FROM pages),
video AS (
  SELECT user_id AS query_id, 'https://youtu.be/' || event_id AS url, props, rank,
         round(1 - rank / greatest(n, 1), 4) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank,
           count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view') WHERE rank < 10),
candidates AS (
  SELECT query_id, rank AS pos, 'code' AS source_type, chunk_id AS ref, NULL AS url,
         signature || chr(10) || left(text, 600) AS rerank_text, round(1 - rank / 10.0, 4)::DOUBLE AS score FROM code
  UNION ALL SELECT query_id, 281474976710656 + rank, 'textbook', id, NULL, name || ': ', round(score, 4) FROM ents
  UNION ALL SELECT query_id, 562949953421312 + rank, 'web', NULL, url, chr(10) || left(url, 600), score FROM web
  UNION ALL SELECT query_id, 844424930131968 + rank, 'youtube', NULL, url, 'view' || chr(10) || left(props, 600), score FROM video),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM candidates QUALIFY rank <= 8)
"""


def sources(spark, d):
    text = lambda c: F.col(c).cast("string")
    turns = table(spark, d, "conversations").where("role = 'assistant'")
    code = top_k(turns, ["conv_id"], [F.col("turn")], 5).select(
        F.col("conv_id").alias("query_id"), (F.col("rank") - 1).alias("rank"),
        F.concat(F.lit("conv_"), text("conv_id"), F.lit("#"), text("turn")).alias("chunk_id"),
        F.col("role").alias("signature"), "text", F.col("role").alias("lang"))
    ents = top_k(table(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 8).select(
        F.col("s_nationkey").cast("bigint").alias("query_id"), (F.col("rank") - 1).alias("rank"),
        F.concat(F.lit("ent_supplier_"), text("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("description"), (F.col("s_acctbal") / 10000).alias("score"))
    web = table(spark, d, "pages").select(
        F.col("page_id").alias("query_id"), F.lit(0).alias("rank"), F.lit("").alias("title"), "url",
        F.col("url").alias("snippet"), F.lit("").alias("text"), F.lit(1.0).alias("score"),
        F.lit(None).cast("string").alias("fetched_at"))
    views = table(spark, d, "events").where("event_type = 'view'")
    kept = views.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    best = top_k(views, ["user_id"], [F.desc("value"), F.col("event_id")], 10).withColumn("rank", F.col("rank") - 1)
    video = best.join(kept, "user_id").select(
        F.col("user_id").alias("query_id"), "rank", F.col("event_type").alias("title"), F.col("props").alias("transcript"),
        F.concat(F.lit("https://youtu.be/"), text("event_id")).alias("url"),
        A.position_score("rank", "n").alias("score"), F.lit(None).cast("string").alias("fetched_at"))
    return code, ents, web, video


def candidates(spark, d):
    return A.merge_candidates(*sources(spark, d))


@query("merge_candidates", f"""
WITH {SOURCES_SQL}
SELECT query_id, pos::BIGINT AS pos, source_type, ref, url, rerank_text, round(score, 6) AS score FROM candidates
""")
def merge_candidates(spark, d):
    return candidates(spark, d).select(
        "query_id", "pos", "source_type", "ref", "url", "rerank_text", F.round("score", 6).alias("score"))


@query("rerank_fallback", f"""
WITH {SOURCES_SQL}
SELECT query_id, rank::INT AS rank, source_type, coalesce(ref, url) AS ref, round(score, 6) AS score FROM reranked
""")
def rerank_fallback(spark, d):
    return A.rerank(candidates(spark, d)).select(
        "query_id", "rank", "source_type", F.coalesce("ref", "url").alias("ref"), F.round("score", 6).alias("score"))


def asked(spark, d):
    """Each conversation with its first turn as the query text."""
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.min_by("text", "turn").alias("query"))


def _flags(spark, d):
    code, ents, web, video = sources(spark, d)
    return A.reached(asked(spark, d), {"code": [code], "textbook": [ents], "web": [web], "youtube": [video]})


MISSING_SQL = """
SELECT conv_id AS query_id, array_to_string([x FOR x IN [
  CASE WHEN conv_id NOT IN (SELECT query_id FROM code) THEN 'code' END,
  CASE WHEN conv_id NOT IN (SELECT query_id FROM ents) THEN 'textbook' END,
  CASE WHEN conv_id NOT IN (SELECT query_id FROM web) THEN 'web' END,
  CASE WHEN conv_id NOT IN (SELECT query_id FROM video) THEN 'youtube' END] IF x IS NOT NULL], ',') AS missing
FROM (SELECT DISTINCT conv_id FROM conversations)
"""


@query("missing_sources", f"WITH {SOURCES_SQL} {MISSING_SQL}")
def missing_sources(spark, d):
    gaps = A.missing_sources(_flags(spark, d))
    return gaps.select("query_id", F.array_join("missing_sources", ",").alias("missing"))


@query("web_fallback", f"""
WITH {SOURCES_SQL}
SELECT query_id, url FROM web
UNION ALL SELECT DISTINCT conv_id, 'retry:' || conv_id FROM conversations
WHERE conv_id NOT IN (SELECT query_id FROM candidates)
""")
def web_fallback(spark, d):
    """Conversations no source reached get a second web attempt."""
    flags = _flags(spark, d)
    web = sources(spark, d)[2].select("query_id", "url")
    retry = flags.select("query_id", F.concat(F.lit("retry:"), F.col("query_id").cast("string")).alias("url"))
    return A.web_fallback(web, retry, flags)


@query("context_format", f"""
WITH {SOURCES_SQL}
SELECT query_id, string_agg('[' || rank || '] (' || source_type || ':' || coalesce(ref, url, '') || ') ' ||
       left(replace(trim(rerank_text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' '), 600), chr(10) ORDER BY rank) AS context
FROM reranked GROUP BY query_id
""")
def context_format(spark, d):
    return A.build_context(A.rerank(candidates(spark, d)))


@query("code_corpus", f"""
WITH {SOURCES_SQL}
SELECT query_id, string_agg('chunk_id: ' || chunk_id || chr(10) || 'lang: ' || lang || chr(10) || 'signature: ' || signature ||
       chr(10) || 'code:' || chr(10) || left(text, 1200), chr(10) || '---' || chr(10) ORDER BY rank) AS corpus
FROM code GROUP BY query_id
""")
def code_corpus(spark, d):
    return A.code_corpus(sources(spark, d)[0])


EXAMPLES_SQL = """
examples AS (
  SELECT conv_id AS query_id, turn AS ord, 'conv_' || conv_id || '#' || turn AS source FROM conversations),
supported AS (
  SELECT query_id, ord, source, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank
  FROM examples WHERE (query_id, source) IN (SELECT (query_id, chunk_id) FROM code) QUALIFY rank <= 3)
"""


def supported(spark, d, code):
    """Every turn claims to be an example; only retrieved ones may stay."""
    text = lambda c: F.col(c).cast("string")
    examples = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), F.col("role").alias("lang"),
        F.col("text").alias("code"), F.lit("").alias("explain"),
        F.concat(F.lit("conv_"), text("conv_id"), F.lit("#"), text("turn")).alias("source"))
    return A.supported_examples(examples, code)


@query("evidence_filter", f"""
WITH {SOURCES_SQL}, {EXAMPLES_SQL} SELECT query_id, source, rank::INT AS rank FROM supported
""")
def evidence_filter(spark, d):
    return supported(spark, d, sources(spark, d)[0]).select("query_id", "source", "rank")


def answers(spark, d):
    code, *_ = sources(spark, d)
    reranked = stage(A.rerank(candidates(spark, d)), "reranked")
    models = used_models(F.lit("openai"), F.lit("claude"), {"groq": "m1", "openai": "m2", "claude": "m3"})
    queries = asked(spark, d)
    summaries = A.apply_summarizer(A.build_context(reranked))
    return A.assemble_answers(queries, summaries, supported(spark, d, code), reranked,
                              A.missing_sources(_flags(spark, d)), models)


@query("search_answers", f"""
WITH {SOURCES_SQL}, {EXAMPLES_SQL}, missing AS ({MISSING_SQL})
SELECT query_id, arg_min(c.text, c.turn) AS query, '' AS summary,
  coalesce((SELECT string_agg(source, ',' ORDER BY rank) FROM supported s WHERE s.query_id = m.query_id), '') AS examples,
  coalesce((SELECT string_agg(source_type || ':' || coalesce(ref, url), ',' ORDER BY rank)
            FROM reranked r WHERE r.query_id = m.query_id), '') AS found,
  any_value(missing) AS missing, 'claude/m3' AS code_model
FROM missing m JOIN conversations c ON c.conv_id = m.query_id GROUP BY query_id
""")
def search_answers(spark, d):
    out = answers(spark, d)
    ref = lambda s: F.concat(s["type"], F.lit(":"), F.coalesce(s["ref"], s["url"]))
    return out.select(
        "query_id", "query", "summary",
        F.array_join(F.transform("code_examples", lambda e: e["source"]), ",").alias("examples"),
        F.array_join(F.transform("sources", ref), ",").alias("found"),
        F.array_join("missing_sources", ",").alias("missing"),
        F.col("used_models")["code_synthesis"].alias("code_model"))


@query("shown_sources", f"""
WITH {SOURCES_SQL}
SELECT query_id, pos::BIGINT AS pos, coalesce(url, ref, '-') AS display_ref, url IS NOT NULL AS linkable,
       CASE source_type WHEN 'code' THEN '코드' WHEN 'textbook' THEN '교재' WHEN 'web' THEN '웹' ELSE '영상' END AS label,
       floor(score * 100 + 0.5)::BIGINT AS percent FROM candidates
""")
def shown_sources(spark, d):
    return A.shown_source(candidates(spark, d)).select("query_id", "pos", "display_ref", "linkable", "label", "percent")


# Requests: each turn is a request; its role picks the hint.
REQUEST_SQL = """
requests AS (SELECT conv_id, turn, text AS query, CASE role WHEN 'user' THEN 'auto' WHEN 'assistant' THEN 'gemini' ELSE 'other' END AS llm
             FROM conversations)
"""


def requests(spark, d):
    role = F.col("role")
    hint = F.when(role == "user", "auto").when(role == "assistant", "gemini").otherwise("other")
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"), hint.alias("llm"))


@query("valid_requests", f"""
WITH {REQUEST_SQL}
SELECT conv_id, turn FROM requests WHERE length(query) >= 1 AND llm IN ('auto', 'claude', 'openai', 'gemini')
""")
def valid_requests(spark, d):
    return requests(spark, d).where(valid_request("query", normalized_hint("llm"))).select("conv_id", "turn")


@query("provider_plan", f"""
WITH {REQUEST_SQL}
SELECT conv_id, turn, CASE WHEN llm = 'gemini' THEN 'gemini' ELSE 'openai' END AS summary,
       CASE WHEN llm = 'gemini' THEN 'gemini' ELSE 'claude' END AS code,
       CASE WHEN llm = 'gemini' THEN 'groq' ELSE 'claude' END AS used FROM requests
""")
def provider_plan(spark, d):
    """Planned providers per request, and the one used when gemini has no key."""
    hint = normalized_hint("llm")
    plan = planned_providers(hint)
    keys = {"groq": True, "claude": True, "openai": True, "gemini": False}
    return requests(spark, d).select("conv_id", "turn", plan["summary"].alias("summary"), plan["code"].alias("code"),
                                     resolve_provider(F.lit("code"), hint, keys).alias("used"))


@query("fanout_done", """
SELECT user_id, count(DISTINCT kind) = 4 AS done FROM (
  SELECT user_id, CASE event_type WHEN 'click' THEN 'code' WHEN 'view' THEN 'textbook' WHEN 'signup' THEN 'web'
                                  WHEN 'purchase' THEN 'youtube' END AS kind FROM events) GROUP BY user_id
""")
def fanout_done(spark, d):
    """Users whose events called all four sources."""
    e = F.col("event_type")
    kind = F.when(e == "click", "code").when(e == "view", "textbook").when(e == "signup", "web").when(e == "purchase", "youtube")
    called = table(spark, d, "events").select("user_id", kind.alias("kind")).groupBy("user_id").agg(
        F.collect_set("kind").alias("called"))
    return called.select("user_id", A.all_called("called").alias("done"))
