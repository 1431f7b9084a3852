"""Ranking quality of vector retrieval against labelled vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.operators.evaluate import (
    context_scores, hit_context, mean_ndcg, metric_means, ndcg, ndcg_by_type,
)
from lodeseek.operators.vector import vector_topk
from lodeseek.plans.queries_answer import SOURCES_SQL, sources
from lodeseek.plans.queries_rank import six
from lodeseek.plans.registry import query, table

# Queries: the vectors numbered like a benchmark passage. Truth: vectors of the same label whose
# document is labelled toxic; the type is the label.
EVAL_SQL = """
questions AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q, label::VARCHAR AS type, label
              FROM benchmark JOIN embeddings ON vec_id = item_id),
truth AS (SELECT query_id, vec_id AS id FROM questions JOIN embeddings USING (label)
          JOIN labels ON doc_id = vec_id WHERE toxic = 1),
ranked AS (
  SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY
         round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) DESC, vec_id) - 1 AS rank
  FROM questions, embeddings QUALIFY rank < 10),
relevant AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id),
gains AS (SELECT query_id, sum(1 / log2(rank + 2)) AS dcg, count(*) AS hits
          FROM ranked JOIN truth USING (query_id, id) GROUP BY query_id),
samples AS (
  SELECT query_id, type, CASE WHEN n IS NULL THEN 'NaN'::DOUBLE ELSE coalesce(dcg, 0) /
    (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(n, 10)) END AS ndcg
  FROM questions LEFT JOIN relevant USING (query_id) LEFT JOIN gains USING (query_id))
"""


def parts(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(
        vectors.withColumnRenamed("vec_id", "query_id"), "query_id")
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    truth = asked.select("query_id", "label").join(vectors.join(toxic, "vec_id").select("label", "vec_id"), "label").select(
        "query_id", F.col("vec_id").alias("id"))
    ranked = vector_topk(vectors, asked, 10).select("query_id", F.col("vec_id").alias("id"), (F.col("rank") - 1).alias("rank"))
    return asked.select("query_id", F.col("label").cast("string").alias("type")), ranked, truth


@query("ndcg_at_k", f"WITH {EVAL_SQL} SELECT query_id, type, round(ndcg, 6) AS ndcg FROM samples WHERE NOT isnan(ndcg)")
def ndcg_at_k(spark, d):
    samples = ndcg(*parts(spark, d))
    return samples.where(~F.isnan("ndcg")).select("query_id", "type", six("ndcg", "ndcg"))


@query("ndcg_mean", f"""
WITH {EVAL_SQL} SELECT round(avg(ndcg), 6) AS mean_ndcg, count(*) AS n_with_gt FROM samples WHERE NOT isnan(ndcg)
""")
def ndcg_mean(spark, d):
    return mean_ndcg(ndcg(*parts(spark, d))).select(six("mean_ndcg", "mean_ndcg"), "n_with_gt")


@query("ndcg_by_type", f"""
WITH {EVAL_SQL} SELECT type, round(avg(ndcg), 6) AS mean_ndcg, count(*) AS n FROM samples WHERE NOT isnan(ndcg) GROUP BY type
""")
def ndcg_by_type_query(spark, d):
    return ndcg_by_type(ndcg(*parts(spark, d))).select("type", six("mean_ndcg", "mean_ndcg"), "n")


CONTEXT_SQL = f"""
WITH {EVAL_SQL},
placed AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS found
           FROM ranked JOIN truth USING (query_id, id)),
scored AS (
  SELECT query_id, coalesce(avg(found / (rank + 1)), 0) AS context_precision, count(rank) / any_value(n) AS context_recall
  FROM relevant LEFT JOIN placed USING (query_id) GROUP BY query_id)
"""


@query("context_precision_recall", f"""{CONTEXT_SQL}
SELECT query_id, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall FROM scored
""")
def context_precision_recall(spark, d):
    _, ranked, truth = parts(spark, d)
    return context_scores(ranked, truth).select(
        "query_id", six("context_precision", "context_precision"), six("context_recall", "context_recall"))


@query("metric_means", f"""{CONTEXT_SQL}
SELECT round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall FROM scored
""")
def metric_means_query(spark, d):
    _, ranked, truth = parts(spark, d)
    means = metric_means(context_scores(ranked, truth), ["context_precision", "context_recall"])
    return means.select(six("context_precision", "context_precision"), six("context_recall", "context_recall"))


@query("eval_contexts", f"""
WITH {SOURCES_SQL}
SELECT query_id, string_agg('[' || (rank + 1) || '] ' || left(signature || chr(10) || text, 600), chr(10) || chr(10) ORDER BY rank) AS context_text,
       string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids FROM code GROUP BY query_id
""")
def eval_contexts(spark, d):
    out = hit_context(sources(spark, d)[0])
    return out.select("query_id", "context_text", F.array_join("retrieved_chunk_ids", ",").alias("chunk_ids"))
