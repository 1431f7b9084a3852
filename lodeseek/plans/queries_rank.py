"""Keyword, vector and fused retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.functions.vectors import cosine, embed_text, graph_score
from lodeseek.operators.bm25 import bm25_topk
from lodeseek.operators.bounded import bounded
from lodeseek.operators.fusion import hybrid_retrieve, rank_fusion
from lodeseek.operators.ordered import top_k
from lodeseek.operators.vector import mmr_topk, vector_topk
from lodeseek.plans.registry import query, table
from lodeseek.runtime import spread, stage
from lodeseek.sources.keyword_index import KeywordIndex
from lodeseek.sources.vector_index import VectorIndex

# White space as Python splits it, for the checking SQL.
SPACE = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

TOKENS_SQL = f"""
tokens AS (
  SELECT doc_id, [x FOR x IN string_split_regex(text, '{SPACE}') IF x <> ''] AS toks FROM documents
),
occurrences AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM tokens),
totals AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tokens),
dfs AS (SELECT term, count(DISTINCT doc_id) AS df FROM occurrences GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS w FROM dfs, totals),
idf AS (SELECT term, df, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM raw) ELSE w END AS idf FROM raw)
"""

BM25_SQL = f"""
{TOKENS_SQL},
qterms AS (
  SELECT query_id, term, count(*) AS uses FROM (
    SELECT query_id, unnest([x FOR x IN string_split_regex(query, '{SPACE}') IF x <> '']) AS term FROM questions
  ) GROUP BY ALL
),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM occurrences
       WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
scores AS (
  SELECT query_id, doc_id,
         sum(uses * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN qterms USING (term) JOIN idf USING (term), totals GROUP BY ALL
),
bm25 AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM scores QUALIFY rank <= 10
)
"""

# One query vector per label: the first vector carrying that label.
VECTOR_QUESTIONS_SQL = """
questions AS (
  SELECT label::BIGINT AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS q FROM embeddings GROUP BY label
)"""

NEAREST_SQL = """
pairs AS (
  SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM questions, embeddings
),
nearest AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank
  FROM pairs
)"""


def _mmr_steps(pool: str, vectors: str, vec: str, picks: int = 5) -> str:
    """Greedy picks as one unrolled step per pick, in SQL."""
    steps = [
        f"sims AS (SELECT a.query_id, a.{vec} AS x, b.{vec} AS y, "
        f"list_cosine_similarity(va.embedding::DOUBLE[], vb.embedding::DOUBLE[]) AS sim "
        f"FROM {pool} a JOIN {pool} b USING (query_id) "
        f"JOIN {vectors} va ON va.{vec} = a.{vec} JOIN {vectors} vb ON vb.{vec} = b.{vec})",
        f"chosen1 AS (SELECT query_id, {vec}, 1 AS pick FROM {pool} WHERE rank = 1)",
    ]
    for n in range(2, picks + 1):
        steps.append(
            f"chosen{n} AS (SELECT * FROM chosen{n - 1} UNION ALL SELECT query_id, {vec}, {n} FROM ("
            f"SELECT p.query_id, p.{vec}, row_number() OVER (PARTITION BY p.query_id ORDER BY "
            f"round(0.5 * p.score - 0.5 * max(s.sim), 9) DESC, p.rank) AS rn "
            f"FROM {pool} p JOIN sims s ON s.query_id = p.query_id AND s.x = p.{vec} "
            f"JOIN chosen{n - 1} c ON c.query_id = p.query_id AND c.{vec} = s.y "
            f"WHERE NOT EXISTS (SELECT 1 FROM chosen{n - 1} d WHERE d.query_id = p.query_id AND d.{vec} = p.{vec}) "
            f"GROUP BY p.query_id, p.{vec}, p.score, p.rank) WHERE rn = 1)"
        )
    return ",\n".join(steps)


def passages(spark, d):
    """The benchmark passages, whole, as text queries."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def label_vectors(spark, d):
    """One query vector per embedding label."""
    return (
        table(spark, d, "embeddings").groupBy(F.col("label").cast("bigint").alias("query_id"))
        .agg(F.min_by("embedding", "vec_id").alias("embedding"))
    )


_INDEXES: dict[tuple[str, str], KeywordIndex] = {}


def keyword_index(spark, d) -> KeywordIndex:
    """The index of a folder's documents, built once per application and read by every query."""
    at = spark.sparkContext.applicationId, d
    if at not in _INDEXES:
        _INDEXES[at] = KeywordIndex.of(table(spark, d, "documents"))
    return _INDEXES[at]


def six(column, name):
    return F.round(column, 6).alias(name)


@query("bm25_corpus_stats", f"""
WITH {TOKENS_SQL}
SELECT n::BIGINT AS n_docs, round(avgdl, 6) AS avg_len,
       (SELECT count(*) FROM dfs)::BIGINT AS n_terms, round((SELECT avg(w) FROM raw), 6) AS mean_idf
FROM totals
""")
def bm25_corpus_stats(spark, d):
    totals = keyword_index(spark, d).totals()
    return spark.createDataFrame([totals], "n_docs long, avg_len double, n_terms long, mean_idf double").select(
        "n_docs", six("avg_len", "avg_len"), "n_terms", six("mean_idf", "mean_idf"))


@query("bm25_topk", f"""
WITH questions AS (SELECT item_id AS query_id, text AS query FROM benchmark), {BM25_SQL}
SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM bm25
""")
def bm25_topk_query(spark, d):
    hits = bm25_topk(None, passages(spark, d), index=keyword_index(spark, d))
    return hits.select("query_id", "doc_id", six("score", "score"), "rank")


@query("keyword_index_changes", f"""
WITH questions AS (SELECT item_id AS query_id, text AS query FROM benchmark),
{BM25_SQL.replace("FROM documents", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")}
SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM bm25
""")
def keyword_index_changes(spark, d):
    """An index that is built, changed and read: texts come late for documents known by their source, toxic ones go again."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    index = KeywordIndex.of(docs.withColumn("text", F.when(F.crc32(F.col("source").cast("binary")) % 2 == 0, F.col("source")).otherwise(F.col("text"))))
    index.put(docs.where(F.crc32(F.col("source").cast("binary")) % 2 == 0))
    index.remove(toxic)
    hits = bm25_topk(None, passages(spark, d), index=index)
    return hits.select("query_id", "doc_id", six("score", "score"), "rank")


@query("vector_topk", """
SELECT vec_id, round(score, 6) AS score, rank::INT AS rank FROM (
  SELECT e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
         row_number() OVER (ORDER BY round(score, 9) DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q
) WHERE rank <= 5
""")
def vector_topk_query(spark, d):
    vectors = table(spark, d, "embeddings")
    probe = vectors.agg(F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.lit(0).cast("bigint").alias("query_id"), "embedding")
    return vector_topk(vectors, probe, 5).select("vec_id", six("score", "score"), "rank")


@query("vector_topk_batch", f"""
WITH {VECTOR_QUESTIONS_SQL}, {NEAREST_SQL}
SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM nearest WHERE rank <= 10
""")
def vector_topk_batch(spark, d):
    hits = vector_topk(table(spark, d, "embeddings"), label_vectors(spark, d), 10)
    return hits.select("query_id", "vec_id", six("score", "score"), "rank")


@query("vector_index_topk", f"""
WITH {VECTOR_QUESTIONS_SQL}, {NEAREST_SQL}
SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM nearest WHERE rank <= 10
""")
def vector_index_topk(spark, d):
    """The same through stored cells, written in two parts."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = VectorIndex.of(vectors.where("vec_id % 3 != 0"))
    index.add(vectors.where("vec_id % 3 = 0"))
    return index.search(label_vectors(spark, d), 10).hits.select("query_id", "vec_id", six("score", "score"), "rank")


@query("graph_vector_score", f"""
WITH {VECTOR_QUESTIONS_SQL}, {NEAREST_SQL}
SELECT query_id, vec_id, round((1 + score) / 2, 6) AS score FROM nearest WHERE rank <= 8
""")
def graph_vector_score(spark, d):
    hits = vector_topk(table(spark, d, "embeddings"), label_vectors(spark, d), 8)
    return hits.select("query_id", "vec_id", six(graph_score("score"), "score"))


@query("label_cosine", """
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q
USING (label)
""")
def label_cosine(spark, d):
    """Similarity of every vector to the first of its label, as a plain expression."""
    first = label_vectors(spark, d).select(F.col("query_id").alias("label"), F.col("embedding").alias("q"))
    pairs = table(spark, d, "embeddings").join(first, "label")
    return pairs.select("vec_id", six(cosine("embedding", "q"), "cosine"))


@query("mmr_select", f"""
WITH {VECTOR_QUESTIONS_SQL}, {NEAREST_SQL},
pool AS (SELECT * FROM nearest WHERE rank <= 10),
{_mmr_steps('pool', 'embeddings', 'vec_id')}
SELECT query_id, vec_id, pick::INT AS rank FROM chosen5
""")
def mmr_select_query(spark, d):
    return mmr_topk(table(spark, d, "embeddings"), label_vectors(spark, d)).select("query_id", "vec_id", "rank")


_VECTORS: dict[tuple[str, str], object] = {}


def document_vectors(spark, d):
    """Vectors of all documents by the library's embedder, made once per application."""
    at = spark.sparkContext.applicationId, d
    if at not in _VECTORS:
        docs = spread(table(spark, d, "documents").select("doc_id", "text"))
        _VECTORS[at] = stage(docs.select("doc_id", embed_text("text").alias("embedding")), "document-vectors")
    return _VECTORS[at]


def embedded_passages(spark, d):
    """The benchmark passages with their vectors."""
    return stage(spread(passages(spark, d)).withColumn("embedding", embed_text("query")), "questions")


def _embedded_sql(name: str, source: str, key: str, text: str) -> str:
    """Signed hash counts of a text's words in 64 slots, as a list per row."""
    return f"""
{name}_slots AS (
  SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot,
         sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS v
  FROM (SELECT {key}, unnest([x FOR x IN string_split_regex({text}, '{SPACE}') IF x <> '']) AS term FROM {source}) GROUP BY 1, 2
),
{name} AS (
  SELECT {key}, list(coalesce(v, 0)::DOUBLE ORDER BY slot) AS embedding
  FROM (SELECT {key}, slot FROM {source}, range(64) AS u(slot)) LEFT JOIN {name}_slots USING ({key}, slot) GROUP BY {key}
)"""


EMBEDDED_SQL = f"""
questions AS (SELECT item_id AS query_id, text AS query FROM benchmark),
{BM25_SQL},
{_embedded_sql("qvecs", "questions", "query_id", "query")},
{_embedded_sql("docvecs", "documents", "doc_id", "text")},
norms AS (SELECT doc_id, embedding, sqrt(list_dot_product(embedding, embedding)) AS n FROM docvecs),
pairs AS (
  SELECT query_id, doc_id, coalesce(list_dot_product(q.embedding, d.embedding)
    / nullif(d.n * sqrt(list_dot_product(q.embedding, q.embedding)), 0), 0) AS score FROM qvecs q, norms d
),
nearest AS (SELECT query_id, doc_id, score,
                   row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
            FROM pairs QUALIFY rank <= 10)
"""

FUSE_SQL = """
lists AS (
  SELECT query_id, doc_id, rank, 0 AS list, 0.4 AS weight FROM bm25
  UNION ALL SELECT query_id, doc_id, rank, 1, 0.6 FROM vector_list
),
fused AS (
  SELECT query_id, text, sum(weight / (60 + rank)) AS score,
         min((list, rank, doc_id)) AS seen, arg_min(doc_id, (list, rank, doc_id)) AS doc_id
  FROM lists JOIN documents USING (doc_id) GROUP BY query_id, text
),
ranked AS (
  SELECT query_id, doc_id, text, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) - 1 AS rank FROM fused
)"""


@query("rrf_fusion", f"""
WITH {EMBEDDED_SQL}, vector_list AS (SELECT * FROM nearest WHERE rank <= 5), {FUSE_SQL}
SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM ranked
""")
def rrf_fusion(spark, d):
    docs, asked = table(spark, d, "documents"), embedded_passages(spark, d)
    keyword = bm25_topk(None, asked, index=keyword_index(spark, d))
    near = vector_topk(document_vectors(spark, d), asked, 5, vec_id="doc_id").select("query_id", "doc_id", "rank")
    both = keyword.select("query_id", "doc_id", "rank", F.lit(0).alias("list")).unionByName(
        near.withColumn("list", F.lit(1)))
    with_text = docs.select("doc_id", "text").join(bounded(both, label="lists"), "doc_id")
    parts = stage(with_text, "lists-text")
    fused = rank_fusion([(parts.where("list = 0"), 0.4), (parts.where("list = 1"), 0.6)])
    return fused.select("query_id", "doc_id", six("score", "score"), "rank")


@query("hybrid_retrieve", f"""
WITH {EMBEDDED_SQL},
pool AS (SELECT * FROM nearest),
{_mmr_steps('pool', 'docvecs', 'doc_id')},
vector_list AS (SELECT query_id, doc_id, pick AS rank FROM chosen5),
{FUSE_SQL}
SELECT query_id, doc_id, lang, source, round(score, 6) AS score, rank::INT AS rank
FROM ranked JOIN documents USING (doc_id) WHERE rank < 5
""")
def hybrid_retrieve_query(spark, d):
    hits = hybrid_retrieve(table(spark, d, "documents"), embedded_passages(spark, d), vectors=document_vectors(spark, d),
                           carry=("lang", "source"), index=keyword_index(spark, d))
    return hits.select("query_id", "doc_id", "lang", "source", six("score", "score"), "rank")


@query("text_embedding", f"""
WITH {TOKENS_SQL},
slots AS (
  SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS slot,
         sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS v
  FROM occurrences GROUP BY 1, 2
)
SELECT doc_id, slot::INT AS slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value
FROM slots QUALIFY v <> 0
""")
def text_embedding(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    vectors = docs.select("doc_id", F.posexplode_outer(embed_text("text")).alias("slot", "v"))
    return vectors.where(F.col("v") != 0).select("doc_id", "slot", six("v", "value"))
