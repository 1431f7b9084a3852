"""Graph building over document lines, and graph retrieval over parts and suppliers."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lodeseek.operators.community import (
    community_evidence, detect_communities, undirected_edges,
)
from lodeseek.operators.chunking import number_chunks
from lodeseek.operators.graph_build import (
    PropertyGraph, document_rows, duplicate_keys, existing_chunk_ids, extraction_totals, graph_stats, integrity,
    merge_entities, merge_mentions, merge_relations, node_rows, normalize, orphan_entities, rel_id_coverage,
    relation_rows, retry_targets, reverse_samples, stamp_relation_ids, term_graph, uncovered_chunks,
)
from lodeseek.operators.graph_search import (
    expand_relations, graph_retrieve, nested_hits, select_mode, top_communities,
)
from lodeseek.plans.graph_index import graph_store, load_chunks, load_saved
from lodeseek.plans.queries_index import LINES_SQL, document_lines, slug_sql
from lodeseek.plans.queries_rank import VECTOR_QUESTIONS_SQL, label_vectors, six
from lodeseek.plans.registry import query, table
from lodeseek.runtime import free_shuffles, shared_dir, small_files, stage, unstage

# ---- a text graph: long words of every document line --------------------------

TEXT_GRAPH_SQL = f"""
WITH {LINES_SQL},
chunks AS (SELECT *, row_number() OVER (ORDER BY doc_id, piece) - 1 AS seq FROM lines),
terms AS (
  SELECT seq, min(pos) AS pos, term FROM (
    SELECT seq, generate_subscripts(regexp_extract_all(line, '\\p{{L}}{{8,}}'), 1) AS pos,
           unnest(regexp_extract_all(line, '\\p{{L}}{{8,}}')) AS term FROM chunks
  ) GROUP BY seq, term
),
linked AS (SELECT seq, pos, term, lead(term) OVER (PARTITION BY seq ORDER BY pos) AS next FROM terms),
nodes AS (SELECT seq, 'ent_' || {slug_sql('term')} AS id, arg_min(term, pos) AS name FROM terms GROUP BY 1, 2),
rels AS (
  SELECT seq, pos, 'ent_' || {slug_sql('term')} AS src, 'ent_' || {slug_sql('next')} AS dst,
         'rel_' || {slug_sql('term')} || '_part_of_' || {slug_sql('next')} AS rel_id
  FROM linked WHERE next IS NOT NULL
)"""


def line_chunks(spark, d):
    """Document lines as numbered chunks."""
    numbered = number_chunks(document_lines(spark, d), ["doc_id"])
    return numbered.select("chunk_id", "seq", F.col("line").alias("text"), "source", F.col("lang").alias("heading_path"))


def normalized_lines(spark, d):
    return normalize(term_graph(line_chunks(spark, d)))


@query("entity_normalize", f"{TEXT_GRAPH_SQL} SELECT 'chunk_' || seq AS chunk_id, id AS entity_id, name FROM nodes")
def entity_normalize(spark, d):
    return node_rows(normalized_lines(spark, d)).select("chunk_id", "entity_id", "name")


@query("relation_normalize", f"""{TEXT_GRAPH_SQL}
SELECT 'chunk_' || seq AS chunk_id, (row_number() OVER (PARTITION BY seq ORDER BY pos) - 1)::INT AS pos,
       src, 'PART_OF' AS type, dst, rel_id FROM rels
""")
def relation_normalize(spark, d):
    return relation_rows(normalized_lines(spark, d)).select("chunk_id", "pos", "src", "type", "dst", "rel_id")


@query("extraction_totals", f"""{TEXT_GRAPH_SQL}
SELECT (SELECT count(*) FROM chunks) AS documents, (SELECT count(*) FROM nodes) AS nodes,
       (SELECT count(*) FROM rels) AS relations
""")
def extraction_totals_query(spark, d):
    return extraction_totals(normalized_lines(spark, d))


@query("merged_entities", f"{TEXT_GRAPH_SQL} SELECT id, arg_max(name, seq) AS name FROM nodes GROUP BY id")
def merged_entities(spark, d):
    return merge_entities(node_rows(normalized_lines(spark, d), "seq")).select("id", "name")


@query("mentions", f"{TEXT_GRAPH_SQL} SELECT DISTINCT 'chunk_' || seq AS chunk_id, id AS entity_id FROM nodes")
def mentions(spark, d):
    return merge_mentions(node_rows(normalized_lines(spark, d)))


@query("entity_rels", f"{TEXT_GRAPH_SQL} SELECT src, 'PART_OF' AS type, dst, max(rel_id) AS rel_id FROM rels GROUP BY src, dst")
def entity_rels(spark, d):
    return merge_relations(relation_rows(normalized_lines(spark, d)))


@query("uncovered_chunks", f"""{TEXT_GRAPH_SQL}
SELECT 'chunk_' || seq AS chunk_id FROM chunks WHERE seq NOT IN (SELECT seq FROM nodes)
""")
def uncovered_chunks_query(spark, d):
    chunks = stage(line_chunks(spark, d), "chunks")
    covered = node_rows(normalize(term_graph(chunks))).select("chunk_id")
    return uncovered_chunks(chunks, covered).select("chunk_id")


def text_graph(spark, d) -> PropertyGraph:
    """The text graph as six tables, one community per source."""
    chunks = stage(line_chunks(spark, d), "chunks")
    found = stage(normalize(term_graph(chunks)), "normalized")
    nodes = node_rows(found, "seq", "source")
    entities = merge_entities(nodes)
    member = nodes.groupBy("entity_id").agg(F.concat(F.lit("comm_"), F.min("source")).alias("comm_id"))
    communities = member.groupBy(F.col("comm_id").alias("id")).agg(
        F.count(F.lit(1)).alias("size")).withColumn("summary", F.col("id"))
    none = F.lit(None).cast("array<double>")
    return PropertyGraph(
        entities=entities.withColumn("embedding", none).withColumn("community", F.lit(None).cast("string")),
        documents=document_rows(chunks), communities=communities, mentions=merge_mentions(nodes),
        entity_rels=merge_relations(relation_rows(found)), in_community=member)


STATS_SQL = f"""{TEXT_GRAPH_SQL},
e AS (SELECT DISTINCT id FROM nodes), m AS (SELECT DISTINCT seq, id FROM nodes), r AS (SELECT DISTINCT src, dst FROM rels),
c AS (SELECT id, min(source) AS comm FROM nodes JOIN chunks USING (seq) GROUP BY id),
k AS (SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM chunks) AS documents,
             (SELECT count(DISTINCT comm) FROM c) AS communities, (SELECT count(*) FROM m) AS mentions,
             (SELECT count(*) FROM r) AS entity_rels, (SELECT count(*) FROM c) AS members)
SELECT entities + documents + communities AS nodes, entities, documents, communities,
       mentions + entity_rels + members AS relationships, mentions, entity_rels,
       0::BIGINT AS entity_embeddings, 0::BIGINT AS chunk_embeddings, 0::BIGINT AS orphan_entities,
       true AS integrity_ok FROM k
"""


@query("graph_integrity", STATS_SQL)
def graph_integrity(spark, d):
    return integrity(graph_stats(text_graph(spark, d)))


@query("reverse_samples", f"""{TEXT_GRAPH_SQL},
m AS (SELECT DISTINCT id, 'chunk_' || seq AS chunk_id, source FROM nodes JOIN chunks USING (seq))
SELECT id AS entity, array_to_string(list_sort(list(DISTINCT chunk_id))[:5], ',') AS chunks,
       array_to_string(list_sort(list(DISTINCT source))[:5], ',') AS sources
FROM m GROUP BY id ORDER BY least(count(DISTINCT chunk_id), 5) DESC, id LIMIT 3
""")
def reverse_samples_query(spark, d):
    """A three-row report by design."""
    few = reverse_samples(text_graph(spark, d))
    return few.select("entity", F.array_join("chunks", ",").alias("chunks"), F.array_join("sources", ",").alias("sources"))


@query("communities")
def communities_query(spark, d):
    """Communities of the co-occurrence graph; modularity and cover are asserted by the tests."""
    edges = stage(undirected_edges(merge_relations(relation_rows(normalized_lines(spark, d)))), "edges")
    return detect_communities(edges)


# ---- a part-supplier graph: relational tables as a property graph -------------

def part_graph(spark, d) -> PropertyGraph:
    """Parts and suppliers as entities, lineitem pairs as USES edges, documents as chunks.

    Vectors pair with parts and documents by number; brands and nations are communities.
    """
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    text = lambda c: F.col(c).cast("string")
    parts = part.join(vectors, F.col("p_partkey") == F.col("vec_id"), "left").select(
        F.concat(F.lit("ent_part_"), text("p_partkey")).alias("id"), F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"), F.lit("Concept").alias("type"), "embedding",
        F.concat(F.lit("comm_"), "p_brand").alias("community"))
    suppliers = supplier.select(
        F.concat(F.lit("ent_supplier_"), text("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
        F.lit(None).cast("string").alias("description"), F.lit("Tool").alias("type"),
        F.lit(None).cast("array<double>").alias("embedding"),
        F.concat(F.lit("comm_nation_"), text("s_nationkey")).alias("community"))
    entities = parts.unionByName(suppliers)
    rels = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct().select(
        F.concat(F.lit("ent_part_"), text("l_partkey")).alias("src"), F.lit("USES").alias("type"),
        F.concat(F.lit("ent_supplier_"), text("l_suppkey")).alias("dst"), F.lit(None).cast("string").alias("rel_id"))
    docs = table(spark, d, "documents")
    chunk = F.concat(F.lit("chunk_"), text("doc_id"))
    documents = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
        chunk.alias("id"), chunk.alias("chunk_id"), "text", "source", F.col("lang").alias("heading_path"), "embedding")
    communities = entities.groupBy(F.col("community").alias("id")).agg(F.count(F.lit(1)).alias("size")).select(
        "id", F.concat(F.col("id"), F.lit(" of "), text("size")).alias("summary"), "size")
    mention = docs.join(part, F.col("doc_id") == F.col("p_partkey")).select(
        chunk.alias("chunk_id"), F.concat(F.lit("ent_part_"), text("p_partkey")).alias("entity_id"))
    return PropertyGraph(
        entities, documents, communities, mention, stamp_relation_ids(rels).drop("stamped"),
        entities.select(F.col("id").alias("entity_id"), F.col("community").alias("comm_id")))


PART_GRAPH_SQL = f"""
WITH {VECTOR_QUESTIONS_SQL},
entities AS (
  SELECT 'ent_part_' || p_partkey AS id, p_name AS name, p_type || ' ' || p_brand AS description,
         embedding::DOUBLE[] AS embedding, 'comm_' || p_brand AS community
  FROM part LEFT JOIN embeddings ON vec_id = p_partkey
  UNION ALL SELECT 'ent_supplier_' || s_suppkey, s_name, NULL, NULL, 'comm_nation_' || s_nationkey FROM supplier
),
edges AS (
  SELECT DISTINCT 'ent_part_' || l_partkey AS src, 'ent_supplier_' || l_suppkey AS dst,
         'rel_part_' || l_partkey || '_uses_supplier_' || l_suppkey AS rel_id FROM lineitem
),
communities AS (SELECT community AS id, count(*) AS size FROM entities GROUP BY community),
near AS (
  SELECT query_id, id, name, coalesce(description, '') AS description, community, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM (SELECT query_id, e.*, list_cosine_similarity(q, embedding) AS score FROM questions, entities e
        WHERE embedding IS NOT NULL) QUALIFY rank <= 8
),
chunk_near AS (
  SELECT query_id, chunk_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM (SELECT query_id, 'chunk_' || doc_id AS chunk_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS score
        FROM questions, documents JOIN embeddings ON vec_id = doc_id) QUALIFY rank <= 8
),
hops AS (
  SELECT src, dst, rel_id, row_number() OVER (PARTITION BY src ORDER BY rel_id, dst) AS pos FROM edges
  WHERE src IN (SELECT id FROM near) QUALIFY pos <= 8
),
relations AS (
  SELECT query_id, rank AS entity_rank, pos, rel_id, src, dst FROM near JOIN hops ON src = id
),
comm AS (
  SELECT query_id, id, size, row_number() OVER (PARTITION BY query_id ORDER BY size DESC, id) AS rank
  FROM (SELECT DISTINCT query_id, community AS id FROM near) JOIN communities USING (id) QUALIFY rank <= 6
)"""


def _rows_sql(parts: list[str]) -> str:
    return PART_GRAPH_SQL + " UNION ALL ".join(parts)


ENTITY_ROWS = "SELECT query_id, 'entity' AS kind, rank::INT AS rank, id AS key, round((1 + score) / 2, 6) AS score FROM near"
CHUNK_ROWS = "SELECT query_id, 'chunk', rank::INT, chunk_id, round((1 + score) / 2, 6) FROM chunk_near WHERE rank <= {k}"
RELATION_ROWS = ("SELECT query_id, 'relation', row_number() OVER (PARTITION BY query_id ORDER BY entity_rank, pos)::INT, "
                 "rel_id, NULL FROM relations")
COMMUNITY_ROWS = "SELECT query_id, 'community', rank::INT, id, size::DOUBLE FROM comm"


def _hit_rows(spark, d, mode):
    """All four result kinds of one mode in one tidy frame."""
    asked = label_vectors(spark, d).withColumn("mode", F.lit(mode))
    hits = graph_retrieve(part_graph(spark, d), asked)

    def rows(df, kind, key, score):
        return df.select("query_id", F.lit(kind).alias("kind"), F.col("rank").cast("int").alias("rank"),
                         F.col(key).alias("key"), score.cast("double").alias("score"))

    return (
        rows(hits.entities, "entity", "id", F.round("score", 6))
        .unionByName(rows(hits.chunks, "chunk", "chunk_id", F.round("score", 6)))
        .unionByName(rows(hits.relations, "relation", "rel_id", F.lit(None)))
        .unionByName(rows(hits.communities, "community", "id", F.col("size")))
    )


@query("graph_local", _rows_sql([ENTITY_ROWS, CHUNK_ROWS.format(k=8), RELATION_ROWS]))
def graph_local(spark, d):
    return _hit_rows(spark, d, "local")


@query("graph_global", _rows_sql([ENTITY_ROWS, CHUNK_ROWS.format(k=4), COMMUNITY_ROWS]))
def graph_global(spark, d):
    return _hit_rows(spark, d, "global")


@query("graph_hybrid", _rows_sql([ENTITY_ROWS, CHUNK_ROWS.format(k=8), RELATION_ROWS, COMMUNITY_ROWS]))
def graph_hybrid(spark, d):
    return _hit_rows(spark, d, "hybrid")


@query("graph_nested", PART_GRAPH_SQL + """
SELECT query_id, 'hybrid' AS mode,
       (SELECT string_agg(id, ',' ORDER BY rank) FROM near n WHERE n.query_id = q.query_id) AS entity_ids,
       (SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM chunk_near n WHERE n.query_id = q.query_id) AS chunk_ids,
       (SELECT count(*) FROM relations n WHERE n.query_id = q.query_id)::INT AS n_relations,
       (SELECT string_agg(id, ',' ORDER BY rank) FROM comm n WHERE n.query_id = q.query_id) AS community_ids
FROM questions q
""")
def graph_nested(spark, d):
    asked = label_vectors(spark, d).withColumn("mode", F.lit("hybrid"))
    out = nested_hits(asked, graph_retrieve(part_graph(spark, d), asked))
    joined = lambda c: F.array_join(F.col(c), ",")
    return out.select("query_id", "mode", joined("entities.id").alias("entity_ids"),
                      joined("chunks.chunk_id").alias("chunk_ids"), F.size("relations").alias("n_relations"),
                      joined("communities.id").alias("community_ids"))


@query("one_hop_expand", """
WITH edges AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT 'ent_part_' || p AS source, 'ent_supplier_' || s AS target, s_name AS target_name, pos::INT AS pos FROM (
  SELECT p, s, s_name, row_number() OVER (PARTITION BY p ORDER BY
         'rel_part_' || p || '_uses_supplier_' || s, 'ent_supplier_' || s) AS pos
  FROM edges JOIN supplier ON s_suppkey = s) WHERE pos <= 8
""")
def one_hop_expand(spark, d):
    graph = part_graph(spark, d)
    return expand_relations(graph, graph.entities).select("source", "target", "target_name", "pos")


@query("community_topk", """
WITH c AS (SELECT p_type, 'comm_' || p_brand AS id, count(*) AS n FROM part GROUP BY ALL),
sizes AS (SELECT 'comm_' || p_brand AS id, count(*) AS size FROM part GROUP BY ALL)
SELECT p_type AS query_id, id, size, row_number() OVER (PARTITION BY p_type ORDER BY size DESC, id)::INT AS rank
FROM c JOIN sizes USING (id) QUALIFY rank <= 6
""")
def community_topk(spark, d):
    """Largest brands seen under each part type."""
    graph = part_graph(spark, d)
    wanted = table(spark, d, "part").select(
        F.col("p_type").alias("query_id"), F.concat(F.lit("comm_"), "p_brand").alias("id"))
    return top_communities(graph.communities, wanted).select("query_id", "id", "size", "rank")


@query("community_evidence", """
WITH named AS (
  SELECT DISTINCT 'comm_' || p_brand AS comm_id, p_name AS name FROM part
  UNION SELECT 'comm_nation_' || s_nationkey, s_name FROM supplier),
sizes AS (
  SELECT 'comm_' || p_brand AS comm_id, count(*) AS size FROM part GROUP BY ALL
  UNION ALL SELECT 'comm_nation_' || s_nationkey, count(*) FROM supplier GROUP BY ALL),
texts AS (
  SELECT comm_id, text, row_number() OVER (PARTITION BY comm_id ORDER BY chunk_id) AS place FROM (
    SELECT 'comm_' || p_brand AS comm_id, text, min('chunk_' || doc_id) AS chunk_id
    FROM part JOIN documents ON doc_id = p_partkey WHERE text <> '' GROUP BY 1, 2) QUALIFY place <= 3)
SELECT comm_id, size, array_to_string(list_sort(list(DISTINCT name))[:40], ',') AS names,
       coalesce(left((SELECT string_agg(text, chr(10) || '---' || chr(10) ORDER BY place) FROM texts t
                      WHERE t.comm_id = s.comm_id), 3000), '') AS context
FROM sizes s JOIN named USING (comm_id) GROUP BY comm_id, size
""")
def community_evidence_query(spark, d):
    graph = part_graph(spark, d)
    out = community_evidence(graph.in_community, graph.entities, graph.mentions, graph.documents)
    return out.select("comm_id", "size", F.array_join("names", ",").alias("names"), "context")


@query("rel_coverage", """
SELECT count(*) AS with_id, count(*) AS total FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
""")
def rel_coverage(spark, d):
    return rel_id_coverage(part_graph(spark, d).entity_rels)


@query("stamped_relations", """
SELECT DISTINCT 'rel_part_' || l_partkey || '_uses_supplier_' || l_suppkey AS rel_id, true AS stamped FROM lineitem
""")
def stamped_relations(spark, d):
    rels = part_graph(spark, d).entity_rels.withColumn("rel_id", F.lit(None).cast("string"))
    return stamp_relation_ids(rels).select("rel_id", "stamped")


@query("orphan_entities", """
SELECT 'ent_part_' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'ent_supplier_' || s_suppkey FROM supplier
""")
def orphan_entities_query(spark, d):
    return orphan_entities(part_graph(spark, d)).select("id")


@query("part_graph_stats", """
WITH k AS (SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS entities,
  (SELECT count(*) FROM documents) AS documents,
  (SELECT count(DISTINCT p_brand) FROM part) + (SELECT count(DISTINCT s_nationkey) FROM supplier) AS communities,
  (SELECT count(*) FROM documents JOIN part ON doc_id = p_partkey) AS mentions,
  (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS entity_rels)
SELECT entities + documents + communities AS nodes, entities, documents, communities,
  mentions + entity_rels + entities AS relationships, mentions, entity_rels,
  (SELECT count(*) FROM part JOIN embeddings ON vec_id = p_partkey) AS entity_embeddings,
  (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id) AS chunk_embeddings,
  entities - mentions AS orphan_entities FROM k
""")
def part_graph_stats(spark, d):
    return graph_stats(part_graph(spark, d))


@query("duplicate_keys", """
SELECT 'document' AS node_table, text AS id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1
""")
def duplicate_keys_query(spark, d):
    """Copies of one text break uniqueness once the text is taken as the document id."""
    from dataclasses import replace

    graph = part_graph(spark, d)
    return duplicate_keys(replace(graph, documents=graph.documents.withColumn("id", F.col("text"))))


@query("retry_targets", """
SELECT DISTINCT 'chunk_' || doc_id AS chunk_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def retry_targets_query(spark, d):
    """Labelled documents are loaded already; toxic ones failed."""
    chunk = F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("chunk_id")
    labels = table(spark, d, "labels")
    existing = existing_chunk_ids(labels.select(chunk))
    return retry_targets(table(spark, d, "documents").select(chunk), existing, labels.where("toxic = 1").select(chunk))


MODE_CASE = """
CASE WHEN {hybrid} THEN 'hybrid' WHEN {glob} THEN 'global' WHEN {local} THEN 'local' ELSE 'hybrid' END
"""


def _mode_sql() -> str:
    from lodeseek.operators.graph_search import GLOBAL_SIGNALS, HYBRID_SIGNALS, LOCAL_SIGNALS

    def any_of(column, signals):
        return "(" + " OR ".join(f"contains({column}, '{s}')" for s in signals) + ")"

    strip = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
    low = f"lower(regexp_replace(text, '^{strip}|{strip}$', '', 'g'))"
    return MODE_CASE.format(hybrid=any_of(low, HYBRID_SIGNALS), glob=any_of("text", GLOBAL_SIGNALS),
                            local=any_of("text", LOCAL_SIGNALS))


@query("mode_select", f"""
SELECT conv_id, turn, {_mode_sql()} AS mode,
       contains(lower(text), 'vs') OR contains(lower(text), 'before') AS worded
FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN text ELSE '무엇 ' || text END AS text FROM conversations)
""")
def mode_select(spark, d):
    """Mode of every conversation turn; answers carry a definition word in front."""
    text = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(F.lit("무엇 "), F.col("text")))
    turns = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))
    low = F.lower("text")
    return turns.select("conv_id", "turn", select_mode("text").alias("mode"),
                        (low.contains("vs") | low.contains("before")).alias("worded"))


@query("graph_load", f"""{TEXT_GRAPH_SQL}
SELECT 'entity' AS kind, id AS a, arg_max(name, seq) AS b, '' AS c FROM nodes GROUP BY id
UNION ALL SELECT DISTINCT 'mention', 'chunk_' || seq, id, '' FROM nodes
UNION ALL SELECT 'relation', src, dst, max(rel_id) FROM rels GROUP BY src, dst
UNION ALL SELECT 'document', 'chunk_' || seq, source, lang FROM chunks
""")
def graph_load(spark, d):
    """The stored graph after three loads: the earlier chunks, the later ones, and the earlier ones once more but without nodes."""
    path = os.path.join(shared_dir(spark), "stages", f"graph-{uuid.uuid4().hex}")
    store = graph_store(spark, path)
    with small_files(spark):
        chunks = stage(line_chunks(spark, d), "chunks")
        half = chunks.count() // 2
        parts = {side: chunks.where(where) for side, where in (("early", F.col("seq") < half), ("late", F.col("seq") >= half))}
        for part in parts.values():
            found = stage(normalize(term_graph(part)).select("chunk_id", "seq", "nodes", "rels"), "found")
            free_shuffles(spark)
            with store.change() as change:
                load_chunks(change, part, found, spent=True)
        with store.change() as change:
            load_chunks(change, parts["early"], spark.createDataFrame([], found.schema))
        unstage(chunks)
    graph = load_saved(spark, path)
    rows = [
        graph.entities.select(F.lit("entity").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.lit("").alias("c")),
        graph.mentions.select(F.lit("mention"), "chunk_id", "entity_id", F.lit("")),
        graph.entity_rels.select(F.lit("relation"), "src", "dst", "rel_id"),
        graph.documents.select(F.lit("document"), "id", "source", "heading_path"),
    ]
    return reduce(DataFrame.union, rows)
