"""Graph retrieval for a batch of queries: local, global and hybrid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.functions.text import col_of, py_strip
from lodeseek.functions.vectors import graph_score
from lodeseek.operators.bounded import BROADCAST_ROWS, bounded
from lodeseek.operators.graph_build import PropertyGraph
from lodeseek.operators.ordered import top_k
from lodeseek.operators.vector import vector_topk
from lodeseek.runtime import plan_bytes, stage

# Query signals per mode. Hybrid ones are looked for in the stripped,
# lower-cased query, the others in the query as written.
HYBRID_SIGNALS = (
    "관계", "차이", "차이점", "vs", "비교", "다른점", "무슨 관계", "어떤 관계",
    "전에", "먼저", "선행", "순서", "before", "먼저 알아", "미리 알아",
    "아니에요", "아닌가", "똑같", "그냥 ", "정말", "진짜로", "필요 없", "필요없",
)
GLOBAL_SIGNALS = (
    "관련 개념", "관련개념", "같이 공부", "뭐가 있", "뭐뭐", "종류", "전반", "전체적",
    "정리해", "요약해", "장단점", "어떤 것들", "어떤것들", "무엇무엇", "생태계", "흐름",
)
LOCAL_SIGNALS = (
    "뭐예요", "뭐야", "무엇", "정의", "뜻", "개념이", "이 뭔", "란?", "이란", "가 뭐",
)
MODES = ("local", "global", "hybrid")
#: Estimated bytes of the edges of one part; as rows in memory they take several times that.
EDGE_PART_BYTES = 512 << 10


def _any_of(text: Column, signals) -> Column:
    hit = F.lit(False)
    for signal in signals:
        hit = hit | text.contains(signal)
    return hit


def select_mode(query) -> Column:
    """Retrieval mode by wording: hybrid, then global, then local signals; else hybrid."""
    q = col_of(query)
    return (
        F.when(_any_of(F.lower(py_strip(q)), HYBRID_SIGNALS), F.lit("hybrid"))
        .when(_any_of(q, GLOBAL_SIGNALS), F.lit("global"))
        .when(_any_of(q, LOCAL_SIGNALS), F.lit("local"))
        .otherwise(F.lit("hybrid"))
    )


@dataclass(frozen=True)
class GraphHits:
    """Four tidy frames keyed by query_id, ranks 1-based."""

    entities: DataFrame      # query_id, rank, id, name, description, score
    chunks: DataFrame        # query_id, rank, chunk_id, text, source, heading_path, score
    relations: DataFrame     # query_id, rank, rel_id, type, source, target, target_name
    communities: DataFrame   # query_id, rank, id, summary, size


def match_entities(graph: PropertyGraph, queries: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Nearest entities per query with their columns."""
    near = vector_topk(graph.entities, queries, cfg.entity_k, vec_id="id", cfg=cfg)
    found = graph.entities.select("id", "name", "description", "community").join(bounded(near, label="near"), "id")
    return found.select(
        "query_id", "rank", "id", "name", F.coalesce("description", F.lit("")).alias("description"),
        "community", graph_score("score").alias("score"))


def rank_chunks(graph: PropertyGraph, queries: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Nearest chunks; fewer for global-only queries. Chunks without an id go after the cut."""
    near = vector_topk(graph.documents, queries, cfg.chunk_k, vec_id="id", cfg=cfg)
    allowed = F.when(F.col("mode") == "global", F.lit(cfg.global_chunk_k)).otherwise(F.lit(cfg.chunk_k))
    near = near.join(queries.select("query_id", "mode"), "query_id").where(F.col("rank") <= allowed).drop("mode")
    found = graph.documents.drop("embedding").join(bounded(near, label="near"), "id")
    return found.where(F.col("chunk_id").isNotNull()).select(
        "query_id", "rank", "chunk_id", "text", "source", "heading_path", graph_score("score").alias("score"))


def expand_relations(graph: PropertyGraph, seeds: DataFrame, cfg: Tunables = DEFAULTS, max_seeds: int = BROADCAST_ROWS) -> DataFrame:
    """(source, pos, rel_id, type, target, target_name): first outgoing edges per seed entity.

    ``seeds`` has an ``id`` column. Edges are cut to the seeds first and to
    ``rels_per_entity`` per seed by a group limit, so a hub never gathers its edges.
    With many seeds the edges are dealt out by target, in parts as many as their size asks for,
    and only what the limit leaves meets the seeds.
    """
    sources = stage(seeds.select(F.col("id").alias("src")).distinct(), "seeds")
    few = sources.count() <= max_seeds
    edges = graph.entity_rels.select("src", "type", "dst", "rel_id")
    if few:
        edges = edges.join(F.broadcast(sources), "src").distinct()
    else:
        partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = edges.repartition(max(partitions, -(-plan_bytes(edges) // EDGE_PART_BYTES)), "dst").distinct()
    targets = graph.entities.select(F.col("id").alias("dst"), F.col("name").alias("target_name"))
    order = [F.col("rel_id").asc_nulls_last(), F.col("type"), F.col("dst")]
    kept = top_k(edges.join(targets, "dst"), ["src"], order, cfg.rels_per_entity, "pos")
    kept = kept if few else kept.join(sources, "src", "left_semi")
    return kept.select(F.col("src").alias("source"), "pos", "rel_id", "type", F.col("dst").alias("target"), "target_name")


def unique_relations(relations: DataFrame) -> DataFrame:
    """First occurrence per query of each relation id, or of its triple when it has none."""
    key = F.coalesce(F.nullif(F.col("rel_id"), F.lit("")), F.concat_ws("|", "source", "type", "target"))
    first = relations.withColumn("_key", key).groupBy("query_id", "_key").agg(
        F.min(F.struct("entity_rank", "pos", "rel_id", "type", "source", "target", "target_name")).alias("r"))
    flat = first.select("query_id", "r.*")
    return top_k(flat, ["query_id"], [F.col("entity_rank"), F.col("pos")], 2**31 - 1).drop("entity_rank", "pos")


def top_communities(communities: DataFrame, wanted: DataFrame, n: int = DEFAULTS.community_n) -> DataFrame:
    """Largest summarised communities per query among ``wanted`` (query_id, id)."""
    known = communities.where(F.col("summary").isNotNull()).select("id", "summary", "size")
    return top_k(known.join(wanted.distinct(), "id"), ["query_id"], [F.desc("size"), F.col("id")], n).select(
        "query_id", "rank", "id", "summary", "size")


def graph_retrieve(graph: PropertyGraph, queries: DataFrame, cfg: Tunables = DEFAULTS) -> GraphHits:
    """Retrieve for (query_id, embedding, mode) rows; each branch serves the modes that use it."""
    queries = stage(queries.select("query_id", "embedding", "mode"), "queries")
    modes = queries.select("query_id", "mode")
    entities = stage(match_entities(graph, queries, cfg).join(modes, "query_id"), "entities")
    near = entities.where(F.col("mode") != "global")
    edges = expand_relations(graph, near, cfg)
    linked = near.select("query_id", F.col("rank").alias("entity_rank"), F.col("id").alias("source")).join(edges, "source")
    wanted = entities.where((F.col("mode") != "local") & F.col("community").isNotNull()).select(
        "query_id", F.col("community").alias("id"))
    return GraphHits(
        entities=entities.drop("community", "mode"),
        chunks=rank_chunks(graph, queries, cfg),
        relations=unique_relations(linked),
        communities=top_communities(graph.communities, wanted, cfg.community_n),
    )


def nested_hits(queries: DataFrame, hits: GraphHits) -> DataFrame:
    """One row per query: mode and four ranked arrays (all bounded by the k settings)."""
    def gather(df: DataFrame, out: str) -> DataFrame:
        columns = [c for c in df.columns if c not in ("query_id", "rank")]
        ordered = F.array_sort(F.collect_list(F.struct("rank", F.struct(*columns).alias("hit"))))
        return df.groupBy("query_id").agg(F.transform(ordered, lambda x: x["hit"]).alias(out))

    out = queries.select("query_id", "mode")
    for name in ("entities", "chunks", "relations", "communities"):
        part = gather(getattr(hits, name), name)
        empty = F.array().cast(part.schema[name].dataType)
        out = out.join(part, "query_id", "left").withColumn(name, F.coalesce(name, empty))
    return out
