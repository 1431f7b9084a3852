"""Markdown to property graph: split, extract, load, communities, verify."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.functions.vectors import Embedder
from lodeseek.operators.chunking import number_chunks, text_chunks
from lodeseek.operators.community import (
    community_evidence, detect_communities, summarize, undirected_edges, write_communities,
)
from lodeseek.operators.filters import retryable, select_chunks
from lodeseek.operators.graph_build import (
    EMPTY, OK, PropertyGraph, allowed_only, embed_missing, empty_graph, existing_chunk_ids, extract_with_retry,
    extracted_graph, graph_stats, integrity, merge_graphs, normalize, retry_targets, stamp_relation_ids, term_graph,
)
from lodeseek.operators.bounded import staged_hint
from lodeseek.runtime import free_shuffles, plan_bytes, ship_package, stage, unstage
from lodeseek.sources.store import Change, Spec, Store
from lodeseek.sources.files import default_graph_schema, failed_chunks, graph_schema, markdown_docs, write_json_report

TABLES = tuple(PropertyGraph.__dataclass_fields__)


@dataclass(frozen=True)
class GraphRun:
    graph: PropertyGraph
    outcomes: DataFrame   # chunk_id, outcome, detail
    stats: DataFrame      # one row with integrity_ok


def corpus_chunks(spark: SparkSession, folder: str, limit_docs: int | None = None, cfg: Tunables = DEFAULTS) -> DataFrame:
    """(seq, chunk_id, source, heading_path, text) of the folder's markdown in path order."""
    docs = markdown_docs(spark, folder)
    if limit_docs:
        docs = docs.orderBy("path").limit(limit_docs)
    pieces = stage(text_chunks(docs, ["path"], cfg), "pieces")
    return stage(number_chunks(pieces, ["path"]), "chunks")


#: The key of each table.
KEYS = {"entities": ("id",), "documents": ("id",), "communities": ("id",), "mentions": ("chunk_id", "entity_id"),
        "entity_rels": ("src", "type", "dst"), "in_community": ("entity_id", "comm_id")}


def graph_store(spark: SparkSession, store: str) -> Store:
    """The six tables, changed together."""
    empty = empty_graph(spark)
    return Store(spark, os.path.join(store, "graph"), {name: Spec(getattr(empty, name).schema, KEYS[name]) for name in TABLES})


def load_saved(spark: SparkSession, store: str) -> PropertyGraph:
    """The saved graph, or an empty one."""
    tables = graph_store(spark, store)
    return PropertyGraph(*(tables.read(name) for name in TABLES))


def load_chunks(change: Change, chunks: DataFrame, normalized: DataFrame, spent: bool = False) -> None:
    """Merge one extraction run into the stored graph.

    Only rows of the keys that the run touches are looked up, in their buckets; the rest of the graph isn't read. Rows that are
    stored already as they are aren't written again, texts are read and sent only where they are new or changed, and what was
    written on the way is removed. ``chunks`` is read several times; with ``spent``, ``normalized`` is a staged frame that is removed
    once its rows are merged.
    """
    narrow = ("entity_rels", "mentions", "entities")
    fresh = extracted_graph(chunks, normalized)
    fresh = replace(fresh, **{name: _written(getattr(fresh, name), name) for name in narrow})
    if spent:
        unstage(normalized)
    stored = {name: _written(change.rows(name, keys).join(keys, list(KEYS[name]), "left_semi"), f"stored-{name}")
              for name in narrow for keys in (getattr(fresh, name).select(*KEYS[name]),)}
    documents, old_documents, unique, size, staged = _changed_documents(change, fresh.documents)
    merged = merge_graphs(replace(fresh, **stored, documents=old_documents), replace(fresh, documents=documents))
    merged = replace(merged, entity_rels=stamp_relation_ids(merged.entity_rels).drop("stamped"))
    for name in narrow:
        changed = _written(_changed(getattr(merged, name), stored[name], KEYS[name]), f"changed-{name}")
        unstage(getattr(fresh, name), stored[name])
        change.upsert(name, changed, unique=True, size=plan_bytes(changed))  # by the merge each key is there once
        unstage(changed)
        free_shuffles(chunks.sparkSession)
    change.upsert("documents", merged.documents, unique=unique, size=size)
    unstage(*staged)
    free_shuffles(chunks.sparkSession)


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` staged, and what was shuffled for it removed."""
    staged = stage(df, label)
    free_shuffles(df.sparkSession)
    return staged


def _changed(rows: DataFrame, stored: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows that aren't stored as they are."""
    rest = [c for c in rows.columns if c not in key]
    was = stored.select(*key, F.struct(*key, *rest).alias("_was"))
    same = F.col("_was").isNotNull()
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"_was.{c}"))
    return rows.join(was, list(key), "left").where(~same).select(*rows.columns)


def _changed_documents(change: Change, fresh: DataFrame) -> tuple[DataFrame, DataFrame, bool, int, list[DataFrame]]:
    """New or changed documents, the stored ones of their ids, whether no id repeats, about their bytes, and what is staged for them.

    Found by ids and digests, so no text is sent for documents that are stored as they are or weren't stored at all.
    """
    said = F.sha2(F.to_json(F.struct("chunk_id", "text", "source", "heading_path")), 256).alias("said")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes")
    told = _written(fresh.select("id", said, size), "told")
    ids = told.select("id")
    same, few_same = staged_hint(
        told.join(change.rows("documents", ids, shown=["id", said]), ["id", "said"], "left_semi").select("id", "said").distinct(), label="same")
    changed = told.join(few_same(same), ["id", "said"], "left_anti")
    count, total, most = changed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).agg(
        F.sum("n"), F.sum("bytes"), F.max("n")).first()
    replaced, few = staged_hint(
        changed.select("id").join(change.rows("documents", ids, shown=["id"]), "id", "left_semi").distinct(), label="replaced")
    stored = change.rows("documents", ids)
    unstage(told)
    free_shuffles(fresh.sparkSession)
    old = stored.limit(0) if replaced.isEmpty() else stored.join(few(replaced), "id", "left_semi")
    if not count:
        fresh = fresh.limit(0)
    elif not same.isEmpty():
        fresh = fresh.withColumn("said", said).join(few_same(same), ["id", "said"], "left_anti").drop("said")
    return fresh, old, most == 1, (total or 0) // 2, [same, replaced]  # texts are written at about half their bytes


def embed_stored(change: Change, embedder: Embedder | None = None) -> None:
    """Vectors for stored nodes that have none."""
    graph = PropertyGraph(*(change.rows(name) for name in TABLES))
    bare = replace(graph, entities=graph.entities.where("embedding is null"), documents=graph.documents.where("embedding is null"))
    done = embed_missing(bare, embedder)
    for name in ("entities", "documents"):
        change.upsert(name, getattr(done, name))


def add_communities(graph: PropertyGraph, summarizer=None, cfg: Tunables = DEFAULTS) -> PropertyGraph:
    """Detect, summarise and write back; a graph without relations is returned as it is."""
    edges = stage(undirected_edges(graph.entity_rels), "edges")
    if edges.isEmpty():
        return graph
    membership = stage(detect_communities(edges, cfg.community_seed), "membership")
    evidence = community_evidence(membership, graph.entities, graph.mentions, graph.documents, cfg)
    return write_communities(graph, membership, stage(summarize(evidence, summarizer), "summaries"))


def run_graph_index(spark: SparkSession, folder: str, store: str, *, reset: bool = False, retry_failed: bool = False,
                    limit_docs: int | None = None, max_chunks: int | None = None, skip_community: bool = False,
                    vectors: bool = True, extractor=None, summarizer=None, embedder: Embedder | None = None,
                    schema_path: str | None = None, cfg: Tunables = DEFAULTS) -> GraphRun:
    """Index a folder into the graph at ``store`` and verify it."""
    ship_package(spark)
    tables = graph_store(spark, store)
    with tables.change() as change:  # one version for the whole run
        if reset:
            for name in TABLES:
                change.clear(name)
        found = _extract(spark, change, folder, os.path.join(store, "extract-report"), retry_failed, limit_docs, max_chunks, extractor, schema_path, cfg)
        if vectors:
            embed_stored(change, embedder)
        if not skip_community:
            _communities(change, summarizer, cfg)
    outcomes = found.select("chunk_id", "outcome", "detail")
    failures = outcomes.where(retryable("outcome")).select("chunk_id", F.col("outcome").alias("reason"), "detail")
    write_json_report(failures, os.path.join(store, "extract-report"))
    graph = load_saved(spark, store).staged()
    return GraphRun(graph, outcomes, stage(integrity(graph_stats(graph)), "stats"))


def _communities(change: Change, summarizer, cfg: Tunables) -> None:
    """Write communities, their members, and the entities whose community is another now."""
    graph = PropertyGraph(*(change.rows(name) for name in TABLES)).staged()
    new = add_communities(graph, summarizer, cfg)
    if new is graph:
        return
    change.overwrite("communities", new.communities)
    change.overwrite("in_community", new.in_community)
    before = graph.entities.select("id", F.col("community").alias("_before"))
    change.upsert("entities", new.entities.join(before, "id").where(~F.col("community").eqNullSafe(F.col("_before"))).drop("_before"))


def _extract(spark, change, folder, report, retry_failed, limit_docs, max_chunks, extractor, schema_path, cfg) -> DataFrame:
    """Extract the folder's chunks and load them; returns (chunk_id, nodes, rels, outcome, detail)."""
    every = corpus_chunks(spark, folder, limit_docs, cfg)
    only = None
    if retry_failed:
        only = stage(retry_targets(every, existing_chunk_ids(change.rows("documents")), failed_chunks(spark, report)), "targets")
    chunks = stage(select_chunks(every, only, max_chunks), "selected")
    if extractor is None:
        found = term_graph(chunks.select("chunk_id", "text")).withColumn(
            "outcome", F.when(F.size("nodes") == 0, F.lit(EMPTY)).otherwise(F.lit(OK))).withColumn(
            "detail", F.lit(None).cast("string"))
    else:
        found = extract_with_retry(chunks, extractor)
    found = stage(found, "found")
    node_types, triples, _ = graph_schema(spark, schema_path or default_graph_schema())
    good = normalize(allowed_only(found.where(F.col("outcome") == OK), node_types, triples))
    load_chunks(change, chunks, stage(good.select("chunk_id", "nodes", "rels"), "normalized"))
    return found
