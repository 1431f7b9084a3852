"""Chunks to a property graph: extraction, normalisation, merge, integrity."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeseek.functions.ids import bare_entity, entity_id, relation_id, slug
from lodeseek.functions.text import failure_reason
from lodeseek.functions.vectors import Embedder, embed_text
from lodeseek.operators.filters import retryable
from lodeseek.operators.ordered import top_k
from lodeseek.runtime import spread, stage

NODE = "struct<id:string,type:string,properties:map<string,string>>"
REL = ("struct<source:string,source_type:string,type:string,target:string,target_type:string,"
       "properties:map<string,string>>")
# Outcome names of an extraction attempt.
OK, EMPTY = "ok", "empty"

Extractor = Callable[[str], tuple[list[dict], list[dict]]]


# ---- extraction -------------------------------------------------------------

def term_graph(chunks: DataFrame, min_letters: int = 8, text: str = "text") -> DataFrame:
    """Offline extraction, all expressions: long words are concepts, neighbours are linked.

    Adds ``nodes`` and ``rels``. Each distinct long word is a Concept and each one
    is PART_OF the next, so a chunk with n words yields n - 1 relations.
    """
    terms = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\p{{L}}{{{min_letters},}}"), F.lit(0)))
    no_props = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    kind = F.lit("Concept")
    nodes = F.transform("_terms", lambda t: F.struct(t.alias("id"), kind.alias("type"), no_props.alias("properties")))
    before = F.slice("_terms", 1, F.greatest(F.size("_terms") - 1, F.lit(0)))
    after = F.slice("_terms", 2, F.size("_terms") + 1)
    rels = F.zip_with(before, after, lambda a, b: F.struct(
        a.alias("source"), kind.alias("source_type"), F.lit("PART_OF").alias("type"),
        b.alias("target"), kind.alias("target_type"), no_props.alias("properties")))
    return chunks.withColumn("_terms", terms).withColumn("nodes", nodes).withColumn("rels", rels).drop("_terms")


def extract(chunks: DataFrame, extractor: Extractor, text: str = "text") -> DataFrame:
    """Run a plugged-in extractor per chunk: adds nodes, rels, outcome and detail.

    An exception is an outcome, not a failure of the job: rate limits and parse
    errors are told apart and both may be retried (:func:`extract_with_retry`).
    """
    schema = f"chunk_id string, nodes array<{NODE}>, rels array<{REL}>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, body in zip(batch["chunk_id"], batch[text]):
                try:
                    nodes, rels = extractor(body)
                    rows.append((chunk, nodes, rels, None))
                except Exception as error:  # noqa: BLE001 - any remote failure is data here
                    rows.append((chunk, [], [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["chunk_id", "nodes", "rels", "error"])

    found = chunks.select("chunk_id", text).mapInPandas(run, schema)
    outcome = F.when(F.col("error").isNotNull(), failure_reason("error")).when(
        F.size("nodes") == 0, F.lit(EMPTY)).otherwise(F.lit(OK))
    return found.select("chunk_id", "nodes", "rels", outcome.alias("outcome"),
                        F.substring("error", 1, 200).alias("detail"))


def extract_with_retry(chunks: DataFrame, extractor: Extractor, text: str = "text") -> DataFrame:
    """One extra attempt for chunks whose first outcome may be retried."""
    first = stage(extract(chunks, extractor, text), "extracted")
    failed = first.where(retryable("outcome")).select("chunk_id")
    again = extract(chunks.join(failed, "chunk_id", "left_semi"), extractor, text)
    return first.where(~retryable("outcome")).unionByName(again)


def allowed_only(graph_docs: DataFrame, node_types: list[str], triples: DataFrame) -> DataFrame:
    """Keep schema-conforming nodes and relations; the schema is a short list."""
    allowed = [tuple(r) for r in triples.collect()]
    type_ok = F.array(*(F.lit(t) for t in node_types))
    rel_ok = F.array(*(F.lit("\t".join(t)) for t in allowed))
    return graph_docs.withColumn(
        "nodes", F.filter("nodes", lambda n: F.array_contains(type_ok, n["type"]))
    ).withColumn("rels", F.filter("rels", lambda r: F.array_contains(
        rel_ok, F.concat_ws("\t", r["source_type"], r["type"], r["target_type"]))))


# ---- normalisation ----------------------------------------------------------

def normalize(graph_docs: DataFrame) -> DataFrame:
    """Nodes keyed ``ent_<slug>``, first seen wins, endpoints added; relations rewired, not merged.

    Works inside each chunk's arrays: no shuffle. Nodes come out as
    (entity_id, type, name, properties) in first-seen order; relations as
    (src, type, dst, rel_id, properties).
    """
    def candidate(identifier: Column, known: Column, kind: Column, props: Column) -> Column:
        name = F.coalesce(F.try_element_at(props, F.lit("name")), identifier)
        return F.struct(known.alias("entity_id"), kind.alias("type"), name.alias("name"), props.alias("properties"))

    no_props = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    # ids are made once per node, relation end and kind of relation
    ends = F.transform("rels", lambda r: F.struct(entity_id(r["source"]).alias("src"), entity_id(r["target"]).alias("dst")))
    kinds = F.array_compact(F.array_distinct(F.col("rels.type")))
    slugs = F.map_from_arrays("_kinds", F.transform("_kinds", slug))
    declared = F.transform("nodes", lambda n: candidate(n["id"], entity_id(n["id"]), n["type"], n["properties"]))
    endpoints = F.flatten(F.zip_with("rels", "_ends", lambda r, e: F.array(
        candidate(r["source"], e["src"], r["source_type"], no_props), candidate(r["target"], e["dst"], r["target_type"], no_props))))
    # sort_array compares by the types' own order; array_sort would run a lambda per comparison
    placed = F.transform("_all", lambda n, i: F.struct(
        n["entity_id"].alias("entity_id"), i.alias("pos"), n["type"].alias("type"), n["name"].alias("name")))
    first = F.filter("_sorted", lambda n, i: (i == 0) | (
        F.get("_sorted", i - 1)["entity_id"] != n["entity_id"]))
    in_order = F.sort_array(F.transform(first, lambda n: F.struct(
        n["pos"].alias("pos"), n["entity_id"].alias("entity_id"), n["type"].alias("type"), n["name"].alias("name"))))
    nodes = F.transform(in_order, lambda n: F.struct(
        n["entity_id"].alias("entity_id"), n["type"].alias("type"), n["name"].alias("name"),
        F.get("_all", n["pos"])["properties"].alias("properties")))
    rels = F.zip_with("rels", "_ends", lambda r, e: F.struct(
        e["src"].alias("src"), r["type"].alias("type"), e["dst"].alias("dst"),
        F.concat_ws("_", F.lit("rel"), bare_entity(e["src"]), F.try_element_at("_slugs", r["type"]), bare_entity(e["dst"])).alias("rel_id"),
        r["properties"].alias("properties")))
    return (
        graph_docs.withColumn("_ends", ends).withColumn("_kinds", kinds).withColumn("_slugs", slugs)
        .withColumn("_all", F.concat(declared, endpoints)).withColumn("_sorted", F.sort_array(placed))
        .withColumn("nodes", nodes).withColumn("rels", rels).drop("_all", "_sorted", "_ends", "_kinds", "_slugs")
    )


def node_rows(normalized: DataFrame, *keep: str) -> DataFrame:
    """(chunk_id, *keep, entity_id, type, name, properties), one row per chunk and entity."""
    # The outer form keeps the optimizer from evaluating the array once more as a filter.
    rows = normalized.select("chunk_id", *keep, F.explode_outer("nodes").alias("n"))
    return rows.where(F.col("n").isNotNull()).select("chunk_id", *keep, "n.*")


def relation_rows(normalized: DataFrame, *keep: str) -> DataFrame:
    """(chunk_id, *keep, pos, src, type, dst, rel_id, properties), repeats kept."""
    rows = normalized.select("chunk_id", *keep, F.posexplode_outer("rels").alias("pos", "r"))
    return rows.where(F.col("r").isNotNull()).select("chunk_id", *keep, "pos", "r.*")


def extraction_totals(normalized: DataFrame) -> DataFrame:
    """One row of totals before any merge across chunks."""
    return normalized.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size("nodes")).cast("bigint").alias("nodes"),
        F.sum(F.size("rels")).cast("bigint").alias("relations"),
    )


def failures_by_reason(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(retryable("outcome")).groupBy(F.col("outcome").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- the graph and its loads ------------------------------------------------

@dataclass(frozen=True)
class PropertyGraph:
    """Six frames: three node tables, three edge tables."""

    entities: DataFrame       # id, name, description, type, embedding, community
    documents: DataFrame      # id, chunk_id, text, source, heading_path, embedding
    communities: DataFrame    # id, summary, size
    mentions: DataFrame       # chunk_id, entity_id
    entity_rels: DataFrame    # src, type, dst, rel_id
    in_community: DataFrame   # entity_id, comm_id

    def staged(self) -> "PropertyGraph":
        """Every table written once; lineage ends here."""
        return PropertyGraph(*(stage(getattr(self, n), n) for n in self.__dataclass_fields__))


ENTITY_COLUMNS = "id string, name string, description string, type string, embedding array<double>, community string"
DOCUMENT_COLUMNS = ("id string, chunk_id string, text string, source string, heading_path string, "
                    "embedding array<double>")


def empty_graph(spark: SparkSession) -> PropertyGraph:
    """A wiped graph."""
    make = lambda columns: spark.createDataFrame([], columns)
    return PropertyGraph(
        make(ENTITY_COLUMNS), make(DOCUMENT_COLUMNS), make("id string, summary string, size bigint"),
        make("chunk_id string, entity_id string"), make("src string, type string, dst string, rel_id string"),
        make("entity_id string, comm_id string"))


def merge_entities(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One row per entity; a later chunk's values overwrite earlier ones."""
    description = F.try_element_at("properties", F.lit("description"))
    return nodes.groupBy(F.col("entity_id").alias("id")).agg(
        F.max_by("name", order).alias("name"),
        F.max_by(description, F.when(description.isNotNull(), F.col(order))).alias("description"),
        F.max_by("type", order).alias("type"),
    )


def merge_relations(rels: DataFrame) -> DataFrame:
    """One edge per (src, type, dst)."""
    return rels.groupBy("src", "type", "dst").agg(F.max("rel_id").alias("rel_id"))


def merge_mentions(nodes: DataFrame) -> DataFrame:
    return nodes.select("chunk_id", "entity_id").distinct()


def document_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        F.col("chunk_id").alias("id"), "chunk_id", "text", "source", "heading_path",
        F.lit(None).cast("array<double>").alias("embedding"))


def load_documents(existing: DataFrame, chunks: DataFrame) -> DataFrame:
    """Merge chunk nodes by id, with or without entities; stored embeddings stay."""
    fresh = document_rows(chunks).drop("embedding").withColumn("_new", F.lit(True))
    old = existing.select("id", *(F.col(c).alias(f"_{c}") for c in ("chunk_id", "text", "source", "heading_path")),
                          "embedding")
    pick = lambda c: F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return old.join(fresh, "id", "full_outer").select(
        "id", pick("chunk_id"), pick("text"), pick("source"), pick("heading_path"), "embedding")


def merge_graphs(graph: PropertyGraph, fresh: PropertyGraph) -> PropertyGraph:
    """Add the entities, documents, mentions and relations of ``fresh``, each key once, with merge semantics on every key."""
    old = graph.entities.select(
        "id", *(F.col(c).alias(f"_{c}") for c in ("name", "description", "type")), "embedding", "community")
    newer = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")).alias(c)
    entities = old.join(fresh.entities.select("id", "name", "description", "type"), "id", "full_outer").select(
        "id", newer("name"), newer("description"), newer("type"), "embedding", "community")
    return replace(
        graph, entities=entities, documents=load_documents(graph.documents, fresh.documents),
        mentions=graph.mentions.unionByName(fresh.mentions).distinct(),
        entity_rels=merge_relations(graph.entity_rels.unionByName(fresh.entity_rels)))


def extracted_graph(chunks: DataFrame, normalized: DataFrame) -> PropertyGraph:
    """One extraction run as a graph of its own, without vectors and communities."""
    ordered = normalized.join(chunks.select("chunk_id", "seq"), "chunk_id") if "seq" not in normalized.columns else normalized
    nodes, empty = node_rows(ordered, "seq"), empty_graph(chunks.sparkSession)
    none = lambda c: F.lit(None).cast(empty.entities.schema[c].dataType).alias(c)
    return replace(
        empty, entities=merge_entities(nodes).select("*", none("embedding"), none("community")), documents=document_rows(chunks),
        mentions=merge_mentions(nodes), entity_rels=merge_relations(relation_rows(ordered)))


def load_graph(graph: PropertyGraph, chunks: DataFrame, normalized: DataFrame) -> PropertyGraph:
    """Add one extraction run to the graph with merge semantics on every key."""
    return merge_graphs(graph, extracted_graph(chunks, normalized))


def uncovered_chunks(chunks: DataFrame, covered: DataFrame) -> DataFrame:
    """Chunks that got no graph document."""
    return chunks.join(covered.select("chunk_id").distinct(), "chunk_id", "left_anti")


def existing_chunk_ids(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("chunk_id").isNotNull()).select("chunk_id").distinct()


def retry_targets(all_ids: DataFrame, existing: DataFrame, failed: DataFrame) -> DataFrame:
    """(all - existing) plus (failed within all), sorted."""
    every = all_ids.select("chunk_id")
    missing = every.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    known_failed = every.join(failed.select("chunk_id"), "chunk_id", "left_semi")
    return missing.union(known_failed).distinct().orderBy("chunk_id")


def stamp_relation_ids(rels: DataFrame) -> DataFrame:
    """Fill missing rel_id by the one id rule; ``stamped`` marks the rows filled."""
    fill = F.col("rel_id").isNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    return rels.withColumn("stamped", fill).withColumn(
        "rel_id", F.when(fill, relation_id("src", "type", "dst")).otherwise(F.col("rel_id")))


def rel_id_coverage(rels: DataFrame) -> DataFrame:
    return rels.agg(F.count("rel_id").alias("with_id"), F.count(F.lit(1)).alias("total"))


def embed_missing(graph: PropertyGraph, embedder: Embedder | None = None) -> PropertyGraph:
    """Embed only nodes that have no vector yet; entities by id, name and description."""
    def fill(df: DataFrame, text: Column) -> DataFrame:
        todo = spread(df.where(F.col("embedding").isNull()).drop("embedding"))
        done = df.where(F.col("embedding").isNotNull())
        return done.unionByName(todo.withColumn("embedding", embed_text(text, embedder)).select(*df.columns))

    entity_text = F.concat_ws("\n", F.concat(F.lit("id: "), F.col("id")), F.concat(F.lit("name: "), F.col("name")),
                              F.concat(F.lit("description: "), F.col("description")))
    return replace(graph, entities=fill(graph.entities, entity_text),
                   documents=fill(graph.documents, F.concat(F.lit("text: "), F.col("text"))))


# ---- integrity --------------------------------------------------------------

def orphan_entities(graph: PropertyGraph) -> DataFrame:
    """Entities no chunk mentions."""
    mentioned = graph.mentions.select(F.col("entity_id").alias("id"))
    return graph.entities.join(mentioned, "id", "left_anti")


def reverse_samples(graph: PropertyGraph, entities: int = 3, per_entity: int = 5) -> DataFrame:
    """(entity, chunks, sources): entities with the most of their first five chunks.

    The five smallest distinct chunk ids and sources per entity are kept by a group
    limit before anything is gathered, so a hot entity stays five rows. Of the graph only mentions and documents are read, once.
    """
    pairs = stage(graph.mentions.join(graph.documents.select("chunk_id", "source"), "chunk_id"), "pairs")

    def smallest(column: str, out: str) -> DataFrame:
        few = top_k(pairs.select("entity_id", column).where(F.col(column).isNotNull()).distinct(),
                    ["entity_id"], [F.col(column)], per_entity)
        return few.groupBy("entity_id").agg(F.array_sort(F.collect_list(column)).alias(out))

    both = smallest("chunk_id", "chunks").join(smallest("source", "sources"), "entity_id", "left")
    return (
        both.select(F.col("entity_id").alias("entity"), "chunks",
                    F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
        .orderBy(F.size("chunks").desc(), "entity").limit(entities)
    )


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """One row of node, edge, embedding and orphan counts, from one pass over each table.

    All six are one union of (kind, id, embedded); only entities and mentions carry an id, by which they meet to tell orphans.
    """
    def tagged(kind: str, df: DataFrame, key: Column | None = None) -> DataFrame:
        embedded = F.col("embedding").isNotNull() if "embedding" in df.columns else F.lit(False)
        return df.select(F.lit(kind).alias("kind"), (F.lit(None) if key is None else key).cast("string").alias("id"), embedded.alias("embedded"))

    kinds = {"entities": graph.entities, "documents": graph.documents, "communities": graph.communities,
             "mentions": graph.mentions, "entity_rels": graph.entity_rels, "members": graph.in_community}
    keys = {"entities": F.col("id"), "mentions": F.col("entity_id")}
    rows = reduce(DataFrame.union, [tagged(kind, df, keys.get(kind)) for kind, df in kinds.items()])
    vectors = {"entity_embeddings": "entities", "chunk_embeddings": "documents"}
    by_id = rows.groupBy("id").agg(
        *[F.count_if(F.col("kind") == kind).alias(kind) for kind in kinds],
        *[F.count_if((F.col("kind") == kind) & F.col("embedded")).alias(name) for name, kind in vectors.items()])
    by_id = by_id.withColumn("orphan_entities", F.when(F.col("mentions") == 0, F.col("entities")).otherwise(0))
    sums = by_id.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*kinds, *vectors, "orphan_entities")])
    return sums.select(
        (F.col("entities") + F.col("documents") + F.col("communities")).alias("nodes"), "entities", "documents", "communities",
        (F.col("mentions") + F.col("entity_rels") + F.col("members")).alias("relationships"), "mentions", "entity_rels",
        *vectors, "orphan_entities")


def integrity(stats: DataFrame) -> DataFrame:
    """Stats plus ``integrity_ok``: nodes, relationships, communities and mentions all present."""
    checks = [F.col(c) > 0 for c in ("nodes", "relationships", "communities", "mentions")]
    return stats.withColumn("integrity_ok", checks[0] & checks[1] & checks[2] & checks[3])


def duplicate_keys(graph: PropertyGraph) -> DataFrame:
    """(node_table, id, n) of ids breaking uniqueness: empty when the graph is sound."""
    tables = [("entity", graph.entities), ("document", graph.documents), ("community", graph.communities)]
    parts = [df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit(name).alias("node_table"), "id", "n") for name, df in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
