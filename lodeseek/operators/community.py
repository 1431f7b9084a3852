"""Communities of the entity graph by modularity, as rounds of joins and sums."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.operators.bounded import BROADCAST_ROWS
from lodeseek.operators.graph_build import PropertyGraph
from lodeseek.operators.ordered import row_numbers, top_k
from lodeseek.runtime import stage

# Smallest modularity gain that starts another level.
MIN_GAIN = 1e-6
# A level ends after a round in which at most this share of nodes moved.
SETTLED = 0.01
# Rows of a partition that a join holds in memory; beyond it both sides are sorted.
HASHED_ROWS = 500_000


def undirected_edges(rels: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct (a, b) with a < b; self-loops and null ids dropped."""
    ends = rels.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, w) with each edge in both directions."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(1.0).alias("w")))


def _modularity(arcs: DataFrame, member: DataFrame, two_m: float) -> float:
    """Share of weight inside communities minus its expectation."""
    of_u = member.select(F.col("node").alias("u"), F.col("comm").alias("cu"))
    of_v = member.select(F.col("node").alias("v"), F.col("comm").alias("cv"))
    inside = arcs.join(of_u, "u").join(of_v, "v").agg(
        F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0))).first()[0]
    total = member.groupBy("comm").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inside / two_m - total / (two_m * two_m)


def _settled_modularity(pairs: DataFrame, member: DataFrame, two_m: float) -> float:
    """:func:`_modularity` where the nodes of ``pairs`` are the communities: what is inside lies on the loops."""
    inside = pairs.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0))).first()[0]
    total = member.groupBy("comm").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inside / two_m - total / (two_m * two_m)


def _merged(pairs: DataFrame, member: DataFrame, sides) -> DataFrame:
    """The pairs of the communities: their weights summed; a pair inside one is a loop, which counts both directions."""
    of_a, of_b = (sides(member.select(F.col("node").alias(c), F.col("comm").alias(f"c{c}"))) for c in ("a", "b"))
    both = F.when((F.col("ca") == F.col("cb")) & (F.col("a") != F.col("b")), F.lit(2.0)).otherwise(F.lit(1.0))
    return pairs.join(of_a, "a").join(of_b, "b").groupBy(
        F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum(F.col("w") * both).alias("w"))


def _links(pairs: DataFrame) -> DataFrame:
    """(u, v, w, k) of each pair in both directions, loops left out, and of each node to itself with no weight; k is the degree of u."""
    apart = F.col("a") != F.col("b")
    ends = F.when(apart, F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).otherwise(
        F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"))))
    arcs = pairs.select(F.explode(ends).alias("e"), "w").select("e.u", "e.v", "w")
    degree = arcs.groupBy("u").agg(F.sum("w").alias("k"))
    # merged, so rows of a node lie together and are small when they are sent in the rounds
    return arcs.where(F.col("u") != F.col("v")).join(degree.hint("merge"), "u").unionByName(
        degree.select("u", F.col("u").alias("v"), F.lit(0.0).alias("w"), "k"))


def _by_node(nodes: DataFrame):
    """The hint for a side with one row a node: it travels whole if it is small, else it is dealt out by hash, so the links needn't be sorted."""
    rows = nodes.count()
    if rows <= BROADCAST_ROWS:
        return F.broadcast
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (lambda side: side.hint("shuffle_hash")) if rows <= parts * HASHED_ROWS else (lambda side: side)


def _awake(node: str, seed: int, turn: int) -> Column:
    """Whether a node may move in this round."""
    return F.pmod(F.xxhash64(node, F.lit(seed), F.lit(turn)), F.lit(2)) == 0


def _moves(links: DataFrame, member: DataFrame, two_m: float, seed: int, turn: int, sides) -> DataFrame:
    """One round: each awake node joins its best neighbouring community; the others stay.

    Only links of awake nodes are read on. They meet the community of their other end and are dealt out once, by node;
    a node's link to itself stands for staying and brings its own community. ``sides`` hints how the other ends travel.
    """
    totals = member.groupBy("comm").agg(F.sum("k").alias("total"))
    ends = member.select(F.col("node").alias("v"), "comm").join(totals, "comm")
    near = links.where(_awake("u", seed, turn)).join(sides(ends), "v").select(
        F.col("u").alias("node"), "comm", "total", "w", "k", (F.col("u") == F.col("v")).alias("mine"))
    options = near.repartition("node").groupBy("node", "comm").agg(
        F.sum("w").alias("links"), F.max("total").alias("total"), F.max("k").alias("k"), F.max("mine").alias("mine"))
    others = F.col("total") - F.when(F.col("mine"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("links") - others * F.col("k") / two_m, 9)
    # Best gain; staying wins a tie, then the smaller id.
    choice = F.struct(gain.alias("gain"), F.col("mine").alias("stay"), (-F.col("comm")).alias("low"))
    best = options.groupBy("node").agg(F.max(choice).alias("best"), F.max("k").alias("k"))
    chosen = best.select("node", (-F.col("best.low")).alias("comm"), "k", (~F.col("best.stay")).alias("moved"))
    return chosen.unionByName(member.where(~_awake("node", seed, turn)).select("node", "comm", "k", F.lit(False).alias("moved")))


def detect_communities(edges: DataFrame, seed: int = DEFAULTS.community_seed,
                       max_rounds: int = 12, max_levels: int = 10) -> DataFrame:
    """(entity_id, comm_id) maximising modularity: local moves, then merge, level by level.

    Every round is a fixed set of joins and sums over the links of half of the
    nodes: only those, picked by a seeded hash, may move in a round, so two neighbours do not
    swap forever. Nodes are numbered once and each round's assignment is written to
    the shared folder. Communities are numbered ``comm_<k>`` by size, then smallest
    member. Entities without an edge get none.
    """
    names = edges.select(F.col("a").alias("name")).union(edges.select("b")).distinct()
    numbered = stage(row_numbers(names, [], ["name"], "node"), "nodes")
    sides = _by_node(numbered)
    left, right = (sides(numbered.select(F.col("name").alias(c), F.col("node").alias(f"{c}_n"))) for c in ("a", "b"))
    ids = edges.join(left, "a").join(right, "b").select(F.col("a_n").alias("a"), F.col("b_n").alias("b"))
    # a loop has both of its directions on one row
    pairs = stage(ids.withColumn("w", F.when(F.col("a") == F.col("b"), F.lit(2.0)).otherwise(F.lit(1.0))), "pairs")
    two_m = pairs.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(2.0 * F.col("w")))).first()[0]
    if not two_m:
        return edges.sparkSession.createDataFrame([], "entity_id string, comm_id string")
    value, steps = None, []

    for level in range(max_levels):
        links = stage(_links(pairs), "links")
        member = stage(links.where(F.col("u") == F.col("v")).select(
            F.col("u").alias("node"), F.col("u").alias("comm"), "k"), "member")
        sides = _by_node(member)
        before = _settled_modularity(pairs, member, two_m) if value is None else value
        for turn in range(max_rounds):
            seen = Observation()
            moved = _moves(links, member, two_m, seed, level * 1000 + turn, sides).observe(
                seen, F.count_if("moved").alias("moved"), F.count(F.lit(1)).alias("nodes"))
            member = stage(moved, "member")
            if seen.get["moved"] <= seen.get["nodes"] * SETTLED:
                break
        pairs = stage(_merged(pairs, member, sides), "pairs")
        value = _settled_modularity(pairs, member, two_m)
        if value - before < MIN_GAIN:
            break
        steps.append(member.select("node", "comm"))

    # from the last level, which has the fewest nodes, back to the first: one join of the first level's size
    assigned = reduce(lambda later, step: step.join(
        later.select(F.col("base").alias("comm"), F.col("node").alias("last")), "comm").select(F.col("node").alias("base"), F.col("last").alias("node")),
        reversed(steps[:-1]), steps[-1].select(F.col("node").alias("base"), F.col("comm").alias("node"))) if steps else numbered.select(
        F.col("node").alias("base"), "node")
    assigned = stage(assigned, "assigned")
    members = numbered.select(F.col("node").alias("base"), "name").join(assigned, "base")
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("first"))
    order = row_numbers(stage(sizes.withColumn("_neg", -F.col("size")), "sizes"), [], ["_neg", "first"], "n")
    labels = order.select("node", F.concat(F.lit("comm_"), (F.col("n") - 1).cast("string")).alias("comm_id"))
    return members.join(labels, "node").select(F.col("name").alias("entity_id"), "comm_id")


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Modularity of a membership (entity_id, comm_id) over undirected edges (a, b)."""
    arcs = _both_ways(edges)
    degree = arcs.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    member = degree.join(membership.select(F.col("entity_id").alias("node"), F.col("comm_id").alias("comm")), "node")
    return _modularity(arcs, member, arcs.agg(F.sum("w")).first()[0])


def community_evidence(membership: DataFrame, entities: DataFrame, mentions: DataFrame, documents: DataFrame,
                       cfg: Tunables = DEFAULTS) -> DataFrame:
    """(comm_id, size, names, context) shown to a summariser.

    Names and texts are cut to the first 40 and 3 per community by a group limit
    before they are gathered; the size counts every member.
    """
    size = membership.groupBy("comm_id").agg(F.count(F.lit(1)).alias("size"))
    named = membership.join(
        entities.select(F.col("id").alias("entity_id"), F.coalesce("name", "id").alias("name")), "entity_id")
    names = top_k(named.select("comm_id", "name").distinct(), ["comm_id"], [F.col("name")], cfg.community_names)
    names = names.groupBy("comm_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    pairs = membership.join(mentions, "entity_id").select("comm_id", "chunk_id").distinct()
    docs = pairs.join(documents.where(F.col("text") != "").select("chunk_id", "text"), "chunk_id")
    # Keep few chunk ids per community by text order; copies of one text count once.
    texts = top_k(docs.groupBy("comm_id", F.sha2("text", 256).alias("key")).agg(F.min("chunk_id").alias("chunk_id")),
                  ["comm_id"], [F.col("chunk_id")], cfg.community_docs, "place").drop("key")
    texts = texts.join(documents.select("chunk_id", "text"), "chunk_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]),
                          "\n---\n")
    texts = texts.groupBy("comm_id").agg(F.substring(joined, 1, cfg.community_context_chars).alias("context"))
    return size.join(names, "comm_id", "left").join(texts, "comm_id", "left").select(
        "comm_id", "size", "names", F.coalesce("context", F.lit("")).alias("context"))


def first_sentences(context: Column, n: int = 2) -> Column:
    """Extractive summary: the first sentences of the context."""
    return F.array_join(F.slice(F.split(context, r"(?<=[.!?])\s+"), 1, n), " ")


def summarize(evidence: DataFrame, summarizer=None) -> DataFrame:
    """(id, summary, size); a plugged-in ``(names, context) -> text`` may fail per community.

    The failure text names the exception type, as the fixed wording below says.
    """
    if summarizer is None:
        shown = F.coalesce(F.nullif(first_sentences(F.col("context")), F.lit("")), F.array_join("names", ", "))
        return evidence.select(F.col("comm_id").alias("id"), shown.alias("summary"), "size")
    @F.pandas_udf("string")
    def run(names: pd.Series, context: pd.Series) -> pd.Series:
        def one(members, text):
            try:
                return summarizer(", ".join(members), text or "(문맥 없음)").strip()
            except Exception as error:  # noqa: BLE001 - a failed summary must not stop the rest
                return f"(요약 실패: {type(error).__name__})"

        return pd.Series([one(list(n), c) for n, c in zip(names, context)], dtype=object)

    return evidence.select(F.col("comm_id").alias("id"), run("names", "context").alias("summary"), "size")


def write_communities(graph: PropertyGraph, membership: DataFrame, communities: DataFrame) -> PropertyGraph:
    """Replace communities, membership edges and the community of every entity."""
    links = membership.select("entity_id", "comm_id")
    entities = graph.entities.drop("community").join(
        links.select(F.col("entity_id").alias("id"), F.col("comm_id").alias("community")), "id", "left")
    return replace(graph, entities=entities.select(*graph.entities.columns), communities=communities,
                   in_community=links)
