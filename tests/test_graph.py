"""Graph normalisation, loading, integrity, communities and retrieval."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.vectors import hashing_embedder
from lodeseek.operators import graph_build as G
from lodeseek.operators.community import detect_communities, modularity, summarize, undirected_edges
from lodeseek.operators.graph_search import graph_retrieve, nested_hits, select_mode, unique_relations
from lodeseek.plans.graph_index import run_graph_index
from lodeseek.runtime import stage

DOC = f"chunk_id string, nodes array<{G.NODE}>, rels array<{G.REL}>"


def doc(chunk, nodes, rels=()):
    return (chunk, [(n, "Technique", {} if d is None else {"description": d}) for n, d in nodes],
            [(a, "Technique", t, b, "Technique", {}) for a, t, b in rels])


def test_normalize_fixture(spark):
    rows = [doc("c0", [("ReAct", "first"), ("Chain-of-Thought", None), ("react", "second")],
                [("ReAct", "EXTENDS", "Chain-of-Thought"), ("ReAct", "EXTENDS", "Chain-of-Thought"), ("new one", "USES", "react")])]
    got = G.normalize(spark.createDataFrame(rows, DOC)).first()
    assert [n["entity_id"] for n in got["nodes"]] == ["ent_react", "ent_chain_of_thought", "ent_new_one"]
    assert got["nodes"][0]["name"] == "ReAct" and got["nodes"][0]["properties"] == {"description": "first"}
    assert [r["rel_id"] for r in got["rels"]] == ["rel_react_extends_chain_of_thought"] * 2 + ["rel_new_one_uses_react"]


def chunks(spark, n):
    return spark.createDataFrame([(i, f"chunk_{i}", f"text {i}", "s", "h") for i in range(n)],
                                 "seq long, chunk_id string, text string, source string, heading_path string")


def loaded(spark):
    rows = [doc("chunk_0", [("A", "old"), ("B", None)], [("A", "USES", "B")]),
            doc("chunk_2", [("a", "new"), ("C", None)], [("a", "USES", "C"), ("a", "USES", "C")])]
    docs = G.normalize(spark.createDataFrame(rows, DOC))
    return G.load_graph(G.empty_graph(spark), chunks(spark, 3), docs), docs


def test_load_merges_and_covers_every_chunk(spark):
    graph, docs = loaded(spark)
    ents = {r["id"]: r for r in graph.entities.collect()}
    assert sorted(ents) == ["ent_a", "ent_b", "ent_c"] and ents["ent_a"]["description"] == "new" and ents["ent_a"]["name"] == "a"
    assert graph.documents.count() == 3 and graph.entity_rels.count() == 2 and graph.mentions.count() == 4
    assert [r[0] for r in G.uncovered_chunks(chunks(spark, 3), docs).select("chunk_id").collect()] == ["chunk_1"]
    again = G.load_graph(graph, chunks(spark, 3), docs)
    assert (again.documents.count(), again.entity_rels.count(), again.mentions.count()) == (3, 2, 4)
    assert G.duplicate_keys(again).count() == 0
    totals = G.extraction_totals(docs).first()
    assert (totals["nodes"], totals["relations"]) == (4, 3)


def test_stamp_and_embed(spark):
    graph, _ = loaded(spark)
    bare = graph.entity_rels.withColumn("rel_id", F.lit(None).cast("string"))
    assert {r["rel_id"] for r in G.stamp_relation_ids(bare).collect()} == {"rel_a_uses_b", "rel_a_uses_c"}
    assert G.rel_id_coverage(bare).first()[:] == (0, 2)
    calls = []

    def embedder(texts):
        assert not any("skip" in t for t in texts)
        return hashing_embedder()(texts)

    kept = graph.documents.withColumn("embedding", F.when(F.col("id") == "chunk_0", F.array(F.lit(1.0))))
    kept = kept.withColumn("text", F.when(F.col("id") == "chunk_0", F.lit("skip")).otherwise(F.col("text")))
    done = G.embed_missing(replace(graph, documents=kept), embedder)
    assert done.documents.where("embedding is null").count() == 0 and done.entities.where("embedding is null").count() == 0
    assert done.documents.where("id = 'chunk_0'").first()["embedding"] == [1.0] and not calls


def test_integrity_pass_and_fail(spark):
    graph, _ = loaded(spark)
    stats = G.integrity(G.graph_stats(graph)).first()
    assert stats["integrity_ok"] is False and (stats["entities"], stats["mentions"], stats["orphan_entities"]) == (3, 4, 0)
    full = replace(graph, communities=spark.createDataFrame([("c", "s", 1)], "id string, summary string, size long"))
    assert G.integrity(G.graph_stats(full)).first()["integrity_ok"] is True
    sample = G.reverse_samples(graph).collect()
    assert sample[0]["entity"] == "ent_a" and sample[0]["chunks"] == ["chunk_0", "chunk_2"]


def test_retry_targets(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "chunk_id string")
    got = G.retry_targets(ids("a", "b", "c", "d"), ids("a", "b", "c"), ids("b", "gone"))
    assert [r[0] for r in got.collect()] == ["b", "d"]


def test_extract_outcomes_and_one_retry(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def extractor(text):
        import os

        if text == "text 0":
            return [{"id": "A", "type": "Tool", "properties": {}}], []
        if text == "text 1":
            return [], []
        if text == "text 2":
            raise RuntimeError("429 slow down")
        with open(seen, "a") as f:
            f.write("x")
        if os.path.getsize(seen) == 1:
            raise ValueError("bad json")
        return [{"id": "B", "type": "Tool", "properties": {}}], []

    outcomes = stage(G.extract_with_retry(chunks(spark, 4).coalesce(1), extractor))
    got = {r["chunk_id"]: r for r in outcomes.collect()}
    assert [got[f"chunk_{n}"]["outcome"] for n in range(4)] == ["ok", "empty", "rate_limit", "ok"]
    assert got["chunk_2"]["detail"] == "RuntimeError: 429 slow down" and open(seen).read() == "xx"
    assert {r["reason"]: r["n"] for r in G.failures_by_reason(outcomes).collect()} == {"rate_limit": 1}


def test_allowed_schema(spark):
    rows = [("c", [("A", "Tool", {}), ("B", "Alien", {})],
             [("A", "Tool", "ALTERNATIVE_TO", "C", "Tool", {}), ("A", "Tool", "EXTENDS", "C", "Tool", {})])]
    triples = spark.createDataFrame([("Tool", "ALTERNATIVE_TO", "Tool")], "src_type string, rel_type string, dst_type string")
    got = G.allowed_only(spark.createDataFrame(rows, DOC), ["Tool"], triples).first()
    assert [n["id"] for n in got["nodes"]] == ["A"] and [r["type"] for r in got["rels"]] == ["ALTERNATIVE_TO"]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_two_triangles(spark):
    pairs = [("1", "2"), ("2", "3"), ("3", "1"), ("4", "5"), ("5", "6"), ("6", "4"), ("1", "1"), ("2", "1"), (None, "2")]
    found = undirected_edges(edges(spark, pairs))
    assert found.count() == 6
    member = {r["entity_id"]: r["comm_id"] for r in detect_communities(found).collect()}
    assert len(member) == 6 and set(member.values()) == {"comm_0", "comm_1"}
    assert len({member[x] for x in "123"}) == 1 and len({member[x] for x in "456"}) == 1 and member["1"] == "comm_0"


def test_empty_graph_has_no_communities(spark):
    assert detect_communities(undirected_edges(edges(spark, [("a", "a")]))).count() == 0


def test_ring_of_cliques(spark):
    pairs = []
    for c in range(6):
        pairs += [(f"{c}{a}", f"{c}{b}") for a in "abcde" for b in "abcde" if a < b]
        pairs.append((f"{c}a", f"{(c + 1) % 6}b"))
    found = undirected_edges(edges(spark, pairs))
    member = detect_communities(found)
    groups = {}
    for r in member.collect():
        groups.setdefault(r["comm_id"], set()).add(r["entity_id"][0])
    assert sum(map(len, groups.values())) == 6 and modularity(found, member) > 0.7
    assert sorted(member.collect()) == sorted(detect_communities(found).collect())


def test_summaries(spark):
    evidence = spark.createDataFrame([("c0", 2, ["a", "b"], "One. Two! Three."), ("c1", 1, ["z"], "")],
                                     "comm_id string, size long, names array<string>, context string")
    assert [r["summary"] for r in summarize(evidence).orderBy("id").collect()] == ["One. Two!", "z"]

    def fails(names, context):
        if names == "z":
            assert context == "(문맥 없음)"
            raise KeyError("k")
        return f" {names} "

    assert [r["summary"] for r in summarize(evidence, fails).orderBy("id").collect()] == ["a, b", "(요약 실패: KeyError)"]


@pytest.mark.parametrize("query, mode", [
    ("ReAct가 뭐예요?", "local"), ("임베딩의 정의", "local"), ("RAG 관련 개념 정리해줘", "global"), ("장단점이 뭐가 있어요", "global"),
    ("A와 B의 차이", "hybrid"), ("RAG VS GraphRAG", "hybrid"), ("RAG 전에 알아야 할 개념이 뭐야", "hybrid"), ("LangGraph", "hybrid"),
    ("그냥 ", "hybrid"), ("그냥 정의", "hybrid")])
def test_mode(values, query, mode):
    assert values(select_mode("x"), [query]) == [mode]


def retrieval_graph(spark):
    ents = [(f"e{n}", f"E{n}", None, "T", [float(n == k) + 0.01 * k for k in range(4)], f"comm_{n % 2}") for n in range(4)]
    docs = [(f"chunk_{n}", f"chunk_{n}" if n else None, f"t{n}", "s", "h", [1.0, float(n), 0.0, 0.0]) for n in range(12)]
    rels = [("e0", "USES", f"e{n}", None) for n in range(4)] + [("e0", "EXTENDS", "e1", "r1"), ("e1", "USES", "gone", "x")]
    return G.PropertyGraph(
        spark.createDataFrame(ents, G.ENTITY_COLUMNS), spark.createDataFrame(docs, G.DOCUMENT_COLUMNS),
        spark.createDataFrame([("comm_0", "s0", 5), ("comm_1", None, 9)], "id string, summary string, size long"),
        spark.createDataFrame([("chunk_1", "e0")], "chunk_id string, entity_id string"),
        spark.createDataFrame(rels, "src string, type string, dst string, rel_id string"),
        spark.createDataFrame([("e0", "comm_0")], "entity_id string, comm_id string"))


def test_modes_of_retrieval(spark):
    vector = [1.0, 0.0, 0.0, 0.0]
    asked = spark.createDataFrame([("l", vector, "local"), ("g", vector, "global"), ("h", vector, "hybrid")],
                                  "query_id string, embedding array<double>, mode string")
    hits = graph_retrieve(retrieval_graph(spark), asked)
    out = {r["query_id"]: r for r in nested_hits(asked, hits).collect()}
    # The chunk without an id is nearest; it is dropped after the cut.
    assert [len(out[q]["chunks"]) for q in "lgh"] == [7, 3, 7]
    assert [len(out[q]["relations"]) for q in "lgh"] == [5, 0, 5]
    assert [[c["id"] for c in out[q]["communities"]] for q in "lgh"] == [[], ["comm_0"], ["comm_0"]]
    assert out["l"]["entities"][0]["id"] == "e0" and all(len(out[q]["entities"]) == 4 for q in "lgh")
    assert all(0 <= e["score"] <= 1 for e in out["h"]["entities"])


def test_unique_relations_first_seen(spark):
    rows = [("q", 2, 1, "r1", "T", "b", "c", "C"), ("q", 1, 1, "r1", "T", "a", "c", "C"), ("q", 1, 2, None, "T", "a", "d", "D"), ("q", 3, 1, None, "T", "a", "d", "D")]
    df = spark.createDataFrame(rows, "query_id string, entity_rank int, pos int, rel_id string, type string, source string, target string, target_name string")
    got = unique_relations(df).orderBy("rank").collect()
    assert [(r["source"], r["rel_id"]) for r in got] == [("a", "r1"), ("a", None)]


def test_graph_index_run(spark, tmp_path):
    folder, store = tmp_path / "md", str(tmp_path / "store")
    folder.mkdir()
    (folder / "01.a.md").write_text("# 제목\nretrievalaugmented knowledgegraphs embeddingvectors\n## 하위\nshort words only\n", encoding="utf-8")
    (folder / "02.b.md").write_text("knowledgegraphs communitydetection\n", encoding="utf-8")
    run = run_graph_index(spark, str(folder), store, reset=True)
    stats = run.stats.first()
    assert stats["integrity_ok"] and stats["documents"] == 3 and stats["entities"] == 4 and stats["orphan_entities"] == 0
    assert stats["entity_embeddings"] == 4 and stats["chunk_embeddings"] == 3
    assert {r["outcome"] for r in run.outcomes.collect()} == {"ok", "empty"}
    again = run_graph_index(spark, str(folder), store, retry_failed=True).stats.first()
    assert (again["documents"], again["entities"], again["entity_rels"]) == (3, 4, stats["entity_rels"])


def test_ids_are_made_once(spark):
    """The plan makes the id of a node or of a relation's end in one place each, and ids stay as the id rule has them."""
    from lodeseek.functions.ids import entity_id, relation_id
    from lodeseek.operators.graph_build import normalize, relation_rows, term_graph

    chunks = spark.createDataFrame([("c1", "Größenwahn __Verstand__ ent_already Größenwahn longword1 Longwords"), ("c2", "short"), ("c3", None)], "chunk_id string, text string")
    found = normalize(term_graph(chunks))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[^\\p{L}\\p{N}_]+") <= 4  # before: 32
    rows = relation_rows(found)
    want = rows.where(~F.col("rel_id").eqNullSafe(relation_id("src", "type", "dst")) | (entity_id("src") != F.col("src")))
    assert rows.count() == 3 and want.count() == 0


def test_reverse_samples_writes_no_other_table(spark, monkeypatch):
    """The report reads mentions and documents only; the whole graph was written for it before."""
    from lodeseek.plans import registry

    def refuse(graph):
        raise AssertionError("the whole graph is written")

    registry.load_all()
    monkeypatch.setattr(G.PropertyGraph, "staged", refuse)
    assert registry.QUERIES["reverse_samples"](spark, "/root/testdata/sf0.001").count() == 3


def test_many_seeds_expand_like_few(spark):
    """With more seeds than travel, edges are dealt out in parts of bounded size, whatever the session's number is."""
    from dataclasses import replace

    from lodeseek.operators import graph_search as S
    from lodeseek.operators.graph_build import empty_graph

    empty = empty_graph(spark)
    names = [(f"n{i}", f"name {i}") for i in range(30)]
    entities = spark.createDataFrame(names, "id string, name string")
    rows = [("n0", "USES", f"n{i}", f"r{i:02d}") for i in range(30)] + [("n1", "USES", "n2", None), ("n1", "USES", "n2", None)]
    rows += [("n2", "USES", "gone", "r0"), ("n3", "PART_OF", "n1", "r1"), ("n4", "USES", "n1", "r2")]
    rels = spark.createDataFrame(rows, "src string, type string, dst string, rel_id string")
    graph = replace(empty, entities=entities, entity_rels=rels)
    seeds = entities.where("id <> 'n4'")
    few, many = (sorted(map(str, S.expand_relations(graph, seeds, max_seeds=n).collect())) for n in (100, 0))
    assert few == many and len(few) == 8 + 1 + 1
    plan = S.expand_relations(graph, seeds, max_seeds=0)._jdf.queryExecution().toString()
    assert "RepartitionByExpression [dst" in plan


def plain_communities(pairs, awake, max_rounds=12, max_levels=10):
    """The rounds of joins and sums in plain Python: {name: community}; ``awake(node, round)``."""
    from lodeseek.operators.community import MIN_GAIN, SETTLED

    names = sorted({x for pair in pairs for x in pair})
    number = {x: n + 1 for n, x in enumerate(names)}
    arcs = {}
    for a, b in pairs:
        for u, v in ((number[a], number[b]), (number[b], number[a])):
            arcs[u, v] = arcs.get((u, v), 0.0) + 1.0
    two_m, place, value = sum(arcs.values()), {x: number[x] for x in names}, None

    def score(arcs, comm, k):
        total = {}
        for n, c in comm.items():
            total[c] = total.get(c, 0.0) + k[n]
        return sum(w for (u, v), w in arcs.items() if comm[u] == comm[v]) / two_m - sum(t * t for t in total.values()) / (two_m * two_m)

    for level in range(max_levels):
        k = {}
        for (u, _), w in arcs.items():
            k[u] = k.get(u, 0.0) + w
        comm = {n: n for n in k}
        before = score(arcs, comm, k) if value is None else value
        for turn in range(max_rounds):
            total, new = {}, dict(comm)
            for n, c in comm.items():
                total[c] = total.get(c, 0.0) + k[n]
            for n in comm:
                if awake(n, level * 1000 + turn):
                    near = {comm[n]: 0.0}
                    for (u, v), w in arcs.items():
                        if u == n and v != n:
                            near[comm[v]] = near.get(comm[v], 0.0) + w
                    gain = {c: round(w - (total[c] - (k[n] if c == comm[n] else 0.0)) * k[n] / two_m, 9) for c, w in near.items()}
                    new[n] = max(near, key=lambda c: (gain[c], c == comm[n], -c))
            moved = sum(new[n] != comm[n] for n in comm)
            comm = new
            if moved <= len(comm) * SETTLED:
                break
        value = score(arcs, comm, k)
        if value - before < MIN_GAIN:
            break
        place = {x: comm[n] for x, n in place.items()}
        merged = {}
        for (u, v), w in arcs.items():
            merged[comm[u], comm[v]] = merged.get((comm[u], comm[v]), 0.0) + w
        arcs = merged
    groups = {}
    for x, c in place.items():
        groups.setdefault(c, []).append(x)
    order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {x: f"comm_{n}" for n, g in enumerate(order) for x in g}


@pytest.mark.parametrize("travels", ["whole", "by hash", "sorted"])
def test_communities_are_those_of_the_plain_method(spark, monkeypatch, travels):
    """Reading on only links of awake nodes, merging half of the arcs and joining the levels last changes no assignment."""
    import random

    from lodeseek.config import DEFAULTS
    from lodeseek.operators import community as C

    monkeypatch.setattr(C, "BROADCAST_ROWS", 200_000 if travels == "whole" else 0)
    monkeypatch.setattr(C, "HASHED_ROWS", 0 if travels == "sorted" else 1_000_000)
    rng = random.Random(5)
    pairs = {(f"n{a:03d}", f"n{b:03d}") for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(260)) if a < b and (a // 9 == b // 9 or rng.random() < 0.35)}
    pairs |= {("hub", f"n{n:03d}") for n in range(0, 90, 4)} | {("x", "y"), ("lone", "loop")}
    turns = spark.range(1, 120).crossJoin(spark.createDataFrame([(lev * 1000 + n,) for lev in range(10) for n in range(12)], "turn int"))
    up = {(r["id"], r["turn"]) for r in turns.where(F.pmod(F.xxhash64("id", F.lit(DEFAULTS.community_seed), "turn"), F.lit(2)) == 0).collect()}
    found = spark.createDataFrame(sorted(pairs), "a string, b string")
    got = {r["entity_id"]: r["comm_id"] for r in detect_communities(found).collect()}
    assert got == plain_communities(pairs, lambda n, turn: (n, turn) in up) and len(set(got.values())) > 3


def test_a_round_deals_out_few_rows(spark, monkeypatch):
    """Links are sent twice at most, and only those of the half of the nodes that may move; before, all were sent three times."""
    from lodeseek.operators import community as C

    plans = []

    def staged(df, label="stage"):
        out = stage(df, label)
        if label == "member":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(C, "stage", staged)
    pairs = [(f"{c}{a}", f"{c}{b}") for c in range(6) for a in "abcde" for b in "abcde" if a < b] + [(f"{c}a", f"{(c + 1) % 6}b") for c in range(6)]
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(C, "BROADCAST_ROWS", 0, raising=False)
        assert detect_communities(undirected_edges(edges(spark, pairs))).count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    of_links = plans[1].count("Exchange hashpartitioning(v#") + plans[1].count("Exchange hashpartitioning(node#")
    assert "xxhash64(u#" in plans[1] and of_links <= 3 and plans[1].count("SortMergeJoin") <= 1


def test_a_load_leaves_no_copies(spark, tmp_path):
    """Rows that are stored as they are aren't written again, and nothing stays of what a load writes on the way; both did before."""
    import os

    from lodeseek.plans.graph_index import graph_store, load_chunks, load_saved
    from lodeseek.runtime import shared_dir

    def staged():
        top = os.path.join(shared_dir(spark).removeprefix("file:"), "stages")
        return {x for x in os.listdir(top) if not x.startswith("change-")} if os.path.isdir(top) else set()

    def load(some, found):
        with store.change() as change:
            load_chunks(change, some, found)
        return {name: sum(map(len, layout.parts.values())) for name, layout in store.state()[0].items()}

    def rows():
        graph = load_saved(spark, str(tmp_path))
        return [sorted(map(str, getattr(graph, n).collect())) for n in ("entities", "documents", "mentions", "entity_rels")]

    docs = G.normalize(spark.createDataFrame([
        doc("chunk_0", [("A", "old"), ("B", None)], [("A", "USES", "B")]),
        doc("chunk_2", [("a", "new"), ("C", None)], [("a", "USES", "C"), ("a", "USES", "C")])], DOC))
    store, some, before = graph_store(spark, str(tmp_path)), chunks(spark, 3), staged()
    first = load(some, docs)
    assert first["documents"] == first["entities"] == 1 and staged() == before
    was = rows()
    assert load(some, docs) == first and rows() == was and [len(t) for t in was] == [3, 3, 4, 2]
    # one document changed, one is new; copies of an id are one document, and one without an id is kept
    more = spark.createDataFrame([(1, "chunk_1", "other", "s", "h"), (2, "chunk_2", "text 2", "s", "h"), (3, "chunk_3", None, "s", "h"),
                                  (3, "chunk_3", None, "s", "h"), (None, None, "lost", "s", None)], some.schema)
    third = load(more, G.normalize(spark.createDataFrame([doc("chunk_3", [("A", "newer"), ("B", None)])], DOC)))
    assert third["documents"] == 2 and third["entity_rels"] == first["entity_rels"] and staged() == before
    graph = load_saved(spark, str(tmp_path))
    assert {(r["id"], r["text"]) for r in graph.documents.collect()} == {
        ("chunk_0", "text 0"), ("chunk_1", "other"), ("chunk_2", "text 2"), ("chunk_3", None), (None, "lost")}
    assert {r["id"]: r["description"] for r in graph.entities.collect()} == {"ent_a": "newer", "ent_b": None, "ent_c": None}
    assert graph.documents.count() == 5 and graph.mentions.count() == 6 and graph.entity_rels.count() == 2
