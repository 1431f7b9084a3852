"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from lodeseek.plans import registry

registry.load_all()
SMALL = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_id", "lang", "source", "score", "rank"]


def test_text_chunks_are_whole(spark):
    """Chunks stay inside the size and lose no text of their document."""
    docs = {r["doc_id"]: r["text"] for r in registry.table(spark, SMALL, "documents").collect()}
    chunks = registry.QUERIES["text_chunks"](spark, SMALL).collect()
    assert {f"chunk_{n}" for n in range(len(chunks))} == {r["chunk_id"] for r in chunks}
    seen = {}
    for r in sorted(chunks, key=lambda r: int(r["chunk_id"][6:])):
        assert len(r["text"]) <= 1200 and r["text"] in docs[r["doc_id"]] or "\r" in docs[r["doc_id"]]
        seen.setdefault(r["doc_id"], set()).update(r["text"].split())
    for doc, text in docs.items():
        assert set(text.split()) - seen.get(doc, set()) == set() or max(map(len, text.split())) > 1050


def test_communities_cover_the_graph(spark):
    from lodeseek.operators.community import modularity, undirected_edges
    from lodeseek.plans.queries_graph import merge_relations, normalized_lines, relation_rows
    from lodeseek.runtime import stage

    edges = stage(undirected_edges(merge_relations(relation_rows(normalized_lines(spark, SMALL)))))
    member = stage(registry.QUERIES["communities"](spark, SMALL))
    ends = edges.select("a").union(edges.select("b")).distinct().count()
    assert member.count() == ends == member.select("entity_id").distinct().count()
    assert modularity(edges, member) > 0.8
