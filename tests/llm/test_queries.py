"""The registered queries against their SQL on the smallest tables, and the pipeline's stages against plain Python."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from lodeseek.llm import near, queries  # noqa: E402
from lodeseek.llm.hashing import WordHasher  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = [tuple(r[columns.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in df.collect())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, step(spark, docs, SMALL)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[:5] == before.columns[:5]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(kept["language"]) == 200
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for i, t in sorted(kept["language"].items()):
        first.setdefault(norm(t), i)
    assert set(kept["exact_dedup"]) == set(first.values())
    hasher = WordHasher()
    words = {i: hasher(near.WORD.findall(t.lower())) for i, t in kept["exact_dedup"].items()}
    group = {i: i for i in words}
    for a in sorted(words):
        for b in sorted(words):
            if a < b and near.alignment(words[a], words[b]) >= near.THRESHOLD:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    assert set(kept["near_dedup"]) == set(group.values())
    assert set(kept["mix"]) <= set(kept["decontaminate"]) <= set(kept["near_dedup"]) and kept["mix"]
