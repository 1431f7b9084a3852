"""The plans for hot keys and large batches agree with the plain ones and with brute force."""

import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.config import DEFAULTS
from lodeseek.operators import bm25 as B
from lodeseek.sources.keyword_index import KeywordIndex
from lodeseek.operators.bounded import bounded
from lodeseek.operators.chunking import integer_runs, number_chunks, repeated_ids
from lodeseek.operators.ordered import row_numbers, running_total
from lodeseek.operators.vector import mmr_select, vector_topk
from lodeseek.plans.registry import table
from lodeseek.runtime import spread, stage

SMALL = "/root/testdata/sf0.001"


def test_running_total_of_a_hot_key(spark):
    rows = [("hot" if n % 3 else f"k{n % 7}", n, n % 5) for n in range(900)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(6)
    plain = running_total(df, ["k"], ["o"], "v", "t").collect()
    sliced = running_total(df, ["k"], ["o"], "v", "t", limit=50).collect()
    assert sorted(plain) == sorted(sliced) and len(plain) == 900
    plan = running_total(df, [], ["o"], "v", "t", limit=50)._jdf.queryExecution().toString()
    assert "windowspecdefinition(_slice" in plan  # rows are summed per slice, only slice totals meet


def test_row_numbers_without_keys_in_slices(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("o"))
    got = row_numbers(df, [], ["o"], "n", limit=60).collect()
    assert all(r["n"] == r["o"] + 1 for r in got) and len(got) == 500


def test_number_chunks_in_slices(spark):
    rows = [(d, p) for d in range(200) for p in range(d % 4)]
    df = spark.createDataFrame(rows, "doc long, piece int")
    got = sorted(number_chunks(df, ["doc"], limit=30).select("doc", "piece", "seq").collect())
    assert [r["seq"] for r in got] == list(range(len(rows)))


def test_repeats_and_runs(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "symbol string, o int").withColumn("key", F.col("symbol"))
    assert sorted(r["symbol"] for r in repeated_ids(df, ["key"], ["o"]).collect()) == ["a", "a~1", "b"]
    nums = spark.createDataFrame([("x", n) for n in (1, 2, 4, 5, 6, 9)], "k string, n long")
    assert sorted(map(tuple, integer_runs(nums, ["k"], "n").collect())) == [("x", 1, 2), ("x", 4, 6), ("x", 9, 9)]


def _bm25_brute(docs, query, k):
    tokens = {i: t.split() for i, t in docs}
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for toks in tokens.values() for t in set(toks))
    idf = {t: math.log(n - c + .5) - math.log(c + .5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    scores = {}
    for i, toks in tokens.items():
        tf = Counter(toks)
        hit = [t for t in query.split() if t in tf]
        if hit:
            scores[i] = sum((floor if idf[t] < 0 else idf[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (.25 + .75 * len(toks) / average)) for t in hit)
    return sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]


@pytest.mark.parametrize("weights,pairs", [(B.BLOCK_WEIGHTS, B.CHUNK_PAIRS), (500, 100)])
def test_bm25_against_brute_force(spark, monkeypatch, weights, pairs):
    """Also with queries in several blocks and documents in many chunks."""
    monkeypatch.setattr(B, "BLOCK_WEIGHTS", weights)
    monkeypatch.setattr(B, "CHUNK_PAIRS", pairs)
    docs, asked = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    check_bm25(B.bm25_topk(docs, asked), docs, asked)


def check_bm25(hits, docs, asked):
    got, rows = hits.collect(), docs.select("doc_id", "text").collect()
    for q in asked.collect():
        mine = sorted((r for r in got if r["query_id"] == q["query_id"]), key=lambda r: r["rank"])
        brute = _bm25_brute([(i, t or "") for i, t in rows], q["query"], 10)
        assert [r["doc_id"] for r in mine] == [i for _, i in brute]
        assert np.allclose([r["score"] for r in mine], [-s for s, _ in brute], atol=1e-6)


def test_keyword_index_changes(spark, tmp_path):
    """Added, changed and removed documents: totals and hits are those of an index of what is left."""
    docs, asked = table(spark, SMALL, "documents").select("doc_id", "text"), table(spark, SMALL, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = KeywordIndex(spark, str(tmp_path / "index"), bucket_bytes=20_000)
    index.put(docs.where("doc_id < 120").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("the former text")).otherwise(F.col("text"))))
    index.put(docs.where("doc_id % 3 = 0 or doc_id >= 120"))
    index.remove(docs.where("doc_id % 10 = 7").select("doc_id").unionByName(spark.createDataFrame([(99_999,)], "doc_id long")))
    index.put(spark.createDataFrame([(500, None), (501, "  ")], "doc_id long, text string"))
    left = docs.where("doc_id % 10 != 7").unionByName(spark.createDataFrame([(500, None), (501, "")], "doc_id long, text string"))
    plain, totals = KeywordIndex.of(left).totals(), index.totals()
    assert totals["n_docs"] == plain["n_docs"] == left.count() and totals["n_terms"] == plain["n_terms"]
    assert totals["mean_idf"] == pytest.approx(plain["mean_idf"], abs=1e-12) and totals["avg_len"] == pytest.approx(plain["avg_len"])
    check_bm25(B.bm25_topk(None, asked, index=index), left, asked)
    stale = index.store.read("postings").count()
    index.compact()
    assert index.store.read("postings").count() < stale
    check_bm25(B.bm25_topk(None, asked, index=index), left, asked)


def test_keyword_query_opens_its_buckets_only(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") * 7 + i).cast("string"), 256) for i in range(8)]).alias("text"))
    index = KeywordIndex(spark, str(tmp_path / "index"), bucket_bytes=100_000)
    index.put(docs)
    word = docs.where("doc_id = 5").first()["text"].split()[0]
    asked = spark.createDataFrame([(1, word)], "query_id long, query string")
    read = index.postings(asked.select(F.col("query").alias("term")))
    assert len(read.inputFiles()) < len(index.store.read("postings").inputFiles()) / 4
    hits = B.bm25_topk(None, asked, index=index)
    assert [r["doc_id"] for r in hits.orderBy("rank").collect()] == sorted(r["doc_id"] for r in docs.where(F.col("text").contains(word)).collect())
    assert hits.inputFiles() and all("/data/postings-" in f for f in hits.inputFiles())  # no text is read


def test_bm25_without_matches(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "zzz"), (2, "")], "query_id long, query string")
    assert B.bm25_topk(docs, asked).count() == 0


def test_vector_topk_blocks_match_scan(spark):
    vectors = table(spark, SMALL, "embeddings")
    copies = vectors.unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 10_000))  # ties everywhere
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    plain = vector_topk(copies, asked, 5).collect()
    blocked = vector_topk(copies, asked, 5, cfg=replace(DEFAULTS, query_block_rows=60, vector_block_rows=130)).collect()
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"])
    assert sorted(map(key, plain)) == sorted(map(key, blocked)) and len(plain) == 5 * asked.count()
    first = {r["query_id"]: r["vec_id"] for r in plain if r["rank"] == 1}
    assert all(q == v for q, v in first.items())


def test_vector_topk_string_ids_and_no_queries(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [0.0, 0.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    got = vector_topk(df, asked, 3, vec_id="id").orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 1.0), ("b", 1.0), ("d", 0.0)]
    assert vector_topk(df, asked.limit(0), 3, vec_id="id").count() == 0


def test_mmr_prefers_variety(spark):
    pool = spark.createDataFrame(
        [(1, 1, 1.0, 1, [1.0, 0.0]), (1, 2, .99, 2, [1.0, 0.01]), (1, 3, .6, 3, [0.6, -0.8])],
        "query_id long, vec_id long, score double, rank int, embedding array<double>")
    assert [r["vec_id"] for r in mmr_select(pool, 2).orderBy("rank").collect()] == [1, 3]


def test_stage_bounded_and_spread(spark):
    df = spark.range(100)
    assert stage(df).count() == 100
    assert "broadcast" in bounded(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in bounded(df, max_rows=10)._jdf.queryExecution().logical().toString().lower()
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_postings_are_lists(spark, tmp_path):
    """One row per term and task, not per document; repeated ids are indexed once."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two two three").alias("text"))
    index = KeywordIndex(spark, str(tmp_path / "index"))
    index.put(docs.unionByName(docs.where("doc_id < 10")).coalesce(4))
    assert index.store.read("postings").count() <= 3 * spark.sparkContext.defaultParallelism * 4
    assert index.totals()["n_docs"] == 3000 and index.totals()["avg_len"] == 4
    found = index.postings(spark.createDataFrame([("two",)], "term string"))
    assert found.count() == 3000 and found.where("tf = 2 and length = 4").count() == 3000
