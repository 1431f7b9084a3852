"""nDCG, context scores, samples."""

import math

import pytest
from pyspark.sql import functions as F

from lodeseek.functions.vectors import embed_text
from lodeseek.operators import evaluate as E
from lodeseek.plans.evaluation import build_samples, code_contexts, evaluate, graph_contexts
from lodeseek.runtime import stage
from lodeseek.sources.files import CODE_ITEM
from lodeseek.sources.tables import CHUNK_TABLE
from tests.test_graph import retrieval_graph


def run(spark, ranked, truth, k=10):
    asked = spark.createDataFrame([("q", "t")], "query_id string, type string")
    r = spark.createDataFrame([("q", n, i) for n, i in enumerate(ranked)], "query_id string, rank int, id string")
    t = spark.createDataFrame([("q", i) for i in truth], "query_id string, id string")
    return E.ndcg(asked, r, t, k).first()["ndcg"], E.context_scores(r, t, k).collect()


def test_ndcg_cases(spark):
    assert run(spark, ["a", "b"], ["a", "b"])[0] == pytest.approx(1)
    assert run(spark, ["x", "y"], ["a"])[0] == 0
    assert run(spark, [], ["a"])[0] == 0
    assert run(spark, ["a"], [])[0] != run(spark, ["a"], [])[0]
    early, late = run(spark, ["a", "x", "y"], ["a"])[0], run(spark, ["x", "y", "a"], ["a"])[0]
    assert early > late == pytest.approx(1 / math.log2(4))
    assert run(spark, ["x"] * 0 + ["a", "b", "c"], list("abcdef"), k=2)[0] == pytest.approx(1)
    assert run(spark, ["a", "a"], ["a"])[0] > 1  # repeated ids count twice


def test_context_scores(spark):
    (row,) = run(spark, ["a", "x", "b"], ["a", "b", "c", "d"])[1]
    assert row["context_recall"] == 0.5 and row["context_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert run(spark, ["x"], ["a"])[1][0]["context_precision"] == 0


def test_means_skip_nan(spark):
    rows = [("a", 1.0), ("a", 0.0), (None, 0.5), ("", 0.7), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "type string, ndcg double")
    one = E.mean_ndcg(df).first()
    assert one["mean_ndcg"] == pytest.approx(0.55) and one["n_with_gt"] == 4
    assert {r["type"]: (round(r["mean_ndcg"], 6), r["n"]) for r in E.ndcg_by_type(df).collect()} == {"a": (0.5, 2), "?": (0.6, 2)}
    assert E.mean_ndcg(df.where("type = 'b'")).first()["mean_ndcg"] is None


def test_evaluate_a_code_retriever(spark, tmp_path):
    rows = [(f"c{n}", f"p{n}", "python", "f", f"def f{n}()", 1, 2, "t", f"needle{n} hay") for n in range(6)]
    names = [f.name for f in CHUNK_TABLE][:-1]
    corpus = stage(spark.createDataFrame(rows, names).withColumn("embedding", embed_text("document")))
    items = spark.createDataFrame([("i1", "needle2", "NL", "x", "python", ["c2"], [], "ans", "", ""),
                                   ("i2", "needle4", None, "x", "python", [], [], None, "", "")], CODE_ITEM)
    judges = {"good": lambda q, c, a, r: float(len(c)), "bad": lambda *a: 1 / 0}
    path = str(tmp_path / "samples")
    out = evaluate(spark, items, "code", code_contexts(corpus), path, judges=judges, summarizer=lambda q, c: c[:12])
    assert out["overall"].first()["mean_ndcg"] == pytest.approx(1) and out["overall"].first()["n_with_gt"] == 1
    assert [r["type"] for r in out["by_type"].collect()] == ["NL"]
    means = out["metrics"].first()
    assert means["good"] > 0 and means["bad"] is None
    saved = {r["id"]: r for r in spark.read.json(path).collect()}
    assert saved["i1"]["retrieved_chunk_ids"][0] == "c2" and saved["i1"]["response"] == "[1] def f2()" and saved["i2"]["reference"] == ""


def test_graph_samples(spark):
    import numpy as np

    items = spark.createDataFrame([("i", "차이 x", "T", ["chunk_1"], "a")],
                                  "id string, query string, type string, gt_chunk_ids array<string>, expected_answer string")
    row = build_samples(spark, items, "graph", graph_contexts(retrieval_graph(spark), lambda t: np.ones((len(t), 4)))).first()
    assert len(row["retrieved_contexts"]) == 8 and row["retrieved_chunk_ids"] and row["retrieved_contexts"][-1] == "s0" or len(row["retrieved_chunk_ids"]) == 8
