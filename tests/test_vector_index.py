"""Stored vector cells: the hits of a full scan, from a part of the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators.vector import vector_topk
from lodeseek.sources import vector_index as V


def frames(spark, rows, asked):
    return (spark.createDataFrame([(i, x if x is None else list(map(float, x))) for i, x in rows], "vec_id long, embedding array<double>"),
            spark.createDataFrame([(i, list(map(float, x))) for i, x in asked], "query_id long, embedding array<double>"))


def clustered(seed, groups=20, members=50, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return (centres[:, None] + 0.1 * rng.normal(size=(groups, members, dims))).reshape(-1, dims)


@pytest.mark.parametrize("slice_rows,query_rows", [(V.SLICE_ROWS, V.QUERY_ROWS), (7, 3)])
def test_equals_scan(spark, tmp_path, monkeypatch, slice_rows, query_rows):
    """Added in parts; copies, zero vectors, null vectors, more hits asked for than a cell holds; large cells and batches in blocks."""
    monkeypatch.setattr(V, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(V, "QUERY_ROWS", query_rows)
    rows = [(i, x) for i, x in enumerate(clustered(1))]
    rows += [(5000 + i, x) for i, x in rows[:100]] + [(9000, np.zeros(16)), (9001, np.zeros(16)), (9002, None)]
    asked = [(i, rows[i * 37][1]) for i in range(12)] + [(12, np.zeros(16)), (13, -rows[0][1])]
    vectors, queries = frames(spark, rows, asked)
    index = V.VectorIndex(spark, str(tmp_path / "v"), bucket_bytes=20_000)
    index.add(vectors.where("vec_id % 2 = 0"))
    index.add(vectors.where("vec_id % 2 = 1"))
    for k in (1, 10, 130):
        plain = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in vector_topk(vectors, queries, k).collect()}
        got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in index.search(queries, k).hits.collect()}
        assert got == plain


def test_opens_few_cells(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate(clustered(2))]
    vectors, queries = frames(spark, rows, [(i, rows[i * 50][1]) for i in range(20)])
    index = V.VectorIndex(spark, str(tmp_path / "v"), bucket_bytes=10_000)
    index.add(vectors)
    found = index.search(queries, 5)
    cells = index.store.read("cells").where("n > 0").count()
    opened = found.opened.groupBy("query_id").count().agg(F.avg("count")).first()[0]
    assert found.hits.count() == 100 and opened < cells / 3
    assert found.opened.distinct().count() == found.opened.count()
    one = index.store.near("vectors", found.opened.where("query_id = 0").select("cell"))
    assert len(one.inputFiles()) < len(index.store.read("vectors").inputFiles())


def test_bounds_hold():
    rng = np.random.default_rng(3)
    centre, members, queries = (V.unit(rng.normal(size=(n, 8))) for n in (1, 200, 50))
    radius = np.arccos(members @ centre.T).max()
    assert (V.bounds(queries, centre, np.array([radius]))[:, 0] >= (queries @ members.T).max(1) - 1e-12).all()


def test_empty(spark, tmp_path):
    vectors, queries = frames(spark, [], [(1, [1.0, 0.0])])
    index = V.VectorIndex(spark, str(tmp_path / "v"))
    index.add(vectors)
    assert index.search(queries, 3).hits.count() == 0
    index.add(frames(spark, [(1, [0.0, 0.0])], [])[0])
    assert [tuple(r) for r in index.search(queries, 3).hits.collect()] == [(1, 1, 0.0, 1)]
