"""Stored vectors in cells with exact bounds: a query opens only the cells that can hold one of its best ``k``.

Each vector lies in the cell of its nearest centre (by angle); a cell notes its centre, its size and its radius, the largest angle
of a member. By the triangle inequality of angles no member is nearer to a query than its angle to the centre less the
radius. A search first opens a query's most promising cells, takes the ``k``-th similarity found as its mark, and then opens every
other cell whose bound reaches the mark: the result is that of a full scan. Cells are bucketed in a
:class:`~lodeseek.sources.store.Store`, so what isn't opened isn't listed either.

Centres are ``sqrt(n)`` of the vectors (``MAX_CELLS`` at most) picked by hash; how many cells a search opens depends on how far the data
clusters, its result doesn't. Zero vectors have a cell of their own, with similarity 0 to everything.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodeseek.operators.ordered import top_k
from lodeseek.operators.scan_topk import TIE_DECIMALS, best_of, id_array, result_schema
from lodeseek.runtime import shared_dir, stage
from lodeseek.sources.store import BUCKET_BYTES, Spec, Store

MAX_CELLS = 4096
#: Vectors and queries of one block of the exact comparison; cells a search opens first.
SLICE_ROWS, QUERY_ROWS, PROBES = 4096, 1024, 3
#: Angles are compared with this slack, similarities with the other: more than rounding can move them.
ANGLE_SLACK, SCORE_SLACK = 1e-7, 1e-9
NOWHERE = -1  # the cell of zero vectors


def unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def matrix_of(lists) -> np.ndarray:
    """A list column as a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(lists), -1)


@dataclass(frozen=True)
class Found:
    """``hits`` (query_id, vec_id, score, rank) and ``opened`` (query_id, cell): the cells read for each query."""

    hits: DataFrame
    opened: DataFrame


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType = T.LongType(), bucket_bytes: int = BUCKET_BYTES):
        numbers, cell = T.ArrayType(T.DoubleType()), T.StructField("cell", T.LongType())
        self.spark, self.store = spark, Store(spark, path, {
            "vectors": Spec(T.StructType([cell, T.StructField("vec_id", id_type), T.StructField("embedding", numbers)]), ("cell",), replace=False),
            "cells": Spec(T.StructType([cell, T.StructField("centre", numbers), T.StructField("radius", T.DoubleType()), T.StructField("n", T.LongType())]), ("cell",)),
        }, bucket_bytes)

    @staticmethod
    def of(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> "VectorIndex":
        """A new index of ``vectors`` in the shared folder."""
        spark = vectors.sparkSession
        index = VectorIndex(spark, os.path.join(shared_dir(spark), "stages", f"vectors-{uuid.uuid4().hex}"), vectors.schema[vec_id].dataType)
        index.add(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")))
        return index

    def add(self, vectors: DataFrame) -> None:
        """Add vectors (vec_id, embedding) of new ids; the first ones choose the centres. Null embeddings are left out."""
        rows = vectors.where(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        with self.store.change() as change:
            cells = self._cells(change.rows("cells"))
            if cells is None:
                picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MAX_CELLS, max(1, math.isqrt(rows.count())))).toArrow()
                if not picked.num_rows:
                    return
                number, centres = np.arange(picked.num_rows), unit(matrix_of(picked.column("embedding").combine_chunks()))
            else:
                number, centres, *_ = cells
            kind = vectors.schema["vec_id"].dataType.simpleString()
            placed = stage(rows.mapInArrow(_placed(number, centres), f"cell long, vec_id {kind}, embedding array<double>, angle double"), "placed")
            change.append("vectors", placed.drop("angle"))
            sums = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"))
            named = self.spark.createDataFrame([(int(c), x.tolist()) for c, x in zip(number, centres)] + [(NOWHERE, [0.0] * centres.shape[1])],
                                               "cell long, centre array<double>").dropDuplicates(["cell"])
            old = change.rows("cells").select("cell", F.col("radius").alias("_r"), F.col("n").alias("_n"))
            merged = named.join(sums, "cell", "left").join(old, "cell", "left")
            change.upsert("cells", stage(merged.select("cell", "centre", F.greatest("radius", "_r").alias("radius"),
                                                       (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")), "cells"))

    def _cells(self, rows: DataFrame):
        """Numbers, centres, radii and sizes of all cells (at most ``MAX_CELLS`` and one), or None."""
        table = rows.orderBy("cell").toArrow()
        if not table.num_rows:
            return None
        radius = np.nan_to_num(table.column("radius").to_numpy().astype(float))
        return table.column("cell").to_numpy(), matrix_of(table.column("centre").combine_chunks()), radius, table.column("n").to_numpy()

    def search(self, queries: DataFrame, k: int, embedding: str = "embedding") -> Found:
        """The ``k`` most cosine-similar vectors per query (query_id, embedding); exact, ties by id."""
        asked = stage(queries.select("query_id", F.col(embedding).cast("array<double>").alias("q")), "asked")
        schema = result_schema(self.store.read("vectors"), "vec_id", asked)
        query_kind = asked.schema["query_id"].dataType.simpleString()
        opened_kind = f"query_id {query_kind}, cell long"
        cells = self._cells(self.store.read("cells"))
        total = asked.count()
        if cells is None or not total:
            none = self.spark.createDataFrame([], schema)
            return Found(top_k(none, ["query_id"], [F.col("vec_id")], k), self.spark.createDataFrame([], opened_kind))
        order = [F.round("score", TIE_DECIMALS).desc(), F.col("vec_id")]
        first = stage(asked.mapInArrow(_choice(cells, k, first=True), opened_kind), "first-cells")
        early = stage(top_k(self._compared(asked, first, cells[0], cells[3], total, schema, k), ["query_id"], order, k), "first-hits")
        marks = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("mark"))
        later = stage(asked.join(marks, "query_id", "left").select("query_id", "q", "mark").mapInArrow(_choice(cells, k, first=False), opened_kind), "later-cells")
        late = self._compared(asked, later, cells[0], cells[3], total, schema, k)
        return Found(top_k(early.drop("rank").unionByName(late), ["query_id"], order, k), first.unionByName(later))

    def _compared(self, asked: DataFrame, opened: DataFrame, number: np.ndarray, sizes: np.ndarray, total: int, schema, k: int) -> DataFrame:
        """Best ``k`` per query and block of the opened (query_id, cell)."""
        slices = self.spark.createDataFrame([(int(c), -(-int(n) // SLICE_ROWS)) for c, n in zip(number, sizes) if n], "cell long, slices int")
        blocks = max(1, -(-total // QUERY_ROWS))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        wanted = opened.join(asked, "query_id").join(F.broadcast(slices), "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), block, "query_id", "q")
        used = opened.select("cell", block).distinct()
        rows = self.store.near("vectors", opened.select("cell")).join(F.broadcast(slices), "cell").join(F.broadcast(used) if blocks * len(number) < 1 << 16 else used, "cell")
        rows = rows.select("cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), "slices").cast("int").alias("slice"), "block", "vec_id", "embedding")
        keys = ["cell", "slice", "block"]
        return rows.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(_matched(k, schema), schema)


def _placed(number: np.ndarray, centres: np.ndarray):
    real = np.flatnonzero(np.linalg.norm(centres, axis=1) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = unit(matrix_of(part.column("embedding")))
                dots = rows @ centres[real].T
                best = dots.argmax(1) if len(real) else np.zeros(len(rows), int)
                empty = ~rows.any(1)
                cell = np.where(empty, NOWHERE, number[real][best] if len(real) else NOWHERE)
                angle = np.where(empty, 0.0, np.arccos(np.clip(dots[np.arange(len(rows)), best], -1, 1)) if len(real) else 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), part.column("vec_id"), part.column("embedding"), pa.array(angle)],
                                                 ["cell", "vec_id", "embedding", "angle"])

    return run


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Largest similarity that a member of each cell can have with each (unit) query."""
    angle = np.arccos(np.clip(queries @ centres.T, -1, 1))
    best = np.cos(np.maximum(0, angle - radius - ANGLE_SLACK))
    best[:, ~centres.any(1)] = 0.0
    return best


def _choice(cells, k: int, first: bool):
    number, centres, radius, sizes = cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best = bounds(unit(matrix_of(batch.column("q"))), centres, radius)
            best[:, sizes == 0] = -np.inf
            ranked = np.argsort(-best, axis=1, kind="stable")
            # the most promising cells, and more until they hold k vectors
            held = np.cumsum(sizes[ranked], axis=1)
            early = (np.arange(len(number)) < PROBES) | (np.c_[np.zeros((len(ranked), 1)), held[:, :-1]] < k)
            early &= np.take_along_axis(best, ranked, 1) > -np.inf
            if first:
                chosen = early
            else:
                mark = batch.column("mark").to_numpy(zero_copy_only=False).astype(float)
                mark = np.where(np.isnan(mark), -np.inf, mark)
                chosen = ~early & (np.take_along_axis(best, ranked, 1) >= mark[:, None] - SCORE_SLACK) & (np.take_along_axis(best, ranked, 1) > -np.inf)
            row, at = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), pa.array(number[ranked[row, at]])], ["query_id", "cell"])

    return run


def _matched(k: int, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        rows, asked = unit(matrix_of(left.column("embedding").combine_chunks())), unit(matrix_of(right.column("q").combine_chunks()))
        q, ids, scores = best_of(asked @ rows.T, id_array(left.column("vec_id").combine_chunks()), k)
        return pa.Table.from_arrays([right.column("query_id").combine_chunks().take(pa.array(q)), pa.array(ids, kinds.field("vec_id").type), pa.array(scores)], schema=kinds)

    return run
