"""Centroid clustering with exact assignment by the threshold algorithm.

Components are taken as the integers floor(SCALE * x), so that distances, sums and centroids are exact and the result doesn't
depend on how rows are dealt. Each dimension keeps its centroids sorted. From a vector's own value the lists are walked
outward, the nearer side first; a centroid met in any list gets its exact distance. All centroids not met yet are at least
as far in every dimension as the frontier there, so the walk ends once the sum of squared frontier distances is strictly more
than the best exact distance (strictly: a tie with a smaller number may still be unmet).

Vectors stay where they are: tasks hold the centroid lists (``k`` x dimensions numbers, a size set by parameters), emit one
partial sum per cluster, dimension and task, and Spark adds those. Only k x dimensions sums and k counts reach the driver.

Vectors that are null, of another length, or with a null or non-finite component are left out. Fewer kept vectors than ``k``
give fewer centroids, an empty table gives no rows. Repeated rows are vectors of their own; starts with the same hash (equal ids)
go in the order of their components; a null id counts as the empty string in the hash and is returned as null. Components of
2^19 or more take Python integers instead of 64-bit ones; distances above the largest long are returned as that. Other columns
are ignored. There are no texts here; very long arrays are just of another length.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.llm.common import Scratch

K, DIMENSIONS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Vectors walked together.
BLOCK = 1000
#: Integers below this keep every squared distance of up to 512 components within 64 bits.
SAFE = 1 << 27
LARGEST = (1 << 63) - 1
_LIMB = 32


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of a matrix of doubles, exactly: 64-bit integers, or Python ones if a value is large."""
    scaled = np.floor(rows * SCALE) if not rows.size or np.abs(rows).max() < SAFE / SCALE else None
    if scaled is not None:
        return scaled.astype(np.int64)
    out = np.empty(rows.shape, object)
    out.flat = [math.floor(x * SCALE) if abs(x) < 1e15 else int(x) * SCALE for x in rows.ravel().tolist()]
    return out


class SortedLists:
    """Per dimension the centroid values in ascending order, with the numbers of their centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T
        self.values = np.take_along_axis(centroids, self.order.T, 0).T
        #: Exact distances computed and entries read, for tests and reports.
        self.computed = self.walked = 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row; ties go to the smaller number."""
        n, (k, dims) = len(rows), self.centroids.shape
        kind = rows.dtype if rows.dtype == self.centroids.dtype else np.dtype(object)
        best, number = np.full(n, -1, kind), np.full(n, k, np.int64)
        seen = np.zeros((n, k), bool)
        above = np.stack([np.searchsorted(self.values[d], rows[:, d]) for d in range(dims)], 1) if dims else np.zeros((n, 0), np.int64)
        below = above - 1
        live, every = np.arange(n), np.arange(dims)
        while len(live):
            x, lo, hi = rows[live], below[live], above[live]
            low = x - self.values[every, np.maximum(lo, 0)]
            high = self.values[every, np.minimum(hi, k - 1)] - x
            down = (lo >= 0) & ((hi >= k) | (low <= high))
            frontier = np.where(down, low, high)
            met = self.order[every, np.where(down, lo, np.minimum(hi, k - 1))]
            below[live], above[live] = lo - down, hi + ~down
            self.walked += met.size
            fresh = np.zeros((len(live), k), bool)
            np.put_along_axis(fresh, met, True, 1)
            fresh &= ~seen[live]
            seen[live] |= fresh
            at, which = np.nonzero(fresh)
            self.computed += len(at)
            gap = x[at] - self.centroids[which]
            exact = (gap * gap).sum(1)
            for i in range(0, k):  # a row meets each centroid once; take them by number so that ties keep the smaller
                pick = which == i
                if pick.any():
                    row, value = live[at[pick]], exact[pick]
                    better = (number[row] == k) | (value < best[row]) | ((value == best[row]) & (i < number[row]))
                    best[row[better]], number[row[better]] = value[better], i
            over = (frontier * frontier).sum(1) > best[live]
            live = live[~(over.astype(bool) | seen[live].all(1))]
        return number, best


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the vectors with ``DIMENSIONS`` finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", x.alias("x")).where((F.size("x") == DIMENSIONS) & ~bad)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batch: pa.RecordBatch, lists: SortedLists):
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        rows = integers(_rows(part.column("x")))
        if rows.dtype != lists.centroids.dtype:
            rows = rows.astype(object)
            yield part, rows, *SortedLists(lists.centroids.astype(object)).nearest(rows)
        else:
            yield part, rows, *lists.nearest(rows)


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        out.append(sign * (value & ((1 << _LIMB) - 1)))
        value >>= _LIMB
    return out


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, k = SortedLists(centroids), len(centroids)
        totals, counts = np.zeros(centroids.shape, object), np.zeros(k, np.int64)
        for batch in batches:
            for _, rows, number, _ in _blocks(batch, lists):
                counts += np.bincount(number, minlength=k)
                for c in np.unique(number):
                    totals[c] += rows[number == c].sum(0).astype(object)
        out = [(int(c), -1, 0, int(counts[c])) for c in np.flatnonzero(counts)]
        out += [(int(c), d, i, limb) for c in np.flatnonzero(counts) for d, total in enumerate(totals[c]) for i, limb in enumerate(_limbs(int(total)))]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "dimension", "limb", "amount"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            for part, _, number, best in _blocks(batch, lists):
                distance = [min(int(b), LARGEST) for b in best] if best.dtype == object else best
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                                                 ["vec_id", "cluster", "distance"])

    return run


def start(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The first centroids: the ``k`` vectors of least hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return integers(np.array([r["x"] for r in first], float).reshape(len(first), DIMENSIONS))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, every non-empty centroid to floor(sum / count)."""
    parts = vectors.mapInArrow(_sums(centroids), "cluster long, dimension long, limb long, amount long")
    sums = parts.groupBy("cluster", "dimension", "limb").agg(F.sum(F.col("amount").cast("decimal(20,0)")).alias("amount")).collect()
    counts = {r["cluster"]: int(r["amount"]) for r in sums if r["dimension"] < 0}
    totals: dict[tuple[int, int], int] = {}
    for r in sums:
        if r["dimension"] >= 0:
            at = r["cluster"], r["dimension"]
            totals[at] = totals.get(at, 0) + (int(r["amount"]) << (_LIMB * r["limb"]))
    out = centroids.astype(object)
    for (c, d), total in totals.items():
        out[c, d] = total // counts[c]
    large = out.size and max(abs(v) for v in out.ravel()) >= SAFE
    return out if large else out.astype(np.int64)


def cluster(vectors: DataFrame, scratch: Scratch, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of every kept vector, and the final centroids."""
    rows = kept(vectors)
    centroids = start(rows, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long"), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    out = scratch.put(rows.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance long"), "assigned")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = min(sum(int(r["s"]) for r in sums), LARGEST)
    totals = spark.createDataFrame([(r["cluster"], min(int(r["s"]), LARGEST), whole) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return out.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids
