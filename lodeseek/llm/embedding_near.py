"""Near duplicates of embeddings by randomised-rotation binary codes.

Vectors meet only within one label (and one length). Equal vectors count as one from here on. A unit vector, zero-padded to P = a power of two,
is rotated by three rounds of random signs and Walsh-Hadamard steps. Stored per vector: the rotated components in four bits each (the
highest bit is the sign, that is the binary code), the step of that grid, and the correction factor f = <sign code, rotated
vector>. <code of a, b> / f of a is an unbiased estimate of <a, b>; its standard deviation at the threshold is
sqrt(1 - t^2) sqrt(1 - f^2) / (f sqrt(P - 1)). A pair both of whose estimates together stay ``SURE`` deviations below the threshold
is settled; every other pair is recomputed exactly from the full vectors in double precision. Nothing is linked by estimate alone.

Candidates come from ``bands`` of further rotations: a hash is the axis (with its sign) that the rotated vector is closest to,
a band joins ``k`` hashes. ``k`` follows from the size of the label's group (buckets of about ``BUCKET``), the number of bands from the
chance of a pair at the threshold to agree in one (measured on seeded pairs): it misses all with chance ``MISS``, whatever the
size. Buckets over ``BUCKET`` vectors are dealt into blocks and compared block by block, so no task holds a large bucket; within a
bucket only pairs that the codes can't settle leave the task.

Null labels; vectors that are null, empty or zero, or hold null or non-finite components: no links. Repeated rows and rows
sharing an id are vectors of their own. ``component_id`` is the least id reachable; rows with a null id link like others and are named by the
others' least id (null if there is none). An empty table gives no rows, other columns are ignored; very long vectors only
need more rotation steps. There are no texts here.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.llm.common import Scratch
from lodeseek.llm.graph import components
from lodeseek.llm.hashing import mix

THRESHOLD = 0.93
#: Deviations that settle a pair; chance that a pair at the threshold meets in no band.
SURE, MISS = 4.0, 1e-4
#: Vectors of a bucket that are compared in one piece.
BUCKET = 1024
#: Components handled at once.
CELLS = 1 << 21
_GOLD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=256)
def _signs(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([size, seed]).choice([-1.0, 1.0], (3, size))


def rotate(rows: np.ndarray, seed: int) -> np.ndarray:
    """Rows (their length a power of two) under one random rotation."""
    n, size = rows.shape
    out = rows
    for signs in _signs(size, seed):
        out, half = out * signs, 1
        while half < size:
            pair = out.reshape(n, -1, 2, half)
            out = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], 2).reshape(n, size)
            half *= 2
        out = out / math.sqrt(size)
    return out


def axes(rows: np.ndarray, seed: int) -> np.ndarray:
    """The signed axis nearest to each rotated row."""
    turned = rotate(rows, seed)
    at = np.abs(turned).argmax(1)
    return 2 * at + (turned[np.arange(len(rows)), at] < 0)


@lru_cache(maxsize=64)
def agreement(size: int) -> float:
    """Chance that two vectors at the threshold have the same axis, from seeded pairs."""
    rng, n = np.random.default_rng(size), max(64, min(4096, CELLS // size))
    a, b = rng.normal(size=(2, n, size))
    a /= np.linalg.norm(a, axis=1)[:, None]
    if size == 1:
        return 1.0
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = THRESHOLD * a + math.sqrt(1 - THRESHOLD ** 2) * b
    side, other = np.abs(a).argmax(1), np.abs(near).argmax(1)
    same = (side == other) & (a[np.arange(n), side] * near[np.arange(n), other] > 0)
    return float(same.mean() - 2 * same.std() / math.sqrt(n))


def bands(size: int, k: int) -> int:
    """Bands of ``k`` hashes that leave a pair at the threshold apart with chance ``MISS``."""
    p = max(agreement(size), 0.05) ** k
    return 1 if p >= 1 else math.ceil(math.log(MISS) / math.log1p(-p))


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four-bit components (two a byte), grid step and correction factor of unit rows."""
    turned = rotate(rows, 0)
    size = turned.shape[1]
    step = np.abs(turned).max(1) / 7.5
    grid = (np.clip(np.floor(turned / step[:, None]), -8, 7) + 8).astype(np.uint8)
    if size == 1:
        grid = np.repeat(grid, 2, 1)
    factor = np.abs(turned).sum(1) / math.sqrt(size)
    return grid[:, ::2] << 4 | grid[:, 1::2], step, factor


def decode(codes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (+-1) and grid values."""
    grid = np.stack([codes >> 4, codes & 15], 2).reshape(len(codes), -1).astype(np.float32)
    return np.where(grid >= 8, np.float32(1), np.float32(-1)), (grid - 7.5) * step[:, None].astype(np.float32)


def deviation(size: int, step: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """What a vector adds to the bound of an estimate: of its code (certain once SURE^2 > P - 1) and of its grid."""
    rest = np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor * math.sqrt(1 - THRESHOLD ** 2)
    code = rest * min(1.0, SURE / math.sqrt(max(1, size - 1)))
    grid = step * min(SURE / math.sqrt(12), math.sqrt(size) / 2) / math.sqrt(1 / 2)  # f is at least about sqrt(1 / 2)
    return code + grid


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, ks = batch.column("d").to_numpy(), batch.column("k").to_numpy()
        for d, k in set(zip(lengths.tolist(), ks.tolist())):
            size = 1 << max(0, (d - 1).bit_length())
            mine, most = np.flatnonzero((lengths == d) & (ks == k)), max(1, CELLS // size)
            for at in range(0, len(mine), most):
                part = batch.take(pa.array(mine[at:at + most]))
                rows = np.zeros((part.num_rows, size))
                rows[:, :d] = unit_rows(part.column("x"))
                codes, step, factor = encode(rows)
                group = part.column("grp").to_numpy().view(np.uint64)
                keys = np.empty((part.num_rows, bands(size, k)), np.uint64)
                for band in range(keys.shape[1]):
                    value = mix(group + np.uint64((band + 1) * _GOLD % (1 << 64)))
                    for j in range(k):
                        value = mix(value * np.uint64(_GOLD) + axes(rows, 1 + band * k + j).astype(np.uint64))
                    keys[:, band] = value
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), pa.array(factor),
                     pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], ["node", "code", "step", "factor", "keys"])


def _unsettled(codes: np.ndarray, step: np.ndarray, factor: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of one bucket (or of its two blocks) that the codes can't put below the threshold."""
    signs, grid = decode(codes, step)
    size = signs.shape[1]
    code = signs / (math.sqrt(size) * factor[:, None]).astype(np.float32)
    bound = deviation(size, step, factor)
    a, b = [], []
    for at in range(0, len(codes), 512):
        part = slice(at, at + 512)
        estimate = (code[part] @ grid.T + grid[part] @ code.T) / 2
        open_ = estimate >= THRESHOLD - (bound[part, None] + bound[None, :]) / 2 - 1e-5
        open_ &= np.arange(len(codes))[None, :] > np.arange(at, at + len(estimate))[:, None]
        if side is not None:
            open_ &= side[part, None] != side[None, :]
        i, j = np.nonzero(open_)
        a.append(i + at)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        key, lo, hi, side, node = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "side", "node"))
        step, factor = table.column("step").to_numpy(), table.column("factor").to_numpy()
        raw = table.column("code").combine_chunks()
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        left, right = [], []
        for s, e in zip(first, np.r_[first[1:], len(key)]):
            if e - s < 2:
                continue
            width = np.array([len(c) for c in raw[s:e].to_pylist()])
            for w in np.unique(width):  # one width, unless keys of two lengths have the same hash
                mine = s + np.flatnonzero(width == w)
                codes = np.frombuffer(b"".join(raw.take(pa.array(mine)).to_pylist()), np.uint8).reshape(len(mine), w)
                i, j = _unsettled(codes, step[mine], factor[mine], side[mine] if lo[s] != hi[s] else None)
                left.append(node[mine[i]])
                right.append(node[mine[j]])
        if not left:
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=kinds)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if all(held[0].column(c)[0] == batch.column(c)[-1] for c in ("key", "lo", "hi")):
            continue  # still the same bucket
        table = pa.Table.from_batches(held)
        key, lo, hi = (table.column(c).to_numpy() for c in ("key", "lo", "hi"))
        same = (key == key[-1]) & (lo == lo[-1]) & (hi == hi[-1])
        cut = int(len(key) - same[::-1].argmin()) if not same.all() else 0
        out = settle(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
        if out is not None:
            yield out
    if held:
        out = settle(pa.Table.from_batches(held))
        if out is not None:
            yield out


def _exact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, bool)
        lengths = np.array(batch.column("d").to_pylist(), np.int64)
        for d in np.unique(lengths):
            mine = np.flatnonzero(lengths == d)
            for at in range(0, len(mine), max(1, CELLS // d)):
                rows = pa.array(mine[at:at + max(1, CELLS // d)])
                linked[rows.to_numpy()] = (unit_rows(batch.column("xa").take(rows)) * unit_rows(batch.column("xb").take(rows))).sum(1) >= THRESHOLD
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked))


def distinct_vectors(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, label, digest: null without links) and the distinct vectors (node, label, digest, n, least, x, d)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("x", lambda v: v != 0)
    rows = vectors.select("vec_id", "label", x.alias("x")).withColumn("ok", F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)))
    rows = rows.select("vec_id", "label", "x", F.when(F.col("ok"), F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ",").cast("binary"), 256))).alias("digest"))
    nodes = rows.where("digest is not null").groupBy("label", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("x").alias("x"))
    nodes = scratch.put(nodes.select(F.monotonically_increasing_id().alias("node"), "label", "digest", "n", "least", "x", F.size("x").cast("long").alias("d")), "nodes")
    return rows.drop("x"), nodes


def candidates(nodes: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of nodes whose exact cosine has to be computed."""
    power = F.ceil(F.log2(F.col("d")))
    sizes = nodes.groupBy("label", "d").agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(1), F.ceil(F.log2(F.col("_n") / bucket) / (power + 1))).cast("long")
    sizes = scratch.put(sizes.select("label", "d", k.alias("k"), F.xxhash64("label", "d").alias("grp")), "groups")
    coded = nodes.select("node", "label", "x", "d").join(scratch.small(sizes), ["label", "d"]).select("node", "grp", "x", "d", "k")
    coded = scratch.put(coded.mapInArrow(_code_rows, "node long, code binary, step double, factor double, keys array<long>"), "codes")
    placed = coded.select("node", "code", "step", "factor", F.explode("keys").alias("key"))
    large = scratch.put(coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
                        .select("key", F.ceil(F.col("n") / bucket).cast("int").alias("blocks")), "large")
    placed = placed.join(scratch.small(large), "key", "left").withColumn("side", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    placed = placed.select("key", F.least("side", "_other").alias("lo"), F.greatest("side", "_other").alias("hi"), "side", "node", "code", "step", "factor")
    dealt = placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return scratch.put(dealt.mapInArrow(_candidate_rows, "a long, b long").distinct(), "candidates")


def links(nodes: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of nodes of one label at a cosine of at least the threshold."""
    pairs = candidates(nodes, scratch, bucket)
    left, right = (nodes.select(F.col("node").alias(s), F.col("label").alias(f"_l{s}"), F.col("d").alias(f"_d{s}"), F.col("x").alias(f"x{s}")) for s in "ab")
    both = pairs.join(left, "a").join(right, "b").where("_la = _lb and _da = _db").select("a", "b", F.col("_da").alias("d"), "xa", "xb")
    return scratch.put(both.mapInArrow(_exact_rows, "a long, b long"), "links")


def dedup(vectors: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) -> one row each: vec_id, n_links, component_id, kept."""
    rows, nodes = distinct_vectors(vectors, scratch)
    found = links(nodes, scratch, bucket)
    counts = nodes.select("node", "n", "least")
    both = found.union(found.select("b", "a")).toDF("node", "other")
    linked = both.join(counts.select(F.col("node").alias("other"), F.col("n").alias("_m")), "other").groupBy("node").agg(F.sum("_m").alias("_links"))
    named = counts.join(components(found, scratch), "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    marked = named.join(heads, "component").join(linked, "node", "left").where("n > 1 or _links is not null")
    marked = marked.join(nodes.select("node", "label", "digest"), "node").select(
        "label", "digest", "component_id", (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"))
    marked = scratch.put(marked.withColumn("_met", F.lit(True)), "marked")
    out = rows.join(scratch.small(marked), ["label", "digest"], "left")
    component = F.when(F.col("_met"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
