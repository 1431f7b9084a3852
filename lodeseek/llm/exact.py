"""Exact deduplication through a minimal perfect hash over the digests of the history.

The history (what earlier batches kept) is one table of hash buckets. Each bucket is a minimal perfect hash: ``n``
digests own ``n`` slots, a slot holds the full digest and the winner's locator. A lookup computes one slot and
compares all 32 bytes, so a digest that the history lacks is never taken for one it has. Digests that miss group
among themselves. Only distinct digests with a count travel, so a text that owns a third of all rows is one key.

Null text is empty; empty texts are equal to each other. Rows that repeat both id and text are one group: one of
them is kept. A null id never wins against an id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.llm.common import SPACE, Scratch, text_of

#: Mean number of digests in one bucket of the index.
BUCKET_KEYS = 8192
INDEX_SCHEMA = "bucket long, n long, seeds binary, digests binary, winners binary"


def normal_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with every white-space run as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE, " "), 256))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view("<u8").reshape(-1, 4)
    return words[:, 1].copy(), words[:, 2].copy()


def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0x94D049BB133111EB)) >> np.uint64(20)) % np.uint64(n)


def perfect_hash(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slot of each digest) for distinct 32-byte digests.

    Digests fall into small cells; the largest cells first look for a seed that sends their members to free slots.
    A cell of one digest stores its slot directly, as -slot-1.
    """
    n = len(digests)
    cell_hash, slot_hash = _halves(digests)
    cells = (cell_hash % np.uint64(max(1, n // 3))).astype(np.int64)
    seeds, slots, used = np.zeros(max(1, n // 3), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(cells, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(cells[order]) != 0]) if n else np.zeros(0, int)
    groups = sorted(np.split(order, starts[1:]), key=len, reverse=True) if n else []
    singles = []
    for members in groups:
        if len(members) == 1:
            singles.append(members[0])
            continue
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64)
            spots = _slot(slot_hash[members][None, :], tries[:, None], n).astype(np.int64)
            ranked = np.sort(spots, axis=1)
            good = ~used[spots].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                at = int(good.argmax())
                seeds[cells[members[0]]], slots[members] = tries[at], spots[at]
                used[spots[at]] = True
                break
            seed += 64
    free = np.flatnonzero(~used)
    for member, spot in zip(singles, free):
        seeds[cells[member]], slots[member] = -spot - 1, spot
    return seeds, slots


def find_slots(digests: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    cell_hash, slot_hash = _halves(digests)
    seed = seeds[(cell_hash % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -seed - 1, _slot(slot_hash, np.maximum(seed, 0), n).astype(np.int64))


def _packed(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 32).copy()


def _build(key, part: pd.DataFrame) -> pd.DataFrame:
    digests, winners = _packed(part["digest"]), part["doc_id"].to_numpy(np.int64)
    seeds, slots = perfect_hash(digests)
    at = np.argsort(slots)
    return pd.DataFrame({"bucket": [key[0]], "n": [len(at)], "seeds": [seeds.tobytes()],
                         "digests": [digests[at].tobytes()], "winners": [winners[at].tobytes()]})


def _find(part: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = part[["digest", "first_id", "n"]].assign(winner=pd.array([None] * len(part), dtype="Int64"))
    if len(part) and len(index):
        row, digests = index.iloc[0], _packed(part["digest"])
        slots = find_slots(digests, np.frombuffer(row["seeds"], np.int64), int(row["n"]))
        same = (np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)[slots] == digests).all(axis=1)
        found = np.frombuffer(row["winners"], np.int64)[slots]
        out["winner"] = pd.array(np.where(same, found, 0), dtype="Int64")
        out.loc[~same, "winner"] = pd.NA
    return out


def _bucket(count: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(max(1, -(-count // BUCKET_KEYS)))).cast("long")


def build_index(winners: DataFrame, count: int) -> DataFrame:
    """Index rows for ``winners`` (digest binary, doc_id long), one row per distinct digest; ``count`` sizes the buckets."""
    return winners.withColumn("bucket", _bucket(count)).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def look_up(groups: DataFrame, index: DataFrame, count: int) -> DataFrame:
    """``groups`` (digest, first_id, n) with ``winner``: the history's locator, null for digests it lacks."""
    return groups.withColumn("bucket", _bucket(count)).groupBy("bucket").cogroup(
        index.groupBy("bucket")).applyInPandas(_find, "digest binary, first_id long, n long, winner long")


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    The lower half of the id range is the history, the upper half the new batch; both are read whole.
    """
    rows = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                   normal_digest(text_of()).alias("digest")), "digests")
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = (low + high) // 2 if low is not None else 0
    old = F.col("doc_id") <= middle

    def groups(part: DataFrame) -> DataFrame:
        return part.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))

    history = scratch.put(groups(rows.where(old)), "history")
    index = scratch.put(build_index(history.select("digest", F.col("first_id").alias("doc_id")), count), "index")
    found = look_up(groups(rows.where(~old | F.col("doc_id").isNull())), index, count)
    merged = history.unionByName(found.select("digest", F.coalesce("winner", "first_id").alias("first_id"), "n"))
    merged = merged.groupBy("digest").agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("group_size"))
    shared = scratch.put(merged.where("group_size > 1"), "groups")
    # Only a repeated text can hold the same (id, text) twice.
    out = rows.join(shared, "digest", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), "digest")
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    single = out.where(F.col("group_size") == 1).withColumn("kept", F.lit(True))
    losing = out.where((F.col("group_size") > 1) & ~winner).withColumn("kept", F.lit(False))
    winning = (out.where((F.col("group_size") > 1) & winner).groupBy("doc_id", "keep_id", "group_size", "digest")
               .agg(F.count(F.lit(1)).cast("int").alias("c"))
               .select("doc_id", "keep_id", "group_size", "digest", F.explode(F.sequence(F.lit(1), "c")).alias("c"))
               .withColumn("kept", F.col("c") == 1).drop("c"))
    return single.unionByName(losing).unionByName(winning)


def kept_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    keep = dedup(docs, scratch).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.max(F.col("group_size")).alias("_size"))
    # group_size 1 and several rows of one id stay as they are: their texts differ.
    digest = normal_digest(text_of())
    repeated = scratch.put(
        docs.groupBy(F.col("doc_id").cast("long").alias("_id"), digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").select("_id", "_digest"), "repeated")
    keep = scratch.put(keep.select("_id", "_digest"), "keep")
    named = docs.withColumn("_row_id", F.col("doc_id").cast("long")).withColumn("_row_digest", digest)
    stays = named.join(keep, F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_digest") == F.col("_digest")), "left_semi")
    if repeated.isEmpty():
        return stays.select(*docs.columns)
    same = F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_digest") == F.col("_digest"))
    once = stays.join(repeated, same, "left_semi").dropDuplicates(["_row_id", "_row_digest"])
    return stays.join(repeated, same, "left_anti").unionByName(once).select(*docs.columns)
