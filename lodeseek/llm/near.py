"""Near duplicates by order MinHash.

A text's words (lower case) give five-word shingles, each labelled with its occurrence number. A sketch takes the ``PICKS``
shingles of least hash and keeps them in text order; texts agree in it with about similarity ** PICKS, if the order
agrees too. Of ``SKETCHES`` sketches, texts at the threshold 0.8 share at least three with probability 0.9998.

Equal word sequences are one text from here on. Texts that share a sketch form a bucket. Buckets are never expanded into
pairs: each first compares its members to its most widely shared text alone. What is still split after that is compared
in full if small; in a large bucket, neighbours in the order of the other sketches are compared. What large buckets still hold apart then meets in an exact prefix-filtered join: texts this similar
share one of the first fifth of their shingles in any common order. Those of one text stand first and are dropped, those of many texts stand
last, so a passage that many texts share joins nothing. Whatever it finds is aligned, however many sketches it shares.

A candidate pair is verified by a banded alignment of the words (greedy, within the diagonals that the threshold allows):
similarity = aligned shingles / (shingles of both - aligned). Linked texts form classes.

Null, empty and wordless texts are classes of their own. Texts of under five words are one shingle, so only equal ones link.
The class id is the least doc_id; null ids are not linked. Repeated rows share their class. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodeseek.llm.common import Scratch
from lodeseek.llm.graph import components
from lodeseek.llm.hashing import WordHasher, mix, ngrams

WORD = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
SKETCHES, PICKS = 20, 3
#: Sketches that two texts must share to be aligned; members of a bucket that are compared with one another.
AGREE, SMALL = 3, 32
#: Texts of fewer shingles need one shared sketch only: at the threshold 8 and 9 words agree in one of 20 with probability 0.99996.
FEW = 16
#: Tokens of at most so many texts are not counted one by one; bytes of a table of tokens that may go to the tasks.
LIGHT, HEAVY_BYTES = 32, 16 << 20
#: Slots of a hashed table of counts: of one block, of all at most; counts end at ``FULL``.
SLOT_BLOCK, MOST_SLOTS, FULL = 1 << 16, 1 << 24, 255
#: Neighbours that a member of a larger bucket is compared with.
NEXT = 3
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Cells of one block of the sketch matrix.
CELLS = 1_000_000
#: A diagonal that no alignment has reached.
NOWHERE = -(1 << 60)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes, made distinct by their occurrence number."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    if fresh.all():
        return shingles
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(ranked)), 0))
    nth = np.empty(len(ranked), np.uint64)
    nth[order] = (np.arange(len(ranked)) - start).astype(np.uint64)
    return mix(shingles + nth * np.uint64(0xD6E8FEB86659FD93))


def sketches(shingles: np.ndarray) -> np.ndarray:
    """One hash per sketch of an ordered list of shingles."""
    marked = labelled(shingles)
    picks = min(PICKS, len(marked))
    out = np.zeros(SKETCHES, np.uint64)
    rows = max(1, CELLS // max(1, len(marked)))
    for at in range(0, SKETCHES, rows):
        seeds = _SEEDS[at:at + rows]
        ranks = (marked[None, :] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        ranks ^= ranks >> np.uint64(32)
        ranks *= np.uint64(0x94D049BB133111EB)
        if picks < len(marked):
            least = np.sort(np.argpartition(ranks, picks - 1, axis=1)[:, :picks], axis=1)
        else:
            least = np.repeat(np.arange(len(marked))[None], len(seeds), 0)
        value = seeds
        for j in range(picks):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + marked[least[:, j]])
        out[at:at + rows] = value
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that both have, in any order: no alignment matches more."""
    both = [labelled(ngrams(x.astype(np.uint64), SHINGLE)) for x in (a, b)]
    return len(np.intersect1d(*both, assume_unique=True))


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of five-word shingles that a banded alignment of the words matches; 0.0 once it can't reach ``threshold``.

    Insertions and deletions are tried in growing number; the band is what the threshold leaves room for.
    """
    k = SHINGLE
    if min(len(a), len(b)) < k:
        return float(len(a) == len(b) and bool((a == b).all()))
    shingles_a, shingles_b = len(a) - k + 1, len(b) - k + 1
    most = int((shingles_a + shingles_b) * (1 - 2 * threshold / (1 + threshold)) + 1e-9)
    if abs(len(a) - len(b)) > most or _common(a, b) * (1 + threshold) < threshold * (shingles_a + shingles_b) - 1e-9:
        return 0.0

    def slide(x: int, y: int) -> int:
        """End in ``a`` of the equal run from (x, y)."""
        size = 16
        while True:
            n = min(size, len(a) - x, len(b) - y)
            if n <= 0:
                return x
            off = a[x:x + n] != b[y:y + n]
            at = int(off.argmax())
            if off[at]:
                return x + at
            x, y, size = x + n, y + n, size * 4

    far, trail = {1: 0}, []
    for d in range(most + 1):
        trail.append(dict(far))
        for diagonal in range(-d, d + 1, 2):
            if diagonal == -d or (diagonal != d and far.get(diagonal - 1, NOWHERE) < far.get(diagonal + 1, NOWHERE)):
                x = far.get(diagonal + 1, NOWHERE)
            else:
                x = far.get(diagonal - 1, NOWHERE) + 1
            y = x - diagonal
            if x < 0 or y < 0 or x > len(a) or y > len(b):
                far[diagonal] = NOWHERE
                continue
            far[diagonal] = end = slide(x, y)
            if end >= len(a) and end - diagonal >= len(b):
                return _similarity(trail, len(a), len(b), shingles_a, shingles_b)
    return 0.0


def _similarity(trail: list[dict[int, int]], x: int, y: int, shingles_a: int, shingles_b: int) -> float:
    """Walk back the alignment; equal runs of n words on one diagonal match n - 4 shingles."""
    matched = run = 0
    for d in range(len(trail) - 1, -1, -1):
        far, diagonal = trail[d], x - y
        if d == 0:
            run += x
            matched += max(0, run - SHINGLE + 1)
            break
        if diagonal == -d or (diagonal != d and far.get(diagonal - 1, NOWHERE) < far.get(diagonal + 1, NOWHERE)):
            px, diagonal = far[diagonal + 1], diagonal + 1
            x_start = px
        else:
            px, diagonal = far[diagonal - 1], diagonal - 1
            x_start = px + 1
        matched += max(0, x - x_start - SHINGLE + 1)
        x, y = px, px - diagonal
    return matched / (shingles_a + shingles_b - matched)


def _digest(words: list[str]) -> bytes:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).digest()[:16]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        digests, values, few = [], [], []
        for text in batch.column(1).to_pylist():
            words = WORD.findall(text.lower()) if text else []
            digests.append(_digest(words) if words else None)
            values.append(sketches(ngrams(hasher(words), SHINGLE)).view(np.int64) if words else None)
            few.append(len(words) < FEW + SHINGLE)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(few)],
                                         ["doc_id", "digest", "sketch", "few"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        texts = [WORD.findall(t.lower()) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([_digest(t) for t in texts], pa.binary()), pa.array([hasher(t).tobytes() for t in texts], pa.binary())],
                                         ["digest", "words"])


def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (2, 3))
        scores = [alignment(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
        linked = pa.array([s >= THRESHOLD - 1e-12 for s in scores], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(linked)


def _verified(pairs: DataFrame, words: DataFrame, scratch: Scratch) -> DataFrame:
    """The links (a, b) among the pairs."""
    left = words.select(F.col("doc").alias("a"), F.col("words").alias("words_a"))
    right = words.select(F.col("doc").alias("b"), F.col("words").alias("words_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b")
    return scratch.put(both.mapInArrow(_align_rows, "a long, b long"), "links")


def _agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that share enough sketches: one where a text has few shingles, as there a sketch agrees more rarely."""
    left = texts.select(F.col("doc").alias("a"), F.col("sketch").alias("_sa"), F.col("few").alias("_fa"))
    right = texts.select(F.col("doc").alias("b"), F.col("sketch").alias("_sb"), F.col("few").alias("_fb"))
    both = pairs.join(left, "a").join(right, "b")
    agree = F.aggregate(F.zip_with("_sa", "_sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.where(agree >= F.when(F.col("_fa") | F.col("_fb"), 1).otherwise(AGREE)).select("a", "b")


def _whole(members: DataFrame) -> DataFrame:
    """Pairs of different components inside buckets of bounded size."""
    left = members.select("key", F.col("doc").alias("a"), F.col("component").alias("_ca"))
    right = members.select("key", F.col("doc").alias("b"), F.col("component").alias("_cb"))
    return left.join(right, "key").where("a < b and _ca != _cb").select("a", "b")


def _split(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """``buckets`` (key, i, doc) that hold several components: key, i, doc, component, n (members)."""
    named = buckets.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("key", "i", "doc", F.coalesce("component", "doc").alias("component"))
    split = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    return named.join(split.where("_lo != _hi").select("key", "n"), "key")


def _neighbours(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components next to each other in a bucket, ordered by the sketches that follow the bucket's own.

    Texts that agree in a run of sketches stand together, so each meets those most like it; cost is linear in the bucket.
    """
    turned = F.concat(F.slice("sketch", F.col("i") + 2, SKETCHES), F.slice("sketch", F.lit(1), F.col("i")))
    rows = members.join(texts.select("doc", "sketch"), "doc").select("key", "doc", "component", turned.alias("turned"))
    order = Window.partitionBy("key").orderBy("turned", "doc")
    nexts = F.array(*[F.struct(F.lead("doc", k).over(order).alias("doc"), F.lead("component", k).over(order).alias("component"))
                      for k in range(1, NEXT + 1)])
    rows = rows.withColumn("_next", nexts).select("doc", "component", F.explode(F.filter("_next", lambda x: x["component"] != F.col("component"))).alias("other"))
    return rows.select(F.least("doc", "other.doc").alias("a"), F.greatest("doc", "other.doc").alias("b"))


def _apart(members: DataFrame) -> DataFrame:
    """(doc, component, minor) of buckets that are still split. A text is minor if in one of its buckets another component is the
    largest: of two texts of one bucket in different components one is."""
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("_m"))
    tops = counts.groupBy("key").agg(F.max_by("component", F.struct("_m", "component")).alias("_top"))
    return members.join(tops, "key").groupBy("doc", "component").agg(F.bool_or(F.col("component") != F.col("_top")).alias("minor"))


def _tokens(raw: bytes) -> np.ndarray:
    return labelled(ngrams(np.frombuffer(raw, np.uint64), SHINGLE)).view(np.int64)


def slots_for(cells: int) -> int:
    """Slots of a table for so many tokens, a power of two; beyond ``MOST_SLOTS`` counts are larger than needed, never too small."""
    return min(MOST_SLOTS, max(SLOT_BLOCK, 1 << (8 * cells).bit_length()))


def _slot_counts(slots: int):
    """Texts and minor texts per slot of a hashed table, as blocks of (block, places, texts, minors): each task sums what it reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, minors = np.zeros(slots, np.uint8), np.zeros(slots, bool)
        for batch in batches:
            for minor, raw in zip(batch.column("minor").to_pylist(), batch.column("words").to_pylist()):
                at, n = np.unique(slot_of(_tokens(raw), slots), return_counts=True)
                texts[at] = np.minimum(texts[at] + n, FULL)
                if minor:
                    minors[at] = True
        for block in range(slots // SLOT_BLOCK):
            part = slice(block * SLOT_BLOCK, (block + 1) * SLOT_BLOCK)
            places = np.flatnonzero(texts[part])
            if len(places):
                columns = places.astype(np.uint16), texts[part][places], minors[part][places].view(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
                                                 ["block", "places", "texts", "minors"])

    return run


def _slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (block, rank) of each block, whose parts stand in one task: texts per slot up to ``FULL``; 0 where no two texts or no minor one can meet."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, *parts in zip(*(c.to_pylist() for c in batch.columns)):
            texts, minors = sums.setdefault(block, (np.zeros(SLOT_BLOCK, np.uint8), np.zeros(SLOT_BLOCK, bool)))
            places, n, minor = np.frombuffer(parts[0], np.uint16), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], np.uint8)
            texts[places] = np.minimum(texts[places].astype(np.int64) + n, FULL)
            minors[places] |= minor.astype(bool)
    for block, (texts, minors) in sums.items():
        rank = np.where(minors & (texts > 1), texts, 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rank.tobytes()], pa.binary())], ["block", "rank"])


def slot_of(tokens: np.ndarray, slots: int) -> np.ndarray:
    return (mix(tokens.view(np.uint64)) & np.uint64(slots - 1)).astype(np.int64)


def _token_counts(shared):
    """Texts per token whose slot has more than ``LIGHT``, with the least and largest component, added up in blocks of bounded size."""
    def packed(tokens, components):
        token, component = np.concatenate(tokens), np.concatenate(components)
        order = np.lexsort((component, token))
        token, component = token[order], component[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(token)] if len(token) else first
        return pa.RecordBatch.from_arrays([pa.array(token[first]), pa.array(last - first), pa.array(component[first]), pa.array(component[last - 1])],
                                          ["token", "n", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        tokens, components, cells = [], [], 0
        for batch in batches:
            for component, raw in zip(batch.column("component").to_pylist(), batch.column("words").to_pylist()):
                found = _tokens(raw)
                tokens.append(found[ranks[slot_of(found, len(ranks))] > LIGHT])
                components.append(np.full(len(tokens[-1]), component))
                cells += len(tokens[-1])
                if cells >= CELLS:
                    yield packed(tokens, components)
                    tokens, components, cells = [], [], 0
        if tokens:
            yield packed(tokens, components)

    return run


def is_in(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens a sorted array has."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def prefix_of(tokens: np.ndarray, rank: np.ndarray, heavy: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a text's prefix and how many of its tokens stand from each on. Tokens of rank 0 stand first and join nothing, as do
    heavy ones of one component; then light ones by the rank of their slot, heavy ones by their count."""
    is_heavy = is_in(tokens, heavy)
    at = np.minimum(np.searchsorted(heavy, tokens), max(0, len(heavy) - 1))
    n = np.where(is_heavy, counts[at], 0) if len(heavy) else np.zeros(len(tokens), np.int64)
    places = len(tokens) - math.ceil(len(tokens) * THRESHOLD - 1e-9) + 1
    order = np.lexsort((tokens, rank, n, rank > 0))[:places]
    open_ = (rank[order] > 0) & (~is_heavy[order] | shared[at[order]] if len(heavy) else True)
    return tokens[order][open_], (len(tokens) - np.arange(len(order)))[open_]


def _prefix_rows(ranks, *tables: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = [_tokens(raw) for raw in part.column("words").to_pylist()]
                found = [prefix_of(t, table[slot_of(t, len(table))], *tables) for t in tokens]
                lengths = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[0] for f in found])), pa.array(np.repeat(part.column("doc").to_numpy(), lengths)),
                     pa.array(np.repeat(part.column("component").to_numpy(), lengths)), pa.array(np.repeat([len(t) for t in tokens], lengths)),
                     pa.array(np.concatenate([f[1] for f in found]))], ["token", "doc", "component", "size", "rest"])

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, component, raw in zip(*(batch.column(c).to_pylist() for c in ("doc", "component", "words"))):
            tokens = _tokens(raw)
            for at in range(0, len(tokens), CELLS):
                part = tokens[at:at + CELLS]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.full(len(part), v)) for v in (doc, component, len(tokens)))],
                                                 ["token", "doc", "component", "size"])


def _slot_ranks(rows: DataFrame, scratch: Scratch) -> np.ndarray:
    """The hashed table of :func:`_slot_sums`, at most ``MOST_SLOTS`` bytes: summed in the tasks and then by block, so no token is a row."""
    slots = slots_for(int(rows.agg(F.sum(F.length("words"))).first()[0] or 0) // 8)
    parts = rows.mapInArrow(_slot_counts(slots), "block int, places binary, texts binary, minors binary")
    sums = scratch.put(parts.repartition("block").mapInArrow(_slot_sums, "block int, rank binary"), "slots").toArrow()
    ranks = np.zeros(slots, np.uint8)
    for block, raw in zip(sums.column("block").to_pylist(), sums.column("rank")):
        ranks[block * SLOT_BLOCK:(block + 1) * SLOT_BLOCK] = np.frombuffer(raw.as_buffer(), np.uint8)
    return ranks


def _prefixes(rows: DataFrame, scratch: Scratch, bound: int) -> DataFrame:
    """(token, doc, component, size, rest) of the prefixes of ``rows`` (doc, component, minor, words).

    One text of every pair is minor, so only tokens of minor texts can meet. The order of tokens needs no exact counts, only a rank that
    is the same in every text: texts counted by slot of a hashed table. Tokens alone in their slot join nothing and stand first, so texts hand on
    only tokens that may meet. A slot counts no less than any of its tokens, so tokens of more than ``LIGHT`` texts are counted
    one by one only where the slot has as many. Up to ``bound`` bytes these go to the tasks, beyond it all tokens are joined with them.
    """
    ranks = rows.sparkSession.sparkContext.broadcast(_slot_ranks(rows, scratch))
    counted = rows.mapInArrow(_token_counts(ranks), "token long, n long, lo long, hi long").groupBy("token").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    heavy = scratch.put(counted.where(F.col("n") > LIGHT).select("token", "n", (F.col("lo") != F.col("hi")).alias("shared")), "heavy")
    if scratch.size(heavy) <= bound:
        table = heavy.orderBy("token").toArrow()
        arrays = [table.column(c).to_numpy() for c in ("token", "n", "shared")]
        return rows.mapInArrow(_prefix_rows(ranks, *arrays), "token long, doc long, component long, size long, rest long")
    tokens = rows.mapInArrow(_token_rows, "token long, doc long, component long, size long").join(heavy, "token", "left")
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.coalesce("n", F.lit(0)), "token"))
    tokens = tokens.withColumn("_r", place).where(F.col("_r") <= F.col("size") - F.ceil(F.col("size") * THRESHOLD - 1e-9) + 1)
    return tokens.where(F.coalesce("shared", F.lit(True))).select("token", "doc", "component", "size", (F.col("size") - F.col("_r") + 1).alias("rest"))


def _prefix_pairs(apart: DataFrame, words: DataFrame, scratch: Scratch, bound: int = HEAVY_BYTES) -> DataFrame:
    """Pairs of ``apart`` (doc, component, minor) in different components, one of them minor, that share a token of their prefixes.

    Similarity t needs t * size shared shingles, so of each text the first size - ceil(t * size) + 1 in a common order can't
    all differ. Of the shared tokens the first stands before all others, so what follows it in both texts must be enough for
    t / (1 + t) of both sizes (positional bound): texts that share less than that never become a pair.
    """
    rows = scratch.put(apart.join(words, "doc").select("doc", "component", "minor", "words"), "apart_words")
    prefix = scratch.put(_prefixes(rows, scratch, bound), "prefix")
    left, right = (prefix.select("token", F.col("doc").alias(x), F.col("component").alias(f"_c{x}"), F.col("size").alias(f"_n{x}"),
                                 F.col("rest").alias(f"_r{x}")) for x in "ab")
    enough = F.least("_ra", "_rb") >= THRESHOLD / (1 + THRESHOLD) * (F.col("_na") + F.col("_nb")) - 1e-9
    return left.join(right, "token").where(enough & (F.col("_ca") != F.col("_cb")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, class_id, class_size of every row."""
    rows = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sketch_rows, "doc_id long, digest binary, sketch array<long>, few boolean"), "sketches")
    texts = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("few").alias("few"))
    texts = scratch.put(texts.withColumn("doc", F.monotonically_increasing_id()), "texts")  # a number of its own: rows may share a doc_id
    bands = texts.select("doc", F.posexplode("sketch").alias("i", "_v")).select("doc", "i", F.xxhash64("i", "_v").alias("key"))
    sizes = scratch.put(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    members = scratch.put(bands.join(sizes, "key"), "members")
    spread = members.groupBy("doc").agg(F.sum("n").alias("spread"))
    members = scratch.put(members.drop("n").join(spread, "doc"), "members")
    wanted = scratch.put(texts.select("digest", "doc", "least").join(members.select("doc").distinct(), "doc"), "wanted")
    sources = docs.select(F.col("doc_id").cast("long").alias("least"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = scratch.put(sources.join(scratch.small(wanted), "least", "left_semi").select("text").mapInArrow(_word_rows, "digest binary, words binary")
                        .dropDuplicates(["digest"]).join(wanted.select("digest", "doc"), "digest").select("doc", "words"), "words")
    # first round: every member against the most widely shared text of its bucket
    hub = F.max_by("doc", F.struct("spread", -F.col("doc"))).alias("hub")
    hubs = members.groupBy("key").agg(hub)
    pairs = members.join(hubs, "key").where("doc != hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    pairs = scratch.put(_agreeing(pairs, texts), "pairs")
    links = _verified(pairs, words, scratch)
    tested = pairs
    found = components(links, scratch)
    named = scratch.put(_split(members.select("key", "i", "doc"), found), "buckets")
    # second round: small buckets in full, members of large ones against their neighbours
    pairs = _whole(named.where(F.col("n") <= SMALL)).union(_neighbours(named.where(F.col("n") > SMALL), texts)).distinct()
    pairs = scratch.put(_agreeing(pairs.join(tested, ["a", "b"], "left_anti"), texts), "pairs")
    new = _verified(pairs, words, scratch)
    large = named.where(F.col("n") > SMALL).select("key", "i", "doc")
    if not new.isEmpty():
        links, tested = scratch.put(links.union(new), "links"), tested.union(pairs)
        found = components(links, scratch)
    apart = scratch.put(_apart(_split(large, found)), "apart")
    if not apart.isEmpty():
        pairs = _prefix_pairs(apart, words, scratch).join(tested, ["a", "b"], "left_anti")
        new = _verified(scratch.put(pairs, "pairs"), words, scratch)
        if not new.isEmpty():
            found = components(scratch.put(links.union(new), "links"), scratch)
    # back to the rows: only texts with copies or links can have another class than their own id
    joined = texts.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = joined.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")).where("class_size > 1")
    named = scratch.put(joined.join(sizes, "component").select("digest", "class_id", "class_size"), "named")
    out = rows.select("doc_id", "digest").join(named, "digest", "left")
    alone = F.col("doc_id").isNull()
    return out.select("doc_id", F.when(alone, None).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
                      F.when(alone, 1).otherwise(F.coalesce("class_size", F.lit(1))).cast("long").alias("class_size"))


def kept_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` whose id is that of their class, all columns."""
    gone = scratch.put(classes(docs, scratch).where("doc_id != class_id").select(F.col("doc_id").alias("_gone_id")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("_gone_id"), "left_anti")
