"""Removal of passages that repeat across documents, by recompression.

A text's words become symbols. Steps name either maximal runs of one symbol or disjoint pairs (left and right symbols are
told apart by a hash of the name), and names are hashes of their content, so all documents agree on them without a
dictionary. Equal passages get equal symbols inside, whatever surrounds them: with each symbol goes its context, the words
that settle it. A window of ``WINDOW`` words can only start in another document if every symbol whose context it
contains also occurs there. Spark groups the high-level symbols of the corpus once; a window with a symbol that one document
alone has is ruled out, and so is its removal where no smaller document has the symbol. The few windows left, and those no context fits
into, are verified: they meet by 128-bit hashes of their words, and a word is removed if a window over it starts in a document with a
smaller id.

Words are unchanged runs of non-space. Null and empty texts have no words; texts under ``WINDOW`` words lose none. Texts with
equal words stand for each other: the least id has them, larger ids lose everything. Rows that repeat an id lose equal words equally; a null
id is larger than any other. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.llm.common import Scratch
from lodeseek.llm.hashing import byte_hashes, byte_words, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 50
#: Steps of the recompression: r names runs, p pairs. Long runs make contexts that no window holds; such windows
#: (the same ones in every document) fall back on symbols of pairs alone.
PLAN, PAIRS_ONLY = "rpppppp", "pppppp"
#: Words worked on at once.
CHUNK_WORDS = 50_000
FAR = 1 << 60
NO_ID = (1 << 63) - 1
_C = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(1, 33, dtype=np.uint64) * _C
_TIMES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95))


def recompress(names: np.ndarray, doc: np.ndarray, plan: str = PLAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, word after the last) of the top symbols' contexts; words of documents lie one after another.

    A context that would need what lies beyond a text's end is unbounded on that side.
    """
    low = np.arange(len(names), dtype=np.int64)
    high = low + 1
    for k, kind in enumerate(plan):
        if kind == "r":
            same = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
            first = np.flatnonzero(np.r_[True, ~same])
            last = np.r_[first[1:], len(names)] - 1
            count = (last - first + 1).astype(np.uint64)
            named = np.where(count > 1, mix(names[first] * _C + count), names[first])
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(names) - 1)
            has_before = (first > 0) & (doc[before] == doc[first])
            has_after = (last < len(names) - 1) & (doc[after] == doc[last])
            new_low = np.where(has_before, np.minimum(low[first], low[before]), -FAR)
            new_high = np.where(has_after, np.maximum(high[last], high[after]), FAR)
            names, doc, low, high = named, doc[first], new_low, new_high
            continue
        left = (mix(names + _SALTS[k]) >> np.uint64(63)) == 1
        next_same = np.r_[doc[1:] == doc[:-1], False]
        opens = np.r_[left[:-1] & ~left[1:], False] & next_same
        closes = np.r_[False, opens[:-1]]
        prev_same = np.r_[False, next_same[:-1]]
        next_high, next_low = np.r_[high[1:], FAR], np.r_[low[1:], FAR]
        prev_high, prev_low = np.r_[-FAR, high[:-1]], np.r_[-FAR, low[:-1]]
        new_low, new_high = low.copy(), high.copy()
        ahead = opens | (left & next_same)  # a pair, or a left symbol whose next is left too
        new_low[ahead] = np.minimum(low, next_low)[ahead]
        new_high[ahead] = np.maximum(high, next_high)[ahead]
        new_high[left & ~next_same] = FAR
        behind = ~left & prev_same & ~closes
        new_low[behind] = np.minimum(low, prev_low)[behind]
        new_high[behind] = np.maximum(high, prev_high)[behind]
        new_low[~left & ~prev_same] = -FAR
        named = names.copy()
        named[opens] = mix(mix(names[opens]) * _C + names[closes])
        stay = ~closes
        names, doc, low, high = named[stay], doc[stay], new_low[stay], new_high[stay]
    return names, low, high


class Chunk:
    """Documents of at least ``WINDOW`` words (their hashes), worked on together."""

    def __init__(self, words: list[np.ndarray]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.ids = np.concatenate(words)
        self.begin = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        self.final = self.begin + self.lengths - WINDOW  # last start of a window
        self.doc = np.repeat(np.arange(len(words)), self.lengths)
        self.starts = np.arange(len(self.ids)) <= self.final[self.doc]
        self._keep(*recompress(self.ids, self.doc))
        self.top = len(self.names)
        bare = self.starts & ~self.covered(np.arange(self.top))
        self.bare = bare
        if bare.any():
            top = self.names, self.low, self.high
            loose = np.zeros(len(words), bool)
            loose[self.doc[bare]] = True
            at = np.flatnonzero(loose[self.doc])
            names, low, high = recompress(self.ids[at], self.doc[at], PAIRS_ONLY)
            inside = (low >= 0) & (high < FAR)
            names, low, high = mix(names[inside]), at[low[inside]], at[high[inside] - 1] + 1
            self._keep(names, low, high)
            before = np.r_[0, np.cumsum(bare)]
            start = np.maximum(self.high - WINDOW, self.begin[self.owner])
            end = np.maximum(np.minimum(self.low, self.final[self.owner]) + 1, start)
            used = before[end] > before[start]
            self._keep(*(np.r_[a, b[used]] for a, b in zip(top, (self.names, self.low, self.high))))

    def _keep(self, names: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Take the symbols whose context a window can hold."""
        useful = (low >= 0) & (high < FAR) & (high - low <= WINDOW)
        self.names, self.low, self.high = names[useful], low[useful], high[useful]
        self.owner = self.doc[self.low]

    def covered(self, which: np.ndarray) -> np.ndarray:
        """Starts of windows that contain the context of one of the chosen symbols."""
        return self.counts(which) > 0

    def counts(self, which: np.ndarray) -> np.ndarray:
        """Number of the chosen symbols whose context the window at each start contains."""
        owner = self.owner[which]
        start = np.maximum(self.high[which] - WINDOW, self.begin[owner])
        end = np.minimum(self.low[which], self.final[owner]) + 1
        start, end = start[end > start], end[end > start]
        steps = np.bincount(start, minlength=len(self.ids) + 1) - np.bincount(end, minlength=len(self.ids) + 1)
        return np.cumsum(steps)[:-1]

    def holds(self, which: np.ndarray) -> np.ndarray:
        """Starts of windows that contain one of the marked symbols; the fallback's symbols count in the windows they are for."""
        places = np.flatnonzero(which)
        return self.covered(places[places < self.top]) | (self.bare & self.covered(places[places >= self.top]))

    def needed(self) -> np.ndarray:
        """Per document, the fewest symbols in a row that any of its windows holds; 0 if a window holds none.

        Of a window's symbols only those of one parse count, which stand in a row.
        """
        top = self.counts(np.arange(self.top))
        least = np.where(top > 0, top, self.counts(np.arange(self.top, len(self.names))))
        return np.minimum.reduceat(np.where(self.starts, least, len(self.ids)), self.begin)

    def hashes(self, at: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of the windows that start at ``at``."""
        out = []
        for i, times in enumerate(_TIMES):
            powers = np.r_[np.uint64(1), np.multiply.accumulate(np.full(len(self.ids), times))]
            back = np.uint64(pow(int(times), -1, 1 << 64))
            inverse = np.r_[np.uint64(1), np.multiply.accumulate(np.full(len(self.ids), back))]
            sums = np.r_[np.uint64(0), np.cumsum(mix(self.ids + np.uint64(i)) * powers[:-1])]
            out.append(mix((sums[at + WINDOW] - sums[at]) * inverse[at]).view(np.int64))
        return out


def _chunks(items: Iterator[tuple]) -> Iterator[tuple[list[tuple], Chunk]]:
    """Items, whose second part is an array of word hashes, in lists of bounded length."""
    waiting, count = [], 0
    for item in items:
        waiting.append(item)
        count += len(item[1])
        if count >= CHUNK_WORDS:
            yield waiting, Chunk([w[1] for w in waiting])
            waiting, count = [], 0
    if waiting:
        yield waiting, Chunk([w[1] for w in waiting])


def _digest(words: list[str]) -> bytes:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).digest()


def _symbol_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.num_rows
        counts, digests, symbols, needed = [0] * size, [b""] * size, [None] * size, [1] * size

        def long_texts():
            for i, text in enumerate(batch.column(1)):
                data = byte_words(text.as_py())
                words = byte_hashes(data)
                counts[i], digests[i] = len(words), hashlib.sha256(data).digest()
                if len(words) >= WINDOW:
                    yield i, words

        for items, chunk in _chunks(long_texts()):
            order = np.argsort(chunk.owner, kind="stable")
            edges = np.searchsorted(chunk.owner[order], np.arange(len(items) + 1))
            for j, ((i, _), need) in enumerate(zip(items, chunk.needed().tolist())):
                symbols[i], needed[i] = chunk.names[order[edges[j]:edges[j + 1]]].view(np.int64), need
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(symbols, pa.list_(pa.int64())),
             pa.array(needed, pa.int64())], ["id", "n_words", "digest", "symbols", "needed"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that may repeat: two hashes, id, digest, first word, and whether they may be removed."""
    for batch in batches:
        def texts():
            for i, (text, digest, shared, mine) in enumerate(zip(*(batch.column(c) for c in range(1, 5)))):
                data = byte_words(text.as_py())
                if hashlib.sha256(data).digest() == digest.as_py():
                    yield i, byte_hashes(data), *(np.array(x.as_py() or [], np.int64).view(np.uint64) for x in (shared, mine))

        for part, chunk in _chunks(texts()):
            known, own = np.zeros(len(chunk.names), bool), np.zeros(len(chunk.names), bool)
            for j, (_, _, shared, mine) in enumerate(part):
                here = chunk.owner == j
                known[here] = np.isin(chunk.names[here], shared)
                own[here] = np.isin(chunk.names[here], mine)
            maybe = chunk.starts & ~chunk.holds(~known)
            at = np.flatnonzero(maybe)
            target = ~chunk.holds(own)[at]
            first, second = chunk.hashes(at)
            row = np.array([p[0] for p in part])[chunk.doc[at]] if len(at) else np.zeros(0, np.int64)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(first), pa.array(second), batch.column(0).take(row), batch.column(2).take(row),
                 pa.array(at - chunk.begin[chunk.doc[at]], pa.int64()), pa.array(target, pa.bool_())],
                ["h1", "h2", "id", "digest", "at", "target"])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of texts with removed windows."""
    for batch in batches:
        digests, removed, kept = [], [], []
        for text, digest, starts in zip(*(batch.column(c).to_pylist() for c in range(1, 4))):
            words = WORD.findall(text)
            if _digest(words) != digest:
                continue
            steps = np.zeros(len(words) + 1, np.int64)
            at = np.array(starts, np.int64)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + WINDOW, -1)
            gone = np.cumsum(steps)[:-1] > 0
            digests.append(digest)
            removed.append(int(gone.sum()))
            kept.append(" ".join([w for w, g in zip(words, gone) if not g]))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         ["digest", "n_removed", "kept"])


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_words, n_removed, digest (of the words), kept_digest, kept (the text left; null where nothing is removed)."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))
    rows = scratch.put(named.mapInArrow(_symbol_rows, "id long, n_words long, digest binary, symbols array<long>, needed long"), "symbols")
    long = rows.where(F.col("n_words") >= WINDOW)
    firsts = scratch.put(long.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed")), "firsts")
    single = long.join(firsts.where("n > 1").select("digest"), "digest", "left_anti").select("id", "digest", "symbols", "needed")
    copied = long.join(firsts.where("n > 1").select("digest", F.col("id").alias("_first")), "digest").where(
        "id = _first").groupBy("digest").agg(F.min("id").alias("id"), F.first("symbols").alias("symbols"), F.first("needed").alias("needed")).select(
            "id", "digest", "symbols", "needed")
    points = single.union(copied).select("id", "digest", "needed", F.posexplode("symbols").alias("place", "symbol"))
    shared = points.groupBy("symbol").agg(F.min("id").alias("least"), F.max("id").alias("_most")).where("least < _most").select("symbol", "least")
    shared = scratch.put(shared, "shared")
    marks = points.join(shared, "symbol").groupBy("id", "digest", "needed").agg(
        F.sort_array(F.collect_list("place")).alias("places"), F.collect_set("symbol").alias("shared"),
        F.collect_set(F.when(F.col("id") == F.col("least"), F.col("symbol"))).alias("mine"))
    # only where enough shared symbols stand in a row can a window have no other
    in_a_row = F.exists(F.sequence(F.lit(0).cast("long"), F.size("places") - F.col("needed")),
                        lambda i: F.get("places", (i + F.col("needed") - 1).cast("int")) - F.get("places", i.cast("int")) == F.col("needed") - 1)
    marks = marks.where((F.col("needed") <= 0) | ((F.size("places") >= F.col("needed")) & in_a_row)).select("id", "digest", "shared", "mine")
    none = F.array().cast("array<long>")
    loose = firsts.where("needed <= 0").select("id", "digest", none.alias("shared"), none.alias("mine"))
    marks = marks.union(loose).groupBy("id", "digest").agg(F.flatten(F.collect_list("shared")).alias("shared"), F.flatten(F.collect_list("mine")).alias("mine"))
    marks = scratch.put(marks, "marks")
    ids = scratch.put(marks.select("id").distinct(), "ids")
    suspects = named.where("text is not null").join(scratch.small(ids), "id", "left_semi").join(marks, "id")
    windows = suspects.select("id", "text", "digest", "shared", "mine").mapInArrow(
        _window_rows, "h1 long, h2 long, id long, digest binary, at long, target boolean")
    windows = scratch.put(windows, "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("id").alias("_least"), F.max("id").alias("_most")).where("_least < _most")
    hits = windows.where("target").join(least, ["h1", "h2"]).where("_least < id")
    hits = scratch.put(hits.groupBy("id", "digest").agg(F.collect_set("at").alias("starts")), "hits")
    ids = scratch.put(hits.select("id").distinct(), "ids")
    texts = named.where("text is not null").join(scratch.small(ids), "id", "left_semi").join(hits, "id")
    cut = texts.select("id", "text", "digest", "starts").mapInArrow(_kept_rows, "digest binary, n_removed long, kept string")
    cut = scratch.put(cut.dropDuplicates(["digest"]), "cut")
    changed = firsts.join(cut, "digest", "left").where("n > 1 or n_removed is not null").select(
        "digest", F.col("id").alias("_first"), F.col("n_removed").alias("_removed"), F.col("kept").alias("_kept"))
    out = rows.select("id", "n_words", "digest").join(scratch.put(changed, "changed"), "digest", "left")
    later = F.col("_first").isNotNull() & (F.col("id") > F.col("_first"))
    kept = F.when(later, F.lit("")).otherwise(F.col("_kept"))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words",
                      F.when(later, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"), "digest",
                      F.when(kept.isNull(), F.lower(F.hex("digest"))).otherwise(F.sha2(kept, 256)).alias("kept_digest"), kept.alias("kept"))
