"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings of four to seven letters. A bounded sample of the labelled texts of the learning folds is
the index, with all their terms: no term is chosen or left out, so the vocabulary is that of the sample. Document counts over
every labelled text give the terms' weights: idf times the deviation of the term's toxic share from chance (absolute z), so that
terms that go with the label decide nearness and the others hardly move it.

The index is block-max: examples with like terms make a block of ``BLOCK``. Terms that many examples have are cut by block, and each
block notes its largest weight of each; terms of few examples are short postings, read whole. A block's bound is the best share
of the rare terms in it plus the sum of its maxima; a query opens the most promising blocks, and then only those whose bound
reaches the k-th cosine found. What could be among the k nearest is scored again in full, so the result is exact. Votes of
the k nearest, weighted by nearness, are calibrated on the examples themselves. Nobody votes for itself: a text is judged without
the example of the same text, in learning and in scoring. The nearest examples are the evidence.

A text without a weighted term of the sample (null and empty texts too) gets the toxic share of labelled texts like it. Copies of
a labelled text count once, under their smallest id, as toxic if any is. The sample is the labelled texts of least digest; ties in
nearness go by digest too, so ids never matter. Repeated rows get equal scores; several labels of one id count as toxic if any is;
null labels and labels without a document are unused. Of long texts the distinct words are held, one text at a time; examples reach the driver as
such counts. Without toxic examples all scores are the share of toxic labels. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.llm.common import Scratch, fold_of

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
#: Bound of the model: examples in the index.
EXAMPLES = 4096
NEIGHBOURS, EVIDENCE = 10, 3
#: Examples of a block; blocks opened before the others are judged by their bounds.
BLOCK, FIRST = 64, 2
#: Texts searched at once; a term is common if one in so many examples has it.
BATCH, COMMON = 128, 24
#: Rounding of sums in single precision; whatever comes this near to the k-th best is opened and scored again.
SLACK = 1e-4
#: Weight of the prior among the votes; nearness is 1 / (NEAR + 1 - cosine).
PRIOR, NEAR = 1.0, 0.1
THRESHOLD = 0.7
#: Words a task remembers before it starts anew.
REMEMBERED = 200_000


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def _count_rows(shared):
    """term, toxic, clean: texts that have the term of the vocabulary, summed per task; "" counts texts without any."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w) if t in vocabulary}
                (toxic if label else clean).update(found or [""])
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
                                          pa.array([clean[n] for n in names], pa.int64())], ["term", "toxic", "clean"])

    return work


class Vectors:
    """Sparse unit vectors of texts over the vocabulary."""

    def __init__(self, terms: dict[str, int], idf: np.ndarray):
        self.terms, self.idf = terms, idf
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.of_counts(Counter(WORD.findall(text.lower()) if text else []))

    def of_counts(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, terms, found = self.known, self.terms, []
        for w in counts:
            mine = known.get(w)
            if mine is None:
                mine = known[w] = tuple([terms[t] for t in terms_of(w) if t in terms])
            found.append(mine)
        all_ids = np.fromiter(chain.from_iterable(found), np.int64)
        times = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), np.fromiter(map(len, found), np.int64, len(found)))
        ids, place = np.unique(all_ids, return_inverse=True)
        weights = (1 + np.log(np.bincount(place, times, len(ids)))) * self.idf[ids] if len(ids) else np.zeros(0)
        ids, weights = ids[weights > 0], weights[weights > 0]
        return ids, weights / np.sqrt((weights ** 2).sum()) if len(ids) else weights


def like_blocks(rows: list[tuple[np.ndarray, np.ndarray]], size: int = BLOCK) -> np.ndarray:
    """An order of the vectors in which those with like terms stand together: halved again and again across the direction in which a
    projection of them spreads most."""
    flat = np.zeros((len(rows), 64))
    for n, (ids, weights) in enumerate(rows):
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
        flat[n] = np.bincount((mixed & np.uint64(63)).astype(np.int64), weights * np.where(mixed >> np.uint64(6), 1.0, -1.0), 64)
    done, todo = [], [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            done.append(part)
            continue
        centred = flat[part] - flat[part].mean(0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        part = part[np.argsort(along, kind="stable")]
        half = -(-len(part) // (2 * size)) * size
        todo += [part[half:], part[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def _runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, ... of each run."""
    ends = np.cumsum(lengths, dtype=np.int32)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int32) + np.repeat((first - ends + lengths).astype(np.int32), lengths)


@dataclass
class BlockIndex:
    """The vectors of the examples in blocks, and their postings with the maxima of blocks."""

    places: np.ndarray  # first entry of each example
    terms: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    digests: np.ndarray
    size: int  # of the vocabulary

    @classmethod
    def build(cls, rows: list[tuple[int, int, int, np.ndarray, np.ndarray]], terms: int) -> "BlockIndex":
        """``rows``: id, label, digest, terms and weights of each example."""
        rows = sorted(rows, key=lambda r: r[2])
        rows = [rows[i] for i in like_blocks([(r[3], r[4]) for r in rows])]
        lengths = np.array([len(r[3]) for r in rows], np.int64)
        return cls(np.r_[0, np.cumsum(lengths)], np.concatenate([np.zeros(0, np.int32), *(r[3].astype(np.int32) for r in rows)]),
                   np.concatenate([np.zeros(0, np.float32), *(r[4].astype(np.float32) for r in rows)]),
                   np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.int64), terms)

    def __post_init__(self) -> None:
        self._ready = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")} | {"_ready": False}

    def _prepare(self) -> None:
        """Postings by term and block maxima; made where they are used, so they needn't travel."""
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.places))
        counts = np.bincount(self.terms, minlength=self.size)
        common = np.flatnonzero(counts > len(self.ids) / COMMON)
        self._row = np.full(self.size, -1, np.int64)
        self._row[common] = np.arange(len(common))
        often = self._row[self.terms] >= 0
        dense = np.zeros((len(common), len(self.ids)), np.float32)
        dense[self._row[self.terms[often]], owner[often]] = self.weights[often]
        self._starts = np.arange(0, len(self.ids), BLOCK)
        self._dense = [np.ascontiguousarray(dense[:, at:at + BLOCK]) for at in self._starts]
        self._most = np.stack([d.max(1) for d in self._dense], 1)
        order = np.flatnonzero(~often)
        order = order[np.argsort(self.terms[order], kind="stable")]
        self._first = np.r_[0, np.cumsum(np.where(self._row >= 0, 0, counts))]
        self._length = np.diff(self._first).astype(np.int32)
        self._first = self._first.astype(np.int32)
        self._owner, self._impact = owner[order], self.weights[order]  # as bincount takes them
        self._query = np.zeros(self.size, np.float32)
        self._ready, self.bounded, self.opened = True, 0, 0

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, cosines) of the k nearest examples with a common term, nearest first; the text of digest ``without`` is none."""
        if not self._ready:
            self._prepare()
        return [f for at in range(0, len(queries), BATCH) for f in self._batch(queries[at:at + BATCH], k, without[at:at + BATCH])]

    def _batch(self, queries, k: int, without) -> list[tuple[np.ndarray, np.ndarray]]:
        wide = np.zeros((len(queries), len(self._row[self._row >= 0])), np.float32)
        scores = np.zeros((len(queries), len(self.ids)), np.float32)  # the share of the rarer terms, whole
        for n, (ids, weights) in enumerate(queries):
            row = self._row[ids]
            often = row >= 0
            wide[n, row[often]] = weights[often]
            first = self._first[ids[~often]]
            lengths = self._length[ids[~often]]
            entries = _runs(first, lengths)
            scores[n] = np.bincount(self._owner[entries], self._impact[entries] * np.repeat(weights[~often].astype(np.float32), lengths), len(self.ids))
            if without[n] is not None:
                scores[n, self.digests == without[n]] = -np.inf
        # the common terms add at most the block's maxima to the best share in it
        bound = wide @ self._most + np.maximum.reduceat(scores, self._starts, 1)
        early = np.zeros(bound.shape, bool)
        early[np.arange(len(bound))[:, None], np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]] = True
        cosines = np.full(scores.shape, -np.inf, np.float32)
        self._open(early, wide, scores, cosines)
        late = ~early & (bound >= self._marks(cosines, k)[:, None] - SLACK) & (bound > 0)
        self._open(late, wide, scores, cosines)
        self.bounded, self.opened = self.bounded + bound.size, self.opened + int(early.sum() + late.sum())
        marks, out = self._marks(cosines, k), []
        for n, (ids, weights) in enumerate(queries):
            found = np.flatnonzero((cosines[n] >= marks[n] - SLACK) & (cosines[n] > 0))
            exact = np.zeros(0)
            if len(found):  # every example has terms, so no run is empty
                self._query[ids] = weights
                sizes = self.places[found + 1] - self.places[found]
                entries = _runs(self.places[found], sizes)
                exact = np.add.reduceat(self._query[self.terms[entries]] * self.weights[entries], np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.float64)
                self._query[ids] = 0.0
            best = np.lexsort((self.digests[found], -np.round(exact, 6)))[:k]
            out.append((found[best], exact[best]))
        return out

    def _open(self, chosen: np.ndarray, wide: np.ndarray, scores: np.ndarray, cosines: np.ndarray) -> None:
        """Whole cosines of the chosen (query, block)."""
        for b in np.flatnonzero(chosen.any(0)):
            rows, at = np.flatnonzero(chosen[:, b]), slice(self._starts[b], self._starts[b] + BLOCK)
            cosines[rows, at] = scores[rows, at] + wide[rows] @ self._dense[b]

    @staticmethod
    def _marks(cosines: np.ndarray, k: int) -> np.ndarray:
        """The k-th cosine of each query so far, or 0."""
        return np.maximum(0.0, np.partition(cosines, -k, axis=1)[:, -k]) if cosines.shape[1] > k else np.zeros(len(cosines))

    def search(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.search_all([(ids, weights)], k, [without])[0]


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    index: BlockIndex
    prior: float
    without_terms: float
    curve: tuple[np.ndarray, np.ndarray]

    def raw(self, places: np.ndarray, cosines: np.ndarray) -> float:
        near = 1 / (NEAR + np.maximum(0, 1 - cosines))
        return (float((near * self.index.toxic[places]).sum()) + PRIOR * self.prior) / (float(near.sum()) + PRIOR)

    def judge_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], digests: list[int]) -> list[tuple[float, list[int], list[float]]]:
        """Score, evidence and its cosines of each text."""
        full = [(v, d) for v, d in zip(vectors, digests) if len(v[0])] if len(self.index.ids) else []
        found = iter(self.index.search_all([v for v, _ in full], NEIGHBOURS, [d for _, d in full]))
        out = []
        for ids, _ in vectors:
            if not len(ids):
                out.append((self.without_terms, [], []))
                continue
            places, cosines = next(found)
            raw = self.raw(places, cosines)
            level = float(np.interp(raw, *self.curve))
            out.append((min(1.0, max(0.0, 0.98 * level + 0.02 * raw)), self.index.ids[places[:EVIDENCE]].tolist(),
                        [round(float(c), 6) for c in cosines[:EVIDENCE]]))
        return out


def digest_of(text: str | None) -> int:
    """The leading 63 bits of a text's SHA-256."""
    return int.from_bytes(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest()[:8], "big") >> 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples as distinct words and their counts."""
    for batch in batches:
        counts = [Counter(WORD.findall(t.lower())) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([digest_of(t) for t in batch.column(2).to_pylist()], pa.int64()),
             pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
            ["doc_id", "mark", "digest", "words", "counts"])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to the points (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for a, b in zip(x[order], y[order]):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            mean, weight, _, last = pools.pop()
            into = pools[-1]
            into[0] = (into[0] * into[1] + mean * weight) / (into[1] + weight)
            into[1] += weight
            into[3] = last
    xs = [v for p in pools for v in (p[2], p[3])]
    return np.array(xs), np.array([v for p in pools for v in (p[0], p[0])])


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Learn from the labelled rows of the learning folds."""
    marks = labels.where("toxic is not null and doc_id is not null").where(fold_of("doc_id", 3) != 1)
    marks = scratch.put(marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("mark")), "marks")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = known.join(scratch.small(marks), marks["doc_id"] == known["doc_id"]).select(known["doc_id"], "mark", "text")
    known = scratch.put(known.withColumn("digest", F.sha2("text", 256)), "labelled")
    # copies of a text count once
    texts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("mark").alias("mark"))
    copies = texts.join(known.select("digest", F.col("doc_id").alias("_id"), "text").dropDuplicates(["digest", "_id"]), "digest")
    known = scratch.put(copies.where("doc_id = _id").select("doc_id", "mark", "text", "digest"), "known")
    lettered = F.col("text").rlike(r"\p{L}")
    totals = known.agg(F.sum("mark"), F.count(F.lit(1)), F.count_if(lettered)).first()
    positive, count = int(totals[0] or 0), int(totals[1])
    prior = positive / count if count else 0.0
    # the least digests lie below this share of their range, so only about twice as many texts as are taken meet in one task
    share = min(1.0, 2 * EXAMPLES / max(1, int(totals[2])))
    low = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") < share * (1 << 32)
    sample = scratch.put(known.where(lettered & low).orderBy("digest").limit(EXAMPLES).select("doc_id", "mark", "text"), "sample")
    taken = sample.mapInArrow(_word_counts, "doc_id long, mark int, digest long, words array<string>, counts array<long>").toArrow().to_pylist()
    terms = {t: i for i, t in enumerate(sorted({t for r in taken for w in r["words"] for t in terms_of(w)}))}
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(terms))
    counts = known.select("text", "mark").mapInArrow(_count_rows(shared), "term string, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    shared.unpersist()
    toxic, seen, empty = np.zeros(len(terms)), np.zeros(len(terms)), (0, 0)
    for term, t, c in zip(*(counts.column(n).to_pylist() for n in ("term", "toxic", "clean"))):
        if term:
            toxic[terms[term]], seen[terms[term]] = t, t + c
        else:
            empty = (t, t + c)
    z = (toxic - seen * prior) / np.sqrt(np.maximum(seen * prior * (1 - prior), 1e-12))
    # where all labels are alike no term tells them apart, and plain idf is left
    idf = (np.log((count + 1) / (seen + 1)) + 1) * (np.abs(z) if 0 < positive < count else 1.0)
    vector = Vectors(terms, idf)
    rows = [(r["doc_id"], r["mark"], r["digest"], *vector.of_counts(dict(zip(r["words"], r["counts"])))) for r in taken]
    index = BlockIndex.build([r for r in rows if len(r[3])], len(terms))
    without = (empty[0] + prior) / (empty[1] + 1)
    model = Model(terms, idf, index, prior, without, (np.array([0.0, 1.0]), np.array([prior, prior])))
    if len(index.ids):
        entries = [(index.terms[a:b], index.weights[a:b].astype(np.float64)) for a, b in zip(index.places, index.places[1:])]
        judged = [model.raw(*f) for f in index.search_all(entries, NEIGHBOURS, index.digests.tolist())]
        model.curve = isotonic(np.array(judged), index.toxic)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (ids of the nearest examples), nearness (their cosines) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vector = Vectors(model.terms, model.idf)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [f for at in range(0, len(texts), BATCH)
                     for f in model.judge_all([vector(t) for t in texts[at:at + BATCH]], [digest_of(t) for t in texts[at:at + BATCH]])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64())),
                 pa.array([f[2] for f in found], pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "nearness"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        work, f"doc_id {kind}, score double, evidence array<long>, nearness array<double>")
