"""Language identification with a linear-chain conditional random field over the words of a text.

Features of a word: its prefixes and suffixes (affixes), its character n-grams with edge marks, and the languages whose
lexicon has it. Emissions depend on the word alone, transitions between languages are learned, and forward-backward
gives each word its language probabilities, so code-switched text is labelled word by word. A document's score per
language is the mean over its words; the highest is the prediction.

Training reads only texts and labels of the learning fold: a sample of ``segments`` passages per language (the documented
bound), strung together at random into code-switched sequences. Prediction reads every whole text in chunks of words:
blocks of the chain are summarised as small matrices, which keeps the exact result and vector-sized work.

Null text, or text without a letter: ``und`` with score 0. Ties go to the first language in code-point order. Repeated rows
get equal results. Without any labelled text all predictions are ``und``. Other columns are carried or ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.llm.common import Scratch, fold_of

#: A word is a run of letters; longer runs (text without spaces) are cut into words of 24 letters, so every letter is read.
WORD = re.compile(r"[^\W\d_]{1,24}")
#: Bound of the training sample: passages per language, and characters of each.
SEGMENTS, SEGMENT_CHARS = 1500, 400
SEQUENCE_WORDS, STRETCH_WORDS = 96, (3, 30)
#: A word or n-gram must be seen this often in the sample to be a feature.
MIN_SEEN = 5
STEPS, RATE, RIDGE = 70, 0.12, 1e-5
#: Words worked on at once, words of a block, and words whose emissions a task keeps.
CHUNK_WORDS, BLOCK, CACHE_WORDS = 80_000, 32, 200_000


def word_features(word: str) -> list[str]:
    """Affix and n-gram features."""
    marked = f"^{word}$"
    out = [f"w:{word}"]
    for n in (1, 2, 3, 4):
        if len(word) >= n:
            out += [f"p:{word[:n]}", f"s:{word[-n:]}"]
    for n in (1, 2, 3):
        out += [marked[i:i + n] for i in range(len(marked) - n + 1)]
    return out


@dataclass
class Model:
    labels: list[str]
    features: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word, one row per word."""
        picked, counts = [], np.zeros(len(words), np.int64)
        get = self.features.get
        for i, word in enumerate(words):
            found = [k for k in map(get, word_features(word)) if k is not None]
            picked += found
            counts[i] = len(found)
        return _sum_rows(self.weights, np.array(picked, np.int64), counts)


def _sum_rows(weights: np.ndarray, picked: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), weights.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.r_[0, np.cumsum(counts)[:-1]][full]
        out[full] = np.add.reduceat(weights[picked], starts, axis=0)
    return out


def _chains(potential: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed transition marginals of equally long chains; potential: (words, chains, labels)."""
    length, chains, labels = potential.shape
    forward, backward = np.empty_like(potential), np.empty_like(potential)
    state = np.ones((chains, labels))
    for t in range(length):
        state = (state @ step) * potential[t]
        state /= state.sum(1, keepdims=True)
        forward[t] = state
    state = np.ones((chains, labels))
    pairs = np.zeros((labels, labels))
    for t in range(length - 1, -1, -1):
        backward[t] = state
        after = potential[t] * state
        before = forward[t - 1] if t else np.ones((chains, labels))
        joint = before[:, :, None] * step[None] * after[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        state = after @ step.T
        state /= state.sum(1, keepdims=True)
    both = forward * backward
    return both / both.sum(2, keepdims=True), pairs


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Train on (language, passage) pairs."""
    by_label: dict[str, list[list[str]]] = {}
    for label, text in sorted(samples, key=lambda s: (s[0], zlib.crc32(s[1].encode()), s[1])):
        words = WORD.findall(text.lower())[1:-1]  # the ends may be cut
        if words:
            by_label.setdefault(label, []).append(words)
    labels = sorted(by_label)
    if not labels:
        return None
    random = np.random.default_rng(seed)
    words, tags = [], []
    pools = {k: [w for part in by_label[k] for w in part] for k in labels}
    total = max(SEQUENCE_WORDS * 8, int(np.mean([len(p) for p in pools.values()])) * len(labels))
    while len(words) < total:
        k = int(random.integers(len(labels)))
        n, pool = int(random.integers(*STRETCH_WORDS)), pools[labels[k]]
        at = int(random.integers(len(pool)))
        part = pool[at:at + n]
        words += part
        tags += [k] * len(part)
    chains = len(words) // SEQUENCE_WORDS
    words, tags = words[:chains * SEQUENCE_WORDS], np.array(tags[:chains * SEQUENCE_WORDS])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([vocabulary[w] for w in words])
    seen: dict[str, int] = {}
    for w in vocabulary:
        for f in set(word_features(w)):
            if not f.startswith("w:"):
                seen[f] = seen.get(f, 0) + 1
    often = np.bincount(ids)
    for w, i in vocabulary.items():  # the lexicon: words met often enough
        if often[i] >= MIN_SEEN:
            seen[f"w:{w}"] = MIN_SEEN
    features = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_SEEN))}
    model = Model(labels, features, np.zeros((len(features), len(labels))), np.zeros((len(labels),) * 2))
    picked, counts = [], []
    for w in vocabulary:
        found = [features[f] for f in word_features(w) if f in features]
        picked += found
        counts.append(len(found))
    picked, counts = np.array(picked, np.int64), np.array(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    gold = np.eye(len(labels))[tags]
    gold_pairs = np.zeros((len(labels),) * 2)
    shaped = tags.reshape(chains, SEQUENCE_WORDS)
    np.add.at(gold_pairs, (shaped[:, :-1].ravel(), shaped[:, 1:].ravel()), 1)
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(gold_pairs), np.zeros_like(gold_pairs)]
    for step in range(1, STEPS + 1):
        scores = _sum_rows(model.weights, picked, counts)[ids]
        potential = np.exp(scores - scores.max(1, keepdims=True)).reshape(chains, SEQUENCE_WORDS, -1).transpose(1, 0, 2)
        gamma, pairs = _chains(np.ascontiguousarray(potential), np.exp(model.transitions))
        off = gold - gamma.transpose(1, 0, 2).reshape(len(ids), -1)
        per_word = np.stack([np.bincount(ids, off[:, j], len(vocabulary)) for j in range(len(labels))], 1)
        slope = np.stack([np.bincount(picked, per_word[owner, j], len(features)) for j in range(len(labels))], 1) / len(ids)
        slope -= RIDGE * model.weights
        turn = (gold_pairs - pairs) / len(ids)
        for value, grad, (a, b) in ((model.weights, slope, moments[:2]), (model.transitions, turn, moments[2:])):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            value += RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


def _scaled(x: np.ndarray, axes) -> np.ndarray:
    return x / x.max(axes, keepdims=True)


def label_shares(model: Model, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean word marginals of documents whose words lie one after another in ``scores`` (log emissions); lengths > 0."""
    step, labels = np.exp(model.transitions), scores.shape[1]
    blocks = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
    first = np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], blocks) + nth * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, blocks) - nth * BLOCK)
    at = first[:, None] + np.minimum(np.arange(BLOCK)[None], size[:, None] - 1)
    live = np.arange(BLOCK)[None] < size[:, None]
    potential = np.exp(scores - scores.max(1, keepdims=True))
    # each block as one matrix
    through = np.repeat(np.eye(labels)[None], len(doc), 0)
    for t in range(BLOCK):
        new = _scaled((through.reshape(-1, labels) @ step).reshape(through.shape) * potential[at[:, t]][:, None, :], (1, 2))
        through = np.where(live[:, t, None, None], new, through)
    # states at the edges of the blocks, over all documents at once
    enter, leave = np.ones((len(doc), labels)), np.ones((len(doc), labels))
    begin = np.r_[0, np.cumsum(blocks)[:-1]]
    by_count = np.argsort(-blocks, kind="stable")
    for k in range(1, int(blocks.max())):
        here = begin[by_count[:np.searchsorted(-blocks[by_count], -k, side="left")]] + k
        state = np.einsum("bi,bij->bj", enter[here - 1], through[here - 1])
        enter[here] = _scaled(state, 1)
    for k in range(int(blocks.max()) - 2, -1, -1):
        here = begin[by_count[:np.searchsorted(-blocks[by_count], -(k + 1), side="left")]] + k
        state = np.einsum("bij,bj->bi", through[here + 1], leave[here + 1])
        leave[here] = _scaled(state, 1)
    ahead = np.empty((BLOCK, len(doc), labels))
    state = enter
    for t in range(BLOCK):
        new = _scaled((state @ step) * potential[at[:, t]], 1)
        state = np.where(live[:, t, None], new, state)
        ahead[t] = state
    sums, state = np.zeros((len(doc), labels)), leave
    for t in range(BLOCK - 1, -1, -1):
        both = ahead[t] * state
        sums += np.where(live[:, t, None], both / both.sum(1, keepdims=True), 0)
        new = _scaled((potential[at[:, t]] * state) @ step.T, 1)
        state = np.where(live[:, t, None], new, state)
    return np.add.reduceat(sums, begin, axis=0) / lengths[:, None]


class Labeller:
    """Predictions for lists of texts; keeps the emissions of a bounded number of words."""

    def __init__(self, model: Model | None):
        self.model, self.known, self.rows = model, {}, None

    def _shares(self, docs: list[list[str]]) -> np.ndarray:
        flat = [w for words in docs for w in words]
        new = list(set(flat).difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.rows, new = {}, None, list(set(flat))
        if new:
            added = self.model.emissions(new)
            at = len(self.known)
            self.known.update(zip(new, range(at, at + len(new))))
            self.rows = added if self.rows is None else np.concatenate([self.rows, added])
        ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        return label_shares(self.model, self.rows[ids], np.array([len(d) for d in docs]))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if self.model is None:
            return out
        waiting, count = [], 0

        def work():
            shares = self._shares([w for _, w in waiting])
            for (i, _), row, best in zip(waiting, shares, shares.argmax(1)):
                out[i] = (self.model.labels[best], float(min(1.0, row[best])))

        for i, text in enumerate(texts):
            words = WORD.findall(text.lower()) if text else []
            if not words or not any(c.isalpha() for c in text):
                continue
            waiting.append((i, words))
            count += len(words)
            if count >= CHUNK_WORDS:
                work()
                waiting, count = [], 0
        if waiting:
            work()
        return out


def sample(docs: DataFrame, segments: int = SEGMENTS, chars: int = SEGMENT_CHARS) -> list[tuple[str, str]]:
    """About ``segments`` passages per language of the learning fold, from random places of random texts."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", 4) != 2))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance, wide = F.lit(0.0), float(1 << 30)
    for lang, n in sorted(counts.items()):
        chance = F.when(F.col("lang") == lang, float(segments) / n).otherwise(chance)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / wide
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    taken = known.where(draw < chance).select("lang", F.substring(F.col("text"), place, F.lit(chars)).alias("part"))
    return [(r["lang"], r["part"]) for r in taken.collect()]


def train(docs: DataFrame) -> Model | None:
    return fit(sample(docs))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(shared.value)
        for batch in batches:
            found = label(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, scratch: Scratch, least: float = 0.3) -> DataFrame:
    """The rows with letters whose best language holds at least ``least`` of the words; all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    text_at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(shared.value)
        for batch in batches:
            found = label(batch.column(text_at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
