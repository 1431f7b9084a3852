"""Okapi BM25 over a batch of queries, from a stored keyword index.

Whitespace tokens, case kept. A term's weight is
``ln(N - n + 0.5) - ln(n + 0.5)``; a negative weight is replaced by
``floor x mean weight of the whole vocabulary``. Documents without any query
term are not candidates.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.functions.text import words
from lodeseek.operators.ordered import top_k
from lodeseek.operators.scan_topk import TIE_DECIMALS, first_k, id_array, result_schema
from lodeseek.runtime import stage
from lodeseek.sources.keyword_index import KeywordIndex

#: Weights of one block of queries; (query, document) pairs a task holds at once.
BLOCK_WEIGHTS = 200_000
CHUNK_PAIRS = 1 << 22


def query_weights(index: KeywordIndex, queries: DataFrame, cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, term, weight): idf times the uses of each known query term."""
    uses = queries.select("query_id", F.explode(words("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("uses"))
    uses = stage(uses, "query-terms")
    return uses.join(index.weights(uses.select("term"), cfg.bm25_floor), "term").select("query_id", "term", (F.col("idf") * F.col("uses")).alias("weight"))


class _Scorer:
    """Sums of gain times weight per (query, document), best ``k`` per query kept as documents go by."""

    def __init__(self, starts: np.ndarray, queries: np.ndarray, weights: np.ndarray, asked: pa.Array, k: int, doc_id: str):
        self.starts, self.queries, self.weights, self.asked, self.k, self.doc_id = starts, queries, weights, asked, k, doc_id

    def score(self, ids: pa.Array, terms: np.ndarray, gains: np.ndarray):
        """Scores of whole documents, given as rows in order of (document, term)."""
        codes = ids.dictionary_encode()
        doc, seen = codes.indices.to_numpy(), id_array(codes.dictionary)
        sizes = self.starts[terms + 1] - self.starts[terms]
        out, n = None, len(self.asked)
        ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
        pairs = np.cumsum(sizes)
        at = 0
        while at < len(doc):  # whole documents up to a chunk, one at least
            enough = np.searchsorted(pairs[ends], (pairs[at - 1] if at else 0) + CHUNK_PAIRS)
            stop = ends[min(max(enough, np.searchsorted(ends, at)), len(ends) - 1)] + 1
            part = slice(at, stop)
            row = np.repeat(np.arange(at, stop), sizes[part])
            within = np.arange(len(row)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
            place = self.starts[terms[row]] + within
            keys, at_key = np.unique(doc[row].astype(np.int64) * n + self.queries[place], return_inverse=True)
            sums = np.bincount(at_key, gains[row] * self.weights[place], len(keys))
            found = first_k(keys % n, seen[keys // n], sums, self.k)
            out = found if out is None else first_k(*(np.concatenate(p) for p in zip(out, found)), self.k)
            at = stop
        return out

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = None, None

        def take(table: pa.Table):
            nonlocal kept
            if table.num_rows:
                found = self.score(table.column(0).combine_chunks(), table.column(1).to_numpy(), table.column(2).to_numpy())
                kept = found if kept is None else first_k(*(np.concatenate(p) for p in zip(kept, found)), self.k)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = table.column(0)[-1]
            ids = table.column(0)
            cut = table.num_rows - 1
            while cut and ids[cut - 1] == last:  # rows of the last document wait for the next batch
                cut -= 1
            take(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            take(held)
        if kept is not None:
            q, ids, scores = kept
            yield pa.RecordBatch.from_arrays([self.asked.take(pa.array(q)), pa.array(ids), pa.array(scores)], ["query_id", self.doc_id, "score"])


def _best_of_block(index: KeywordIndex, weights: DataFrame, schema, k: int, doc_id: str, cfg: Tunables) -> DataFrame:
    """Best ``k`` per query and task, for a block of queries whose weights are few enough to travel."""
    spark = weights.sparkSession
    table = weights.orderBy("term", "query_id").toArrow()
    terms = table.column("term").combine_chunks().dictionary_encode()
    asked = table.column("query_id").combine_chunks().dictionary_encode()
    number = terms.indices.to_numpy()
    starts = np.searchsorted(number, np.arange(len(terms.dictionary) + 1))
    scorer = _Scorer(starts, asked.indices.to_numpy().astype(np.int64), table.column("weight").to_numpy(), asked.dictionary, k, doc_id)
    names = spark.createDataFrame(list(enumerate(terms.dictionary.to_pylist())), "t int, term string")
    average = index.totals()["avg_len"]
    gain = F.col("tf") * (cfg.bm25_k1 + 1) / (F.col("tf") + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * F.col("length") / average))
    hits = index.postings(names).select(F.col("doc_id").alias(doc_id), "t", gain.alias("gain"))
    return hits.repartition(doc_id).sortWithinPartitions(doc_id, "t").mapInArrow(scorer, schema)


def bm25_topk(docs: DataFrame | None, queries: DataFrame, k: int | None = None, index: KeywordIndex | None = None, *,
              doc_id: str = "doc_id", text: str = "text", cfg: Tunables = DEFAULTS) -> DataFrame:
    """(query_id, doc_id, score, rank): best ``k`` per query, 1-based, ties by id.

    Reads the postings of the query terms' buckets from ``index``; without one, ``docs`` are indexed first. The hits meet by
    document, each task sums whole documents in the order of terms and hands on only its best ``k`` per query. Queries are
    taken in blocks of ``BLOCK_WEIGHTS`` weights, each the same plan.
    """
    k = k or cfg.bm25_k
    index = KeywordIndex.of(docs, doc_id, text) if index is None else index
    weights = stage(query_weights(index, queries, cfg), "weights")
    rows = weights.count()
    kind = index.store.tables["documents"].schema["doc_id"].dataType
    schema = result_schema(queries.sparkSession.createDataFrame([], f"{doc_id} {kind.simpleString()}"), doc_id, weights)
    if not rows:
        found = queries.sparkSession.createDataFrame([], schema)
    else:
        blocks = -(-rows // BLOCK_WEIGHTS)
        parts = [weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else weights for b in range(blocks)]
        found = reduce(DataFrame.unionByName, [_best_of_block(index, part, schema, k, doc_id, cfg) for part in parts if blocks == 1 or not part.isEmpty()])
    return top_k(found, ["query_id"], [F.round("score", TIE_DECIMALS).desc(), F.col(doc_id)], k)
