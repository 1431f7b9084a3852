"""Per-task top-k: a scan scores its own rows and hands on only its best per query."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lodeseek.operators.ordered import top_k

# Scores equal to this many decimals are ties, settled by id.
TIE_DECIMALS = 9


def id_array(column) -> np.ndarray:
    """Ids as a sortable numpy array."""
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else np.asarray(column)
    return values.astype(str) if values.dtype == object else values


def best_of(scores: np.ndarray, ids: np.ndarray, k: int):
    """(query index, id, score) arrays of the best ``k`` columns per row; -inf is no candidate."""
    shown = np.round(scores, TIE_DECIMALS)
    if shown.shape[1] > k:
        edge = np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k]
        mask = (shown >= edge[:, None]) & np.isfinite(shown)
    else:
        mask = np.isfinite(shown)
    q, at = np.nonzero(mask)
    return first_k(q, ids[at], scores[q, at], k)


def first_k(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Keep the ``k`` best rows per query, ties by id."""
    order = np.lexsort((ids, -np.round(scores, TIE_DECIMALS), q))
    q, ids, scores = q[order], ids[order], scores[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    keep = place < k
    return q[keep], ids[keep], scores[keep]


def result_schema(rows: DataFrame, row_id: str, queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField(row_id, rows.schema[row_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def scan_topk(rows: DataFrame, schema: T.StructType, query_ids: list, score_block: Callable, k: int) -> DataFrame:
    """(query_id, id, score, rank): best ``k`` rows of (id, payload) per query.

    ``score_block(payload column) -> (queries x rows)`` runs inside the tasks. Each task
    keeps k x queries rows, so that is all it shuffles, however large the table is.
    """
    row_id = schema[1].name
    asked = pa.array(query_ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows:
                found = best_of(score_block(batch.column(1)), id_array(batch.column(0)), k)
                kept = found if kept is None else first_k(*(np.concatenate(p) for p in zip(kept, found)), k)
        if kept is not None:
            q, ids, scores = kept
            yield pa.RecordBatch.from_arrays(
                [asked.take(pa.array(q)), pa.array(ids), pa.array(scores)], names=["query_id", row_id, "score"])

    found = rows.mapInArrow(scan, schema)
    return top_k(found, ["query_id"], [F.round("score", TIE_DECIMALS).desc(), F.col(row_id)], k)
