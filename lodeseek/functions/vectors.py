"""Vector expressions and the offline text embedder."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from lodeseek.functions.text import col_of

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def dot(a, b) -> Column:
    product = F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def graph_score(cos) -> Column:
    """Cosine moved onto [0, 1]."""
    return (F.lit(1.0) + col_of(cos)) / 2


@lru_cache(maxsize=200_000)
def _slot(token: str, dims: int) -> tuple[int, float]:
    digest = hashlib.md5(token.encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % dims, 1.0 if digest[8] < "8" else -1.0


def hashing_embedder(dims: int = 64) -> Embedder:
    """Signed feature hashing of white-space tokens, unit length.

    Deterministic and offline; any callable of the same shape replaces it.
    """

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            slots = [_slot(t, dims) for t in (text or "").split()]
            if slots:
                index, sign = zip(*slots)
                np.add.at(out[row], list(index), list(sign))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return embed


def embed_text(text, embedder: Embedder | None = None, batch: int = 128) -> Column:
    """Embedding column: Arrow batches in, calls of at most ``batch`` texts each."""
    call = embedder or hashing_embedder()

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        vectors: list = []
        for start in range(0, len(values), batch):
            part = call(values.iloc[start:start + batch].fillna("").tolist())
            vectors.extend(np.asarray(part, dtype="float64"))
        return pd.Series(vectors, index=values.index, dtype=object)

    return run(col_of(text))


def retrying(embedder: Embedder, retries: int = 6, base_delay: float = 1.0, jitter=None, sleep=None) -> Embedder:
    """Exponential backoff around a remote embedder; client errors are not retried.

    An exception with ``status_code`` in {400, 401, 403, 404} fails at once.
    """
    import random
    import time

    pause = sleep or time.sleep
    noise = jitter or (lambda: random.uniform(0, 0.5))

    def call(texts):
        for attempt in range(1, retries + 1):
            try:
                return embedder(texts)
            except Exception as error:  # noqa: BLE001 - remote failures come in any type
                if getattr(error, "status_code", None) in (400, 401, 403, 404) or attempt == retries:
                    raise
                pause(base_delay * 2 ** (attempt - 1) + noise())

    return call
