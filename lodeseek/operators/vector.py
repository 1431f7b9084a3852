"""Exact nearest vectors and diversity re-selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.operators.bounded import bounded, local_rows
from lodeseek.operators.ordered import top_k
from lodeseek.operators.scan_topk import TIE_DECIMALS, best_of, id_array, result_schema, scan_topk
from lodeseek.runtime import stage


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    query_embedding: str = "embedding",
    cfg: Tunables = DEFAULTS,
) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` most cosine-similar vectors per query.

    Exact. Up to ``query_block_rows`` queries travel with the tasks as one matrix:
    every task multiplies its vectors by it and hands on only its own best ``k``
    per query, so the shuffle carries k x queries x tasks rows. More queries are
    matched block against block (see :func:`_blocked`).
    """
    vectors = vectors.where(F.col(embedding).isNotNull()).select(vec_id, embedding)
    queries = queries.select("query_id", F.col(query_embedding).alias("_q"))
    schema = result_schema(vectors, vec_id, queries)
    rows = local_rows(queries, cfg.query_block_rows)
    if rows is None:
        return _blocked(vectors, queries, k, vec_id, embedding, schema, cfg)
    if not rows:
        empty = vectors.sparkSession.createDataFrame([], schema)
        return top_k(empty, ["query_id"], [F.col(vec_id)], k)
    unit_queries = _unit(np.array([r["_q"] for r in rows], dtype="float64"))

    def similarity(column) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
        return unit_queries @ _unit(flat.reshape(len(column), -1)).T

    return scan_topk(vectors, schema, [r["query_id"] for r in rows], similarity, k)


def _blocked(vectors, queries, k, vec_id, embedding, schema, cfg) -> DataFrame:
    """Many queries: each (query block, vector block) pair is one bounded group."""
    vectors, queries = stage(vectors, "vectors"), stage(queries, "queries")
    v_blocks = max(1, -(-vectors.count() // cfg.vector_block_rows))
    q_blocks = max(1, -(-queries.count() // cfg.query_block_rows))

    def spread(df, key, own, own_n, other, other_n):
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [f.name for f in schema]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        matrix, asked = (_unit(np.array(c.tolist(), dtype="float64")) for c in (left[embedding], right["_q"]))
        q, ids, scores = best_of(asked @ matrix.T, id_array(left[vec_id]), k)
        return pd.DataFrame(dict(zip(names, (right["query_id"].to_numpy()[q], ids, scores))))

    left = spread(vectors, vec_id, "_v", v_blocks, "_b", q_blocks).groupBy("_v", "_b")
    right = spread(queries, "query_id", "_b", q_blocks, "_v", v_blocks).groupBy("_v", "_b")
    found = left.cogroup(right).applyInPandas(match, schema)
    return top_k(found, ["query_id"], [F.round("score", TIE_DECIMALS).desc(), F.col(vec_id)], k)


def mmr_select(
    pool: DataFrame,
    k: int | None = None,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cfg: Tunables = DEFAULTS,
) -> DataFrame:
    """(query_id, vec_id, rank): relevance-diversity picks from each query's ranked pool.

    ``pool`` has query_id, vec_id, score, rank and the candidate's vector, at most
    ``fetch_k`` rows per query, so one group is one small Python call. Each pick
    maximises ``lambda x score - (1 - lambda) x closest picked``; ties keep pool order.
    """
    picks = k or cfg.vector_k
    weight = cfg.mmr_lambda
    schema = T.StructType([pool.schema["query_id"], pool.schema[vec_id], T.StructField("rank", T.IntegerType())])

    def select(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", kind="stable")
        unit = _unit(np.array(group[embedding].tolist(), dtype="float64"))
        relevance = group["score"].to_numpy()
        between = unit @ unit.T
        chosen: list[int] = []
        left = list(range(len(group)))
        while left and len(chosen) < picks:
            worth = [
                weight * relevance[i] - (1 - weight) * between[i, chosen].max() if chosen else relevance[i]
                for i in left
            ]
            best = left[int(np.argmax(np.round(worth, TIE_DECIMALS)))]
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({
            "query_id": group["query_id"].iloc[chosen].to_numpy(),
            vec_id: group[vec_id].iloc[chosen].to_numpy(),
            "rank": np.arange(1, len(chosen) + 1, dtype="int32"),
        })

    columns = pool.select("query_id", vec_id, "score", "rank", embedding)
    return columns.groupBy("query_id").applyInPandas(select, schema)


def mmr_topk(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id",
             embedding: str = "embedding", query_embedding: str = "embedding",
             cfg: Tunables = DEFAULTS) -> DataFrame:
    """Vector retrieval with diversity: ``fetch_k`` nearest, then ``vector_k`` picks."""
    near = vector_topk(vectors, queries, cfg.fetch_k, vec_id=vec_id, embedding=embedding,
                       query_embedding=query_embedding, cfg=cfg)
    pool = vectors.select(vec_id, embedding).join(bounded(near, label="pool"), vec_id)
    return mmr_select(pool, cfg.vector_k, vec_id=vec_id, embedding=embedding, cfg=cfg)
