"""The code index's tables as a versioned store."""

from __future__ import annotations

from pyspark.sql import SparkSession, types as T

from lodeseek.sources.store import Spec, Store


CHUNK_TABLE = T.StructType([
    *(T.StructField(n, T.StringType(), False) for n in ("chunk_id", "path", "lang", "symbol", "signature")),
    T.StructField("start_line", T.IntegerType(), False), T.StructField("end_line", T.IntegerType(), False),
    T.StructField("indexed_at", T.StringType(), False), T.StructField("document", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.DoubleType()), False),
])
MANIFEST_TABLE = T.StructType([
    *(T.StructField(n, T.StringType(), False) for n in ("path", "sha256", "lang")),
    T.StructField("chunk_ids", T.ArrayType(T.StringType()), False),
    T.StructField("indexed_at", T.StringType(), False),
])


def code_store(spark: SparkSession, store: str) -> Store:
    """Chunks and file manifest; a run changes both in one version."""
    return Store(spark, store, {"code_chunks": Spec(CHUNK_TABLE, ("chunk_id",)), "file_manifest": Spec(MANIFEST_TABLE, ("path",))})
