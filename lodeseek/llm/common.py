"""Helpers the training-data operators share."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeseek.runtime import delete_path, shared_dir

#: White space of the contracts.
SPACE = r"[\x20\x09-\x0D]+"
#: A side is only hinted for broadcast when its written size is at most this.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the cluster's shared folder, and removed once nothing reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, os.path.join(shared_dir(spark), "llm", f"{label}-{uuid.uuid4().hex}")
        self.tables = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        path = os.path.join(self.root, f"{name}-{self.tables}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete_path(self.spark, table._scratch_path)

    def size(self, table: DataFrame) -> int:
        """Bytes on disk of a written table."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        return path.getFileSystem(conf).getContentSummary(path).getLength()

    def small(self, table: DataFrame) -> DataFrame:
        """``table``, hinted for broadcast if its written size is within the bound; Spark shuffles it beyond."""
        return F.broadcast(table) if self.size(table) <= BROADCAST_BYTES else table


@contextmanager
def setting(spark: SparkSession, **conf):
    """Session settings for the writes made inside."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_of(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(name: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % mod
