"""Session settings and lineage cuts that survive executor loss."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PACKAGE = "lodeseek"


def build_session(app: str = "lodeseek", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator here expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application."""
    context = spark.sparkContext
    if not any(str(path).endswith(f"{PACKAGE}.zip") for path in context._python_includes):
        source = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix=f"{PACKAGE}-"), PACKAGE)
        context.addPyFile(shutil.make_archive(target, "zip", source, PACKAGE))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only on a local master."""
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodeseek-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table ends the lineage, survives executor loss, keeps column
    pruning and gives the optimizer true sizes for its join choices.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "stages", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*frames: DataFrame) -> None:
    """Remove the written tables of staged frames that nothing reads any more."""
    for df in frames:
        delete_path(df.sparkSession, df.staged_at)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_files(spark: SparkSession):
    """While the block runs, tables are written with the stronger compression."""
    key = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(key)
    spark.conf.set(key, "zstd")
    try:
        yield
    finally:
        spark.conf.set(key, before)


SPREAD_BYTES_PER_CORE = 16 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; reads file sizes, runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Put a small input on every core before a CPU-heavy step.

    Inputs over ``SPREAD_BYTES_PER_CORE`` per core already have splits enough and
    are left alone, so a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * SPREAD_BYTES_PER_CORE else df


def _filesystem(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def drop_stages(spark: SparkSession) -> None:
    """Remove the stage tables this application wrote."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        delete_path(spark, os.path.join(current, "stages"))
