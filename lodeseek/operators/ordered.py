"""Ranks and running totals that hold when one key owns most of the rows."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeseek.config import DEFAULTS
from lodeseek.functions.text import col_of
from lodeseek.runtime import stage


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with a 1-based rank.

    ``row_number() <= k`` lets Spark keep only ``k`` rows per key and task before
    the shuffle (WindowGroupLimit), so a hot key sends ``k`` x tasks rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group; partial counts before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value,
    out: str,
    *,
    group_rows: int | None = None,
    limit: int = DEFAULTS.window_group_rows,
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within ``keys``.

    Groups up to ``limit`` rows use one window. Beyond it the rows are range
    partitioned on (keys, order), each slice is summed on its own, and the totals
    of the earlier slices are added, so no task sees more than one slice. ``order``
    must be unique within a key. ``group_rows`` passes a known largest-group size.
    """
    rows = largest_group(df, keys) if group_rows is None else group_rows
    amount = col_of(value).cast("bigint")
    if rows <= limit:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(amount).over(window))

    slices = max(2, -(-df.count() // limit) * 2)
    sliced = stage(
        df.withColumn("_amount", amount)
        .repartitionByRange(slices, *keys, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    local = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice", *keys)
        .agg(F.sum("_amount").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        sliced.withColumn("_local", F.sum("_amount").over(local))
        .join(offsets, ["_slice", *keys])
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .drop("_slice", "_amount", "_local", "_offset")
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, **options) -> DataFrame:
    """1-based row number within ``keys``; see :func:`running_total`."""
    return running_total(df, keys, order, F.lit(1), out, **options)
