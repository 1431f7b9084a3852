"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeseek.llm.common import Scratch


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour of a node on the least node around it: the larger ones, or the smaller ones with the node itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that itself hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a long, b long) -> (node, component), the component being its least node; nodes without links are absent.

    Large and small stars alternate until only stars are left; their number grows with the logarithm of the size.
    """
    edges = scratch.put(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        new = scratch.put(_step(_step(edges, True), False), "stars")
        scratch.drop(edges)
        edges = new
    return scratch.put(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()), "components")
