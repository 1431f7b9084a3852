"""Incremental indexing: content-hash diff, stale chunks, merge, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeseek.functions.text import blank_to_null, first_segment


def diff_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status, sha256, old_sha256): new, changed, unchanged or removed."""
    now = current.select("path", "sha256")
    before = manifest.select("path", F.col("sha256").alias("old_sha256"))
    status = (
        F.when(F.col("old_sha256").isNull(), F.lit("new"))
        .when(F.col("sha256").isNull(), F.lit("removed"))
        .when(F.col("sha256") == F.col("old_sha256"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return now.join(before, "path", "full_outer").select("path", status.alias("status"), "sha256", "old_sha256")


def removed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(current.select("path"), "path", "left_anti")


def stale_chunk_ids(manifest: DataFrame, diff: DataFrame) -> DataFrame:
    """Chunk ids recorded for changed and removed files."""
    touched = diff.where(F.col("status").isin("changed", "removed")).select("path")
    return manifest.join(touched, "path", "left_semi").select(F.explode("chunk_ids").alias("chunk_id"))


def without_ids(table: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Delete by id list; an empty list changes nothing."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def upsert(table: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``incoming`` replace rows of ``table`` with the same key."""
    return without_ids(table, incoming, key).unionByName(incoming.select(*table.columns))


def next_manifest(current: DataFrame, manifest: DataFrame, chunks: DataFrame, diff: DataFrame, indexed_at: str) -> DataFrame:
    """Manifest after a run: untouched files keep their row, the rest get a new one.

    Chunk ids of one file are gathered per file; a file is size-bounded by the
    corpus filter, so each list is small.
    """
    kept = manifest.join(diff.where(F.col("status") == "unchanged").select("path"), "path", "left_semi")
    touched = diff.where(F.col("status").isin("new", "changed")).select("path")
    ids = chunks.groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids")
    )
    fresh = (
        current.join(touched, "path", "left_semi").join(ids, "path", "left")
        .select("path", "sha256", "lang", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
                F.lit(indexed_at).alias("indexed_at"))
    )
    return kept.select(*fresh.columns).unionByName(fresh)


def count_by(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Row counts per value; null counts as ``?``."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("?")).alias(column)).agg(F.count(F.lit(1)).alias(out))


def chunks_by_dir(chunks: DataFrame, path: str = "path") -> DataFrame:
    """(dir, n) by top-level path part, largest first."""
    return chunks.groupBy(first_segment(path).alias("dir")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir")


def file_counts(diff: DataFrame) -> DataFrame:
    """One row: files scanned, indexed, unchanged and removed."""
    status = F.col("status")
    return diff.agg(
        F.count_if(status != "removed").alias("files_scanned"),
        F.count_if(status.isin("new", "changed")).alias("files_indexed"),
        F.count_if(status == "unchanged").alias("files_unchanged"),
        F.count_if(status == "removed").alias("files_removed"),
    )


def counts_map(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """One row with a map of a short count table (languages, top-level folders)."""
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("counts"))


def normalized_hint(hint: str = "llm"):
    """The UI's ``auto`` choice means no hint."""
    return F.nullif(blank_to_null(hint), F.lit("auto"))
