"""Incremental code index: scan, diff, chunk, embed, upsert, report."""

from __future__ import annotations

import os
import time
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeseek.config import DEFAULTS, EXCLUDED_GLOBS, Tunables
from lodeseek.functions.vectors import Embedder, embed_text, hashing_embedder
from lodeseek.operators.bounded import bounded
from lodeseek.operators.chunking import code_chunks, embed_input, metadata
from lodeseek.operators.filters import first_files
from lodeseek.operators.manifest import (
    chunks_by_dir, count_by, counts_map, diff_files, file_counts, next_manifest, stale_chunk_ids,
)
from lodeseek.operators.vector import vector_topk
from lodeseek.runtime import ship_package, spread, stage
from lodeseek.sources.files import code_files, write_chunk_list, write_json_report
from lodeseek.sources.tables import code_store


def _report(parts: dict[str, Column], spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*(value.alias(name) for name, value in parts.items()))


def run_index(spark: SparkSession, base: str, store: str, indexed_at: str, *, full: bool = False,
              limit: int | None = None, embedder: Embedder | None = None,
              globs: Sequence[str] = EXCLUDED_GLOBS, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Bring the tables of ``store`` up to date with ``base``; returns the one-row report.

    Chunks and manifest change in one version: until the run ends, and if it fails, readers see the old one, ``full`` included.
    ``limit`` restricts what is (re)indexed, never what counts as removed.
    """
    ship_package(spark)
    started = time.perf_counter()
    tables = code_store(spark, store)
    with tables.change() as change:
        if full:
            change.clear("code_chunks")
            change.clear("file_manifest")
        listed, chunks, diff = _index_files(spark, change, base, indexed_at, limit, embedder, globs, cfg)
    stored = tables.read("code_chunks").select("chunk_id", "path", "lang", "symbol", "signature", "start_line", "end_line", "indexed_at")
    write_chunk_list(stored, os.path.join(store, "chunks-manifest"))
    counts = file_counts(diff)
    report = _report({
        "generated_at": F.lit(indexed_at), "base_dir": F.lit(base),
        "chunk_size": F.lit(cfg.code_chunk_size), "chunk_overlap": F.lit(cfg.code_chunk_overlap),
        **{c: counts.select(c).scalar() for c in counts.columns},
        "files_by_lang": counts_map(count_by(listed, "lang"), "lang").scalar(),
        "chunks_indexed_this_run": chunks.agg(F.count(F.lit(1))).scalar(),
        "total_chunks": stored.agg(F.count(F.lit(1))).scalar(),
        "chunks_by_lang": counts_map(count_by(stored, "lang"), "lang").scalar(),
        "chunks_by_dir": counts_map(chunks_by_dir(stored), "dir").scalar(),
        "elapsed_seconds": F.lit(round(time.perf_counter() - started, 2)),
    }, spark)
    report = stage(report, "report")
    write_json_report(report, os.path.join(store, "index-report"))
    return report


def _index_files(spark, change, base, indexed_at, limit, embedder, globs, cfg) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bring the change's tables up to date; returns the files listed, the chunks made and the diff."""
    scanned = code_files(spark, base, globs, cfg)
    listed = stage(scanned.drop("content"), "files")
    manifest = stage(change.rows("file_manifest"), "manifest")
    diff = diff_files(listed, manifest)
    if limit:
        inside = first_files(listed, limit, "path").select("path", F.lit(True).alias("_in"))
        diff = diff.join(inside, "path", "left").where(
            F.col("_in").isNotNull() | F.col("status").isin("unchanged", "removed")).drop("_in")
    diff = stage(diff, "diff")
    change.delete("code_chunks", stale_chunk_ids(manifest, diff))
    todo = bounded(diff.where(F.col("status").isin("new", "changed")).select("path"), label="todo")
    chunks = stage(embed_input(code_chunks(scanned.join(todo, "path", "left_semi"), cfg)), "chunks")
    vectors = spread(chunks).withColumn("embedding", embed_text("embed_text", embedder, cfg.embed_batch))
    change.upsert("code_chunks", metadata(vectors, indexed_at, F.col("text").alias("document"), "embedding"))
    # rows of untouched files, and of those past ``limit``, stay as they are
    change.upsert("file_manifest", next_manifest(listed, manifest, chunks, diff, indexed_at).join(todo, "path", "left_semi"))
    change.delete("file_manifest", diff.where("status = 'removed'").select("path"))
    return listed, chunks, diff


def run_dry(spark: SparkSession, base: str, store: str, indexed_at: str, limit: int | None = None,
            cfg: Tunables = DEFAULTS) -> DataFrame:
    """Scan and chunk only. Its chunk list has its own folder, so the real one stays."""
    ship_package(spark)
    scanned = code_files(spark, base, cfg=cfg)
    listed = stage(first_files(scanned.drop("content"), limit, "path"), "files")
    chunks = stage(embed_input(code_chunks(scanned.join(listed.select("path"), "path", "left_semi"), cfg)), "chunks")
    write_chunk_list(metadata(chunks, indexed_at), os.path.join(store, "dryrun-chunks-manifest"))
    report = stage(_report({
        "mode": F.lit("dry-run"), "embedded": F.lit(False), "generated_at": F.lit(indexed_at),
        "files_scanned": listed.agg(F.count(F.lit(1))).scalar(),
        "files_by_lang": counts_map(count_by(listed, "lang"), "lang").scalar(),
        "prospective_chunks": chunks.agg(F.count(F.lit(1))).scalar(),
        "chunks_by_lang": counts_map(count_by(chunks, "lang"), "lang").scalar(),
        "chunks_by_dir": counts_map(chunks_by_dir(chunks), "dir").scalar(),
    }, spark), "report")
    write_json_report(report, os.path.join(store, "dryrun-report"))
    return report


def sample_search(spark: SparkSession, store: str, queries: DataFrame, k: int = 5,
                  embedder: Embedder | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, lang, symbol, score): nearest stored chunks per query text."""
    ship_package(spark)
    asked = stage(queries.withColumn("embedding", embed_text("query", embedder or hashing_embedder())), "asked")
    table = code_store(spark, store).read("code_chunks")
    near = bounded(vector_topk(table, asked, k, vec_id="chunk_id"), label="near")
    return table.select("chunk_id", "lang", "symbol").join(near, "chunk_id").select(
        "query_id", "rank", "chunk_id", "lang", "symbol", "score")
