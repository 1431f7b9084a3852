"""Corpus predicates: every rule is a column, so scans prune and push down."""

from __future__ import annotations

from itertools import chain
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lodeseek.config import (
    DEFAULTS, EXCLUDED_ENDINGS, EXCLUDED_GLOBS, EXCLUDED_PARTS, EXTENSION_LANG, PROVIDER_HINTS, TECHNIQUES, Tunables,
)
from lodeseek.functions.text import blank_to_null, col_of, file_name, file_suffix, has_text, matches_glob


def language_of(path) -> Column:
    """Language label of a path by extension; null when unsupported."""
    labels = F.create_map(*(F.lit(v) for v in chain.from_iterable(EXTENSION_LANG.items())))
    return F.try_element_at(labels, file_suffix(path))


def in_excluded_dir(path) -> Column:
    return F.arrays_overlap(F.split(col_of(path), "/"), F.array(*(F.lit(p) for p in EXCLUDED_PARTS)))


def has_excluded_ending(path) -> Column:
    name = file_name(path)
    hit = F.lit(False)
    for ending in EXCLUDED_ENDINGS:
        hit = hit | name.endswith(ending)
    return hit


def keep_code_files(files: DataFrame, path: str = "rel_path", size: str = "size",
                    globs: Sequence[str] = EXCLUDED_GLOBS, cfg: Tunables = DEFAULTS) -> DataFrame:
    """Indexable code files with their language; name tests come before any content use."""
    return (
        files.where(F.col(size).between(1, cfg.max_file_bytes))
        .withColumn("lang", language_of(path))
        .where(F.col("lang").isNotNull())
        .where(~in_excluded_dir(path) & ~has_excluded_ending(path) & ~matches_glob(path, globs))
    )


def first_files(files: DataFrame, n: int | None, path: str = "rel_path") -> DataFrame:
    """The first ``n`` files in path-component order; None or 0 keeps all."""
    return files.orderBy(F.split(path, "/")).limit(n) if n else files


def select_chunks(chunks: DataFrame, only_ids: DataFrame | None = None, max_chunks: int | None = None) -> DataFrame:
    """Chunks by id first, then the first ``max_chunks`` in sequence."""
    if only_ids is not None:
        chunks = chunks.join(only_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return chunks.orderBy("seq").limit(max_chunks) if max_chunks else chunks


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(has_text(text))


def first_filled(*columns) -> Column:
    """First non-empty column."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def popular(views, minimum: int = DEFAULTS.video_min_views) -> Column:
    """Views at or above the minimum; missing counts as zero."""
    return F.coalesce(col_of(views).cast("bigint"), F.lit(0)) >= minimum


def recent(published, as_of, months: int = DEFAULTS.video_months) -> Column:
    """Published within ``months`` x 30 days of ``as_of``."""
    return col_of(published) >= col_of(as_of) - F.expr(f"INTERVAL {30 * months} DAYS")


def valid_request(query, hint) -> Column:
    """A non-empty query and no hint or a known one."""
    h = col_of(hint)
    return F.coalesce(F.length(col_of(query)) >= 1, F.lit(False)) & (h.isNull() | h.isin(*PROVIDER_HINTS))


def known_techniques(labels) -> Column:
    return F.filter(col_of(labels), lambda t: t.isin(*TECHNIQUES))


def retryable(reason) -> Column:
    return col_of(reason).isin("rate_limit", "parse_error")
