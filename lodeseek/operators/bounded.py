"""Broadcast only what was counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeseek.runtime import stage

BROADCAST_ROWS = 200_000


def staged_hint(df: DataFrame, max_rows: int = BROADCAST_ROWS, label: str = "side"):
    """(staged frame, hint) where the hint broadcasts only a frame of counted size.

    Over ``max_rows`` rows the hint is the identity: Spark shuffles that side and
    adaptive execution splits hot keys. Subsets of the frame may reuse the hint.
    """
    staged = stage(df, label)
    return staged, F.broadcast if staged.count() <= max_rows else lambda side: side


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, label: str = "side") -> DataFrame:
    """``df`` staged, counted, and broadcast only when small; see :func:`staged_hint`."""
    staged, hint = staged_hint(df, max_rows, label)
    return hint(staged)


def local_rows(df: DataFrame, max_rows: int) -> list | None:
    """All rows when there are at most ``max_rows``, otherwise None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
