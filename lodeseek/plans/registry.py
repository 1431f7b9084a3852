"""Named queries over the driver tables, each with an independent SQL check."""

from __future__ import annotations

import os
from functools import wraps
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeseek.runtime import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by its own tests only."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship_package(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_all() -> None:
    """Import every family of registered queries."""
    from lodeseek.plans import (  # noqa: F401
        queries_acquire, queries_answer, queries_evaluate, queries_graph,
        queries_index, queries_rank, queries_stream,
    )
