"""The corpus pipeline: language, exact copies, near copies, benchmark passages, source weights.

Every stage reads all that its predecessor kept (a Parquet table) and returns the columns of ``documents``; the last one
adds ``epoch``. ``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm import contamination, exact, language, mixing, near
from lodeseek.llm.common import Scratch, read
from lodeseek.runtime import ship_package


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter or no language with a clear majority."""
    return language.accepted(docs, Scratch(ship_package(spark), "language"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.kept_rows(docs, Scratch(ship_package(spark), "exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.kept_rows(docs, Scratch(ship_package(spark), "near"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.clean_rows(docs, read(spark, sf_dir, "benchmark"), Scratch(spark, "contamination"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, Scratch(spark, "mixing"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
]

#: Language labels come from a trained model and near copies from alignments: no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = scratch.put(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
