"""Corpus readers: code trees, markdown folders, JSON Lines, YAML schema, reports."""

from __future__ import annotations

import os
from typing import Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodeseek.config import DEFAULTS, EXCLUDED_GLOBS, Tunables
from lodeseek.functions.text import col_of, file_stem
from lodeseek.operators.filters import keep_code_files
from lodeseek.runtime import path_exists

STRINGS = T.ArrayType(T.StringType())

CODE_ITEM = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "query", "type", "difficulty", "lang")),
    T.StructField("gt_chunk_ids", STRINGS), T.StructField("gt_paths", STRINGS),
    *(T.StructField(n, T.StringType()) for n in ("expected_answer", "expected_behavior", "note")),
])
GRAPH_ITEM = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("id", "query", "type", "difficulty")),
    *(T.StructField(n, STRINGS) for n in ("gt_entities", "gt_relations", "gt_chunk_ids")),
    *(T.StructField(n, T.StringType()) for n in ("expected_answer", "expected_behavior", "note")),
])
FAILURE = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "reason", "detail")])


def utf8_text(content) -> "F.Column":
    """Bytes to text; undecodable bytes become the replacement character."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda raw: bytes(raw).decode("utf-8", errors="replace"))

    return run(col_of(content))


def _relative(base: str, path) -> "F.Column":
    """Path below ``base``; base and file URIs compare by their path part."""
    root = "/" + unquote(base.split("://")[-1].split(":", 1)[-1]).strip("/") + "/"
    decoded = F.url_decode(F.replace(col_of(path), F.lit("+"), F.lit("%2B")))
    return F.substring(decoded, F.instr(decoded, root) + len(root), F.length(decoded))


def code_files(spark: SparkSession, base: str, globs: Sequence[str] = EXCLUDED_GLOBS,
               cfg: Tunables = DEFAULTS) -> DataFrame:
    """(path, abs_path, lang, size, sha256, content) of the indexable files under ``base``.

    Name rules look at file metadata alone, which Spark applies while it lists the files, and size rules reach the
    reader: excluded files are never opened.
    """
    if not path_exists(spark, base):
        raise FileNotFoundError(f"no such corpus folder: {base}")
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        .select(F.col("path").alias("abs_path"), F.col("length").alias("size"), "content")
        .withColumn("rel_path", _relative(base, F.col("_metadata.file_path")))
    )
    kept = keep_code_files(listed, globs=globs, cfg=cfg)
    return kept.select(
        F.col("rel_path").alias("path"), "abs_path", "lang", "size",
        F.sha2("content", 256).alias("sha256"), utf8_text("content").alias("content"))


def markdown_docs(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(source, path, text) of the markdown files of one folder."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return raw.select(file_stem(F.url_decode(path)).alias("source"), path.alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def failed_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id of the failure rows of an extraction report; missing or unreadable rows give none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "chunk_id string")
    rows = spark.read.schema(FAILURE).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("chunk_id") != "").select("chunk_id")


def graph_schema(spark: SparkSession, path: str) -> tuple[list[str], DataFrame, list[str]]:
    """(node types, (src_type, rel_type, dst_type) frame, node properties) from YAML."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        spec = yaml.safe_load(handle)
    triples = spark.createDataFrame(
        [tuple(t) for t in spec["allowed_relationships"]], "src_type string, rel_type string, dst_type string")
    return list(spec["allowed_nodes"]), triples, list(spec.get("node_properties", []))


def write_json_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON Lines; non-ASCII text is kept."""
    df.write.mode("overwrite").json(path)


def write_chunk_list(metadata: DataFrame, path: str) -> None:
    """Chunk metadata as JSON Lines parts in chunk_id order."""
    metadata.orderBy("chunk_id").write.mode("overwrite").json(path)


def default_graph_schema() -> str:
    return os.path.join(os.path.dirname(os.path.dirname(__file__)), "graph_schema.yaml")
