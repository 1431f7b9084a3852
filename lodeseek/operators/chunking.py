"""Files and documents to chunks: one row in, many rows out."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lodeseek.config import DEFAULTS, Tunables
from lodeseek.functions import splitting
from lodeseek.functions.ids import code_chunk_id, text_chunk_id
from lodeseek.functions.text import col_of
from lodeseek.operators.ordered import row_numbers, running_total
from lodeseek.runtime import spread, stage

CODE_CHUNK = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("lang", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("signature", T.StringType(), False),
    T.StructField("start_line", T.IntegerType(), False),
    T.StructField("end_line", T.IntegerType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("doc", T.StringType(), False),
])


def code_chunks(files: DataFrame, cfg: Tunables = DEFAULTS, length=splitting.token_count) -> DataFrame:
    """Chunks of (path, lang, content) files with their id, in file order (``ord``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, lang, n, *piece)
                for path, lang, content in zip(batch["path"], batch["lang"], batch["content"])
                for n, piece in enumerate(splitting.code_pieces(
                    path, lang, content, cfg.code_chunk_size, cfg.code_chunk_overlap, length))
            ]
            yield pd.DataFrame(rows, columns=CODE_CHUNK.names)

    chunks = spread(files.select("path", "lang", "content")).mapInPandas(run, CODE_CHUNK)
    return chunks.withColumn("chunk_id", code_chunk_id("path", "symbol", "start_line"))


def embed_input(chunks: DataFrame, out: str = "embed_text") -> DataFrame:
    """Text given to the embedder: path, signature and doc line above the code."""

    def line(label, value):
        return F.when(value != "", F.concat(F.lit(f"# {label}: "), value))

    return chunks.withColumn(out, F.concat_ws(
        "\n", F.concat(F.lit("# path: "), F.col("path")), line("signature", F.col("signature")),
        line("doc", F.col("doc")), F.col("text")))


def metadata(chunks: DataFrame, indexed_at: str, *more) -> DataFrame:
    """The stored metadata record, no nulls; ``more`` are further columns of ``chunks``."""
    return chunks.select(
        "chunk_id", "path", "lang", "symbol", F.coalesce("signature", F.lit("")).alias("signature"),
        "start_line", "end_line", F.lit(indexed_at).alias("indexed_at"), *more)


def repeated_ids(df: DataFrame, keys: list[str], order: list[str], symbol: str = "symbol", **options) -> DataFrame:
    """Tell rows with equal keys apart: the k-th repeat (k >= 1) gets ``~k``."""
    numbered = row_numbers(df, keys, order, "_n", **options)
    suffix = F.concat(F.lit("~"), (F.col("_n") - 1).cast("string"))
    return numbered.withColumn(
        symbol, F.when(F.col("_n") > 1, F.concat(F.col(symbol), suffix)).otherwise(F.col(symbol))).drop("_n")


def integer_runs(df: DataFrame, keys: list[str], number: str, **options) -> DataFrame:
    """(keys, first, last) of consecutive integers: gaps and islands."""
    islands = row_numbers(df.select(*keys, number).distinct(), keys, [number], "_n", **options)
    return (
        islands.groupBy(*keys, (F.col(number) - F.col("_n")).alias("_island"))
        .agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_island")
    )


_SECTION = "array<struct<heading_path:string,text:string>>"


def text_chunks(docs: DataFrame, order: list[str], cfg: Tunables = DEFAULTS, text: str = "text",
                keep: list[str] = ("source",)) -> DataFrame:
    """(order, keep, piece, heading_path, text): markdown sections cut to size."""
    size, overlap = cfg.text_chunk_size, cfg.text_chunk_overlap

    @F.pandas_udf(_SECTION)
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [
            {"heading_path": h, "text": piece} for h, piece in splitting.text_pieces(t, size, overlap)])

    names = list(dict.fromkeys([*order, *keep]))
    pieces = spread(docs.select(*names, text)).select(*names, F.posexplode(cut(text)).alias("piece", "chunk"))
    return pieces.select(*names, "piece", "chunk.heading_path", "chunk.text")


def number_chunks(pieces: DataFrame, order: list[str], piece: str = "piece", **options) -> DataFrame:
    """Add ``seq`` and ``chunk_id``: one 0-based sequence over (order, piece).

    Pieces are counted per document, document offsets come from a running total
    over documents, and each piece adds its place in its document, so the corpus
    is never sorted as one. ``piece`` must be 0-based and gapless per document.
    """
    sizes = pieces.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    sizes = stage(sizes, "doc-sizes")
    rows = sizes.count() if "group_rows" not in options else options.pop("group_rows")
    offsets = running_total(sizes, [], order, "_n", "_end", group_rows=rows, **options)
    seq = F.col("_end") - F.col("_n") + F.col(piece)
    return (
        pieces.join(offsets, order).withColumn("seq", seq.cast("bigint"))
        .withColumn("chunk_id", text_chunk_id("seq")).drop("_end", "_n")
    )


def chunks_per_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def heading_path(*levels) -> "F.Column":
    """``h1 > h2 > ...`` with empty levels skipped."""
    return F.concat_ws(" > ", *(F.nullif(col_of(level), F.lit("")) for level in levels))
