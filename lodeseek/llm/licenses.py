"""License scan with MinHash over overlapping windows, in DataFrame functions only.

Templates are cut into pieces of at most ``PIECE`` words; texts into windows of twice as many words that overlap by half, so a
whole piece lies in some window. A window is the set of its three-word shingles that any template has (others add nothing to
a containment). Bands of one minimum hash each retrieve templates: a window that holds a piece among as many shingles of
others again collides in one of the 24 bands with probability above 0.9999. Exact containment then decides: a piece is found if the
window has at least 80 % of its shingles, a license if 80 % of its pieces are found.

Words are lower case (A-Z) runs of letters, digits and non-ASCII characters. Null, empty and short texts have no license. A
template of under three words is one shingle; one without words is never found. Rows that repeat id and text get equal results. Empty
tables give empty or license-free results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodeseek.llm.common import Scratch, text_of
from lodeseek.llm.contamination import SHINGLE, shingle, word_list

PIECE, BANDS, CONTAINED = 24, 24, 0.8
#: Notices the production query looks for: (license, notice).
NOTICES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES), "license string, text string")


def _least(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band))))


def _minima(shingles: Column) -> Column:
    """(band, least hash) of a set."""
    return F.array(*[F.struct(F.lit(i).alias("band"), _least(shingles, i).alias("least")) for i in range(BANDS)])


def pieces(templates: DataFrame) -> DataFrame:
    """license, piece, k, wanted (distinct shingles)."""
    cut = templates.select("license", word_list(text_of()).alias("w")).where(F.size("w") > 0)
    cut = cut.select("license", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(PIECE))).alias("piece"))
    cut = cut.select("license", "piece", F.slice("w", F.col("piece") + 1, PIECE).alias("w"))
    cut = cut.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    one = F.when(F.col("k") == 1, shingle(F.col("w"), F.col("at"), 1)).when(F.col("k") == 2, shingle(F.col("w"), F.col("at"), 2)).otherwise(
        shingle(F.col("w"), F.col("at"), SHINGLE))
    cut = cut.select("license", "piece", "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("at"))
    return cut.select("license", "piece", "k", one.alias("s")).groupBy("license", "piece", "k").agg(F.collect_set("s").alias("wanted"))


def find_pieces(docs: DataFrame, templates: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, license, piece, at (first word of a window that holds the piece), contained."""
    known = scratch.put(pieces(templates), "pieces")
    sizes = sorted(r["k"] for r in known.select("k").distinct().collect())  # at most SHINGLE values
    universe = scratch.small(scratch.put(known.select("k", F.explode("wanted").alias("s")).distinct(), "universe"))
    text = text_of()
    words = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), word_list(text).alias("w"))
    at = words.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "_word"))
    seen = None
    for k in sizes or [SHINGLE]:
        mine = at.where(F.col("pos") + k <= F.size("w")).withColumn("s", shingle(F.col("w"), F.col("pos"), k))
        mine = mine.join(universe.where(F.col("k") == k), "s").select("doc_id", "text_hash", "pos", "s")
        seen = mine if seen is None else seen.unionByName(mine)
    start = F.floor(F.col("pos") / PIECE).cast("int") * PIECE
    # a shingle lies in the window that starts in its stretch and in the one before
    spread = seen.select("doc_id", "text_hash", "s", F.explode(F.array(start, start - PIECE)).alias("at")).where("at >= 0")
    windows = spread.groupBy("doc_id", "text_hash", "at").agg(F.collect_set("s").alias("has"))
    bands = windows.select("doc_id", "text_hash", "at", "has", F.inline(_minima(F.col("has"))))
    marks = scratch.put(known.select("license", "piece", "wanted", F.inline(_minima(F.col("wanted")))), "bands")
    met = bands.join(scratch.small(marks), ["band", "least"])
    contained = F.size(F.array_intersect("has", "wanted")) / F.size("wanted")
    met = met.withColumn("contained", contained).where(F.col("contained") >= CONTAINED)
    return met.groupBy("doc_id", "text_hash", "license", "piece").agg(F.max("contained").alias("contained"), F.min("at").alias("at"))


def scan(docs: DataFrame, templates: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, licenses (sorted names) of every row."""
    found = find_pieces(docs, templates, scratch)
    total = scratch.put(pieces(templates).groupBy("license").agg(F.count(F.lit(1)).alias("_all")), "totals")
    whole = found.groupBy("doc_id", "text_hash", "license").agg(F.count(F.lit(1)).alias("_n")).join(scratch.small(total), "license").where(
        F.col("_n") >= CONTAINED * F.col("_all"))
    named = whole.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_set("license")).alias("licenses"))
    named = scratch.put(named, "found")
    out = docs.select("doc_id", F.xxhash64(text_of()).alias("_row_hash"))
    out = out.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_hash") == F.col("_hash")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
