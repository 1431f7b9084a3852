"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows (13 words, or the whole item if shorter). A window occurs in a document only
if all its three-word shingles do, so the shingle that is rarest over the whole corpus is a sufficient prefix. Documents join
on that one token; its offset gives the only possible start (positional bound), the window must fit between start
and end (length bound), and the words themselves are compared at that place.

Words are those of the lower-cased (A-Z only) text. Null and empty texts have no words and are never contaminated; an
item without words has no window. Rows that share an id, or have none, share their hits; items of one id merge.
Empty tables give empty results or zero hits. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodeseek.llm.common import Scratch, text_of

#: What separates words once A-Z is lower-cased, and before.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Contaminated: at least one in so many words is hit.
SHARE = 20
SHINGLE = 3


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; texts of one byte per character take the fast function."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BREAK), "")


def word_count(text: Column) -> Column:
    """Number of words; case has no part in it."""
    return F.size(F.array_remove(F.split(text, BREAK_ANY_CASE), "")).cast("long")


def shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from the 0-based position."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(size)])


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that have them: window_words, n, k (words of a shingle), items."""
    cut = items.select(F.col("item_id").cast("string").alias("item"), word_list(text_of()).alias("w")).where(F.size("w") > 0)
    cut = cut.withColumn("n", F.least(F.size("w"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))
    cut = cut.select("item", "w", "n", starts.alias("at")).select("item", "n", F.slice("w", F.col("at"), F.col("n")).alias("window_words"))
    return cut.groupBy("window_words", "n").agg(F.collect_set("item").alias("items")).withColumn(
        "k", F.least("n", F.lit(SHINGLE)))


def _positions(docs: DataFrame, k: int, key: str) -> DataFrame:
    """Every shingle of ``k`` words of every document."""
    words = docs.select(F.col("doc_id"), word_list(text_of()).alias("w"))
    at = words.select("doc_id", "w", F.posexplode("w").alias("pos", "_word"))
    return at.where(F.col("pos") + k <= F.size("w")).withColumn(key, shingle(F.col("w"), F.col("pos"), k))


def find_windows(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Occurrences: doc_id, start, n, items."""
    spark = docs.sparkSession
    windows = scratch.put(benchmark_windows(items, window), "windows")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most SHINGLE values
    found = None
    for k in sizes:
        mine = windows.where(F.col("k") == k)
        tokens = mine.select("*", F.posexplode(F.sequence(F.lit(0), F.col("n") - k)).alias("_i", "offset"))
        tokens = scratch.put(tokens.withColumn("token", shingle(F.col("window_words"), F.col("offset"), k)).drop("_i"), "tokens")
        known = scratch.put(tokens.select("token").distinct(), "known")
        seen = _positions(docs, k, "token").join(scratch.small(known), "token").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
        # A window with a shingle that no document has occurs nowhere: the inner join drops it only if all of its tokens miss,
        # so missing tokens count zero and rank first.
        rank = Window.partitionBy("window_words").orderBy(F.coalesce("seen", F.lit(0)), "token", "offset")
        rare = tokens.join(seen, "token", "left").withColumn("_r", F.row_number().over(rank)).where("_r = 1 and seen > 0")
        prefix = scratch.put(rare.select("token", "offset", "window_words", "n", "items"), "prefix")
        start = F.col("pos") - F.col("offset")
        hits = _positions(docs, k, "token").join(scratch.small(prefix), "token").where(
            (start >= 0) & (start + F.col("n") <= F.size("w")))
        hits = hits.where(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window_words"))
        hits = hits.select("doc_id", start.alias("start"), "n", "items")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {id_type}, start int, n int, items array<string>")
    return found


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with id and text hash as ``doc_id``: two texts under one id don't share their hits."""
    return docs.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("hash")))


def scan(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted), contaminated.

    ``contaminated`` is n_hit > 0 and ``share`` * n_hit >= n_words.
    """
    return _scan(keyed(docs.select("doc_id", "text")), items, scratch, window, share).withColumn("doc_id", F.col("doc_id.id"))


def _scan(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int, share: int) -> DataFrame:
    found = scratch.put(find_windows(docs, items, scratch, window), "found")
    spans = found.groupBy("doc_id", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).cast("long").alias("n"),
                              F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])
    names = found.select("doc_id", F.explode("items").alias("item")).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    names = names.withColumnRenamed("doc_id", "_name_id")
    hits = spans.select("doc_id", covered.alias("n_hit")).join(names, F.col("doc_id").eqNullSafe(F.col("_name_id")))
    hits = scratch.put(hits.select("doc_id", "n_hit", "items"), "hits")
    hits = hits.withColumnRenamed("doc_id", "_hit_id")
    out = docs.select("doc_id", word_count(text_of()).alias("n_words")).join(hits, F.col("doc_id").eqNullSafe(F.col("_hit_id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns."""
    found = _scan(keyed(docs.select("doc_id", "text")), items, scratch, WINDOW, SHARE)
    bad = scratch.put(found.where("contaminated").select(F.col("doc_id").alias("_bad")).distinct(), "bad")
    return docs.join(bad, F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("hash")).eqNullSafe(F.col("_bad")), "left_anti")
