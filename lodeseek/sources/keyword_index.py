"""A stored keyword index: postings in term buckets, changed by deltas, read by the buckets of a query's terms.

Four tables of one :class:`~lodeseek.sources.store.Store`, so that a change of the corpus is one version of all of them:

``documents``  doc_id, gen, length, terms, tfs: what is indexed, and under which generation; the terms, which hold no white space,
               are one text joined by spaces, a third of the bytes of an array of strings when rows are shuffled
``postings``   term, gen, docs, tfs, lengths: a log in buckets of the term; an entry counts while its document has that generation
``terms``      term, df
``shares``     df, terms: how many terms have each document frequency

A change of documents writes their postings under a new generation and touches only the buckets of their old and new terms;
postings of earlier generations are told apart when they are read and removed by :meth:`KeywordIndex.compact`. The corpus
totals (number and mean length of documents, number of terms, mean weight) follow from ``shares`` and are noted with the version.
Texts are read when they are indexed and never for a query. Tasks count the words of a document and turn their documents into
lists of postings, one row per term and ``PACK`` postings, so that single words and single postings are never shuffled.
"""

from __future__ import annotations

import os
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodeseek.functions.text import words
from lodeseek.operators.bounded import bounded
from lodeseek.runtime import plan_bytes, shared_dir, stage
from lodeseek.sources.store import BUCKET_BYTES, Change, Spec, Store

#: Postings a task turns into lists at once.
PACK = 1 << 20
#: Terms of a query that travel to every task.
BROADCAST_TERMS = 200_000


def _tables(doc_type: T.DataType) -> dict[str, Spec]:
    def schema(**columns):
        return T.StructType([T.StructField(n, t) for n, t in columns.items()])

    whole, text, numbers = T.LongType(), T.StringType(), T.ArrayType(T.IntegerType())
    return {
        "documents": Spec(schema(doc_id=doc_type, gen=whole, length=whole, terms=text, tfs=numbers), ("doc_id",)),
        "postings": Spec(schema(term=text, gen=whole, docs=T.ArrayType(doc_type), tfs=numbers, lengths=numbers), ("term",), replace=False),
        "terms": Spec(schema(term=text, df=whole), ("term",)),
        "shares": Spec(schema(df=whole, terms=whole), ("df",)),
    }


def raw_weight(n, df):
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, gen, length, tokens) -> (doc_id, gen, length, terms joined by spaces, tfs)."""
    for batch in batches:
        tokens = batch.column("tokens")
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(tokens).to_numpy())
        flat = tokens.flatten().dictionary_encode()
        n = max(1, len(flat.dictionary))
        keys, tf = np.unique(doc * np.int64(n) + flat.indices.to_numpy(), return_counts=True)
        sizes = np.bincount(keys // n, minlength=batch.num_rows)
        terms = pc.binary_join(_lists(sizes, flat.dictionary.take(pa.array(keys % n))), " ")
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", "gen", "length")], terms, _lists(sizes, pa.array(tf.astype(np.int32)))], ["doc_id", "gen", "length", "terms", "tfs"])


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    doc_ids, gens, lengths, terms, tfs = (pa.concat_arrays([b.column(c) for b in batches]) for c in ("doc_id", "gen", "length", "terms", "tfs"))
    doc = np.repeat(np.arange(len(doc_ids)), pc.list_value_length(tfs).to_numpy())
    flat = pc.split_pattern(terms, " ").flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    sizes, rows = np.bincount(codes, minlength=len(flat.dictionary)), pa.array(doc[order])
    return pa.RecordBatch.from_arrays(
        [flat.dictionary, gens.take(pa.array(np.zeros(len(sizes), np.int64))), _lists(sizes, doc_ids.take(rows)),
         _lists(sizes, tfs.flatten().take(pa.array(order))), _lists(sizes, lengths.cast(pa.int32()).take(rows))],
        ["term", "gen", "docs", "tfs", "lengths"])


def pack_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one generation -> (term, gen, docs, tfs, lengths), a row per term and about ``PACK`` postings."""
    held, n = [], 0
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("tfs")), 0))  # an empty text would split into one empty term
        held.append(batch)
        n += len(batch.column("tfs").flatten())
        if n >= PACK:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


class KeywordIndex:
    """The index in a folder. Ids are unique; a null text has no terms and is a document all the same."""

    def __init__(self, spark: SparkSession, path: str, doc_type: T.DataType = T.LongType(), bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.store = spark, Store(spark, path, _tables(doc_type), bucket_bytes)

    @staticmethod
    def of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> "KeywordIndex":
        """A new index of ``docs`` in the shared folder."""
        spark = docs.sparkSession
        index = KeywordIndex(spark, os.path.join(shared_dir(spark), "stages", f"keywords-{uuid.uuid4().hex}"), docs.schema[doc_id].dataType)
        index.put(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
        return index

    # -- changing -------------------------------------------------------------

    def put(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text), or index them anew."""
        with self.store.change() as change:
            self._change(change, docs.select("doc_id", "text"), docs.select("doc_id"))

    def remove(self, ids: DataFrame) -> None:
        """Drop documents; unknown ids change nothing."""
        with self.store.change() as change:
            self._change(change, None, ids.select("doc_id"))

    def _change(self, change: Change, docs: DataFrame | None, ids: DataFrame) -> None:
        gen, notes = change.seq + 1, change.notes
        old = None
        if notes.get("n_docs"):
            known = change.rows("documents", bounded(ids.distinct(), label="ids"), exact=True)
            old = stage(known.select("doc_id", "length", "terms"), "old-documents")
        count = F.count(F.lit(1)).alias("n")
        gone = old.agg(count, F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first() if old is not None else {"n": 0, "length": 0}
        parts, added = [], {"n": 0, "length": 0}
        if docs is not None:
            told = docs.agg(count, F.count_distinct(F.struct("doc_id")).alias("ids"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
            docs = docs.dropDuplicates(["doc_id"]) if told["ids"] < told["n"] else docs
            tokens = docs.select("doc_id", F.lit(gen).cast("long").alias("gen"), F.coalesce(words("text"), F.array().cast("array<string>")).alias("tokens"))
            tokens = tokens.select("doc_id", "gen", F.size("tokens").cast("long").alias("length"), "tokens")
            specs = self.store.tables
            # both tables take about as many bytes as the texts
            fresh = change.upsert("documents", tokens.mapInArrow(count_words, specs["documents"].schema), unique=True, size=told["bytes"])
            lists = change.append("postings", fresh.mapInArrow(pack_postings, specs["postings"].schema), size=told["bytes"])
            parts.append(lists.select("term", F.size("docs").cast("long").alias("more")))
            added = fresh.agg(count, F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        if gone["n"]:
            parts.append(old.where("length > 0").select(F.explode(F.split("terms", " ")).alias("term"), F.lit(-1).cast("long").alias("more")))
            notes["stale"] = True
            if docs is None:
                change.delete("documents", old)
        if parts:
            moved = parts[0].union(parts[1]) if len(parts) > 1 else parts[0]
            self._count(change, stage(moved.groupBy("term").agg(F.sum("more").alias("more")).where("more != 0"), "moved"), gone["n"] > 0)
        change.note("n_docs", notes.get("n_docs", 0) + added["n"] - gone["n"])
        change.note("length", notes.get("length", 0) + added["length"] - gone["length"])
        n = F.lit(change.notes["n_docs"])
        sums = change.rows("shares").agg(F.sum("terms").alias("n"), F.sum(F.col("terms") * raw_weight(n, F.col("df"))).alias("w")).first()
        change.note("n_terms", sums["n"] or 0)
        change.note("mean_weight", sums["w"] / sums["n"] if sums["n"] else 0.0)

    def _count(self, change: Change, moved: DataFrame, fewer: bool) -> None:
        """Bring document frequencies, and their distribution, up to date with ``moved`` (term, more), negative only if ``fewer``."""
        before = change.rows("terms", moved.select("term"))
        after = moved.join(before, "term", "left").select(
            "term", F.col("df").alias("old"), (F.coalesce("df", F.lit(0)) + F.col("more")).alias("df"))
        after = stage(after, "terms")
        change.upsert("terms", after.where("df > 0"), unique=True, size=plan_bytes(after))
        if fewer:
            change.delete("terms", after.where("df <= 0"))
        shift = after.select(F.explode(F.array(F.struct(F.col("old").alias("df"), F.lit(-1).alias("more")), F.struct(F.col("df"), F.lit(1).alias("more")))).alias("s"))
        shift = stage(shift.select("s.*").where("df > 0").groupBy("df").agg(F.sum("more").alias("more")), "shares")
        shares = stage(shift.join(change.rows("shares", shift.select("df")), "df", "left").select("df", (F.coalesce("terms", F.lit(0)) + F.col("more")).alias("terms")), "shares")
        change.upsert("shares", shares.where("terms > 0"))
        change.delete("shares", shares.where("terms <= 0"))

    def compact(self) -> None:
        """Remove the postings of earlier generations."""
        with self.store.change() as change:
            valid = self._valid(self._entries(change.rows("postings")), change.rows("documents"))
            # short lists: no task gathers a frequent term
            lists = F.pmod(F.xxhash64("doc_id"), F.lit(1 + change.notes.get("n_docs", 0) // 4096)).alias("_part")
            entry = F.collect_list(F.struct("doc_id", "tf", "length")).alias("e")
            packed = valid.groupBy("term", "gen", lists).agg(entry)
            change.overwrite("postings", packed.select("term", "gen", *[F.col(f"e.{c}").alias(n) for c, n in (("doc_id", "docs"), ("tf", "tfs"), ("length", "lengths"))]))
            change.note("stale", False)

    # -- reading --------------------------------------------------------------

    def totals(self) -> dict:
        """n_docs, avg_len, n_terms and mean_idf of the current version; avg_len and mean_idf are None of an empty corpus."""
        notes = self.store.state()[1]
        n = notes.get("n_docs", 0)
        return {"n_docs": n, "avg_len": notes["length"] / n if n else None, "n_terms": notes.get("n_terms", 0),
                "mean_idf": notes["mean_weight"] if notes.get("n_terms") else None}

    def weights(self, terms: DataFrame, floor: float) -> DataFrame:
        """(term, idf) of the known ones of ``terms``; a negative weight is ``floor`` times the mean of the vocabulary."""
        totals = self.totals()
        raw = raw_weight(F.lit(totals["n_docs"]), F.col("df"))
        found = self.store.near("terms", terms).join(terms.select("term").distinct(), "term", "left_semi")
        return found.select("term", F.when(raw < 0, F.lit(floor * (totals["mean_idf"] or 0.0))).otherwise(raw).alias("idf"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(term, doc_id, tf, length) of ``terms`` (term, each once), and what other columns it has, from the buckets of the terms."""
        terms = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
        rows = self._entries(self.store.near("postings", terms.select("term")).join(terms, "term"))
        if self.store.state()[1].get("stale"):
            rows = self._valid(rows, self.store.read("documents"))
        return rows.drop("gen")

    @staticmethod
    def _entries(postings: DataFrame) -> DataFrame:
        """One row per posting."""
        others = [c for c in postings.columns if c not in ("docs", "tfs", "lengths")]
        entry = F.arrays_zip(F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))
        return postings.select(*others, F.inline(entry).alias("doc_id", "tf", "length"))

    @staticmethod
    def _valid(postings: DataFrame, documents: DataFrame) -> DataFrame:
        return postings.join(documents.select("doc_id", "gen"), ["doc_id", "gen"], "left_semi")
