"""Corpus filtering, incremental indexing and chunking over documents."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from lodeseek.functions.ids import entity_id, relation_id, slug
from lodeseek.operators.chunking import (
    code_chunks, embed_input, integer_runs, number_chunks, repeated_ids, text_chunks,
)
from lodeseek.operators.filters import keep_code_files
from lodeseek.operators.manifest import (
    chunks_by_dir, count_by, diff_files, file_counts, removed_files, stale_chunk_ids, upsert,
)
from lodeseek.plans.registry import query, table
from lodeseek.runtime import shared_dir, spread, stage
from lodeseek.sources.store import Spec, Store

# Slug rule for the checking SQL; @ stands for the text.
SLUG = ("coalesce(nullif(regexp_replace(regexp_replace(lower(@), '[^\\p{L}\\p{N}_]+', '_', 'g'), "
        "'^_+|_+$', '', 'g'), ''), 'unknown')")


def slug_sql(text: str) -> str:
    return SLUG.replace("@", text)


@query("slug_ids", f"""
SELECT doc_id, {slug_sql('text')} AS slug, 'ent_' || {slug_sql('source')} AS entity_id FROM documents
""")
def slug_ids(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", slug("text").alias("slug"), entity_id("source").alias("entity_id"))


@query("relation_ids", f"""
SELECT p_partkey, 'rel_' || {slug_sql('p_name')} || '_' || {slug_sql("'Made By'")} || '_' || {slug_sql('p_brand')} AS rel_id
FROM part
""")
def relation_ids(spark, d):
    parts = table(spark, d, "part")
    rel = relation_id(entity_id("p_name"), F.lit("Made By"), entity_id("p_brand"))
    return parts.select("p_partkey", rel.alias("rel_id"))


# A code-tree view of the documents: folder from the source, extension from the language.
def file_path():
    lang = F.col("lang")
    ending = (F.when(lang == "en", ".py").when(lang == "fr", ".JS").when(lang == "de", ".min.js")
              .when(lang == "es", ".ts").otherwise(".txt"))
    folder = F.when(F.col("source") == "src3", "src3/build").otherwise(F.col("source"))
    return F.concat(folder, F.lit("/doc_"), F.col("doc_id").cast("string"), ending)


PATH_SQL = """
CASE WHEN source = 'src3' THEN 'src3/build' ELSE source END || '/doc_' || doc_id ||
CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.JS' WHEN 'de' THEN '.min.js' WHEN 'es' THEN '.ts' ELSE '.txt' END
"""

FILES_SQL = f"""
files AS (
  SELECT {PATH_SQL} AS path, lang AS doc_lang, sha256(text) AS sha256, strlen(text)::BIGINT AS size,
         CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'javascript'
                   WHEN 'es' THEN 'typescript' END AS lang, doc_id
  FROM documents
),
kept AS (
  SELECT * FROM files WHERE lang IS NOT NULL AND size BETWEEN 1 AND 400000
     AND path NOT LIKE '%/build/%' AND path NOT LIKE '%.min.js'
)"""


def files_of(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        file_path().alias("rel_path"), F.octet_length("text").cast("bigint").alias("size"),
        F.sha2("text", 256).alias("sha256"), F.col("text").alias("content"), "doc_id")


def kept_files(spark, d):
    return keep_code_files(files_of(spark, d)).withColumnRenamed("rel_path", "path")


@query("code_file_filter", f"WITH {FILES_SQL} SELECT path, lang, size, sha256 FROM kept")
def code_file_filter(spark, d):
    return kept_files(spark, d).select("path", "lang", "size", "sha256")


# The last run's manifest: labelled documents; a bad quality label means its hash is out of date.
# Benchmark passages were files then and are gone now.
MANIFEST_SQL = f"""
manifest AS (
  SELECT path, CASE WHEN quality = 1 THEN sha256 ELSE sha256('old:' || sha256) END AS sha256,
         [path || '#<module>#1', path || '#<module>#9'] AS chunk_ids
  FROM files JOIN labels USING (doc_id)
  UNION ALL SELECT 'gone/item_' || item_id, sha256(text), ['gone/item_' || item_id || '#<module>#1'] FROM benchmark
)"""

DIFF_SQL = f"""
WITH {FILES_SQL}, {MANIFEST_SQL},
diff AS (
  SELECT path, CASE WHEN m.sha256 IS NULL THEN 'new' WHEN k.sha256 IS NULL THEN 'removed'
                    WHEN k.sha256 = m.sha256 THEN 'unchanged' ELSE 'changed' END AS status
  FROM kept k FULL JOIN manifest m USING (path)
)"""


def old_manifest(spark, d):
    def ids(path, *lines):
        return F.array(*(F.concat(path, F.lit(f"#<module>#{n}")) for n in lines))

    files = files_of(spark, d).join(table(spark, d, "labels"), "doc_id")
    path = F.col("rel_path")
    old = F.sha2(F.concat(F.lit("old:"), F.col("sha256")), 256)
    known = files.select(
        path.alias("path"), F.when(F.col("quality") == 1, F.col("sha256")).otherwise(old).alias("sha256"),
        ids(path, 1, 9).alias("chunk_ids"))
    gone = F.concat(F.lit("gone/item_"), F.col("item_id").cast("string"))
    return known.unionByName(table(spark, d, "benchmark").select(
        gone.alias("path"), F.sha2("text", 256).alias("sha256"), ids(gone, 1).alias("chunk_ids")))


def diff_of(spark, d):
    return diff_files(kept_files(spark, d), old_manifest(spark, d))


@query("manifest_diff", f"{DIFF_SQL} SELECT path, status FROM diff")
def manifest_diff(spark, d):
    return diff_of(spark, d).select("path", "status")


@query("removed_files", f"""
WITH {FILES_SQL}, {MANIFEST_SQL} SELECT path FROM manifest WHERE path NOT IN (SELECT path FROM kept)
""")
def removed_files_query(spark, d):
    return removed_files(kept_files(spark, d), old_manifest(spark, d)).select("path")


@query("stale_chunks", f"""
{DIFF_SQL} SELECT unnest(chunk_ids) AS chunk_id FROM manifest JOIN diff USING (path) WHERE status IN ('changed', 'removed')
""")
def stale_chunks(spark, d):
    return stale_chunk_ids(old_manifest(spark, d), diff_of(spark, d))


@query("index_report", f"""
{DIFF_SQL}
SELECT count(*) FILTER (status <> 'removed') AS files_scanned,
       count(*) FILTER (status IN ('new', 'changed')) AS files_indexed,
       count(*) FILTER (status = 'unchanged') AS files_unchanged,
       count(*) FILTER (status = 'removed') AS files_removed FROM diff
""")
def index_report(spark, d):
    return file_counts(diff_of(spark, d))


@query("files_by_lang", f"WITH {FILES_SQL} SELECT lang, count(*) AS n FROM kept GROUP BY lang")
def files_by_lang(spark, d):
    return count_by(kept_files(spark, d), "lang")


LINES_SQL = """
lines AS (
  SELECT doc_id, source, lang, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS piece, line FROM (
    SELECT doc_id, source, lang, generate_subscripts(string_split(text, chr(10)), 1) AS idx,
           unnest(string_split(text, chr(10))) AS line FROM documents
  ) WHERE regexp_matches(line, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')
)"""


def document_lines(spark, d):
    """Non-blank lines of every document as pieces: (doc_id, source, lang, piece, line)."""
    from lodeseek.functions.text import has_text

    lines = F.filter(F.split("text", "\n"), has_text)
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "lang", "text"))
    rows = docs.select("doc_id", "source", "lang", F.posexplode_outer(lines).alias("piece", "line"))
    return rows.where(F.col("line").isNotNull())


@query("chunks_by_dir", f"""
WITH {LINES_SQL} SELECT source AS dir, count(*) AS n FROM lines GROUP BY source
""")
def chunks_by_dir_query(spark, d):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return chunks_by_dir(document_lines(spark, d).select(path.alias("path")))


@query("chunks_by_lang", f"WITH {LINES_SQL} SELECT lang, count(*) AS n FROM lines GROUP BY lang")
def chunks_by_lang(spark, d):
    return count_by(document_lines(spark, d), "lang")


@query("chunk_sequence", f"""
WITH {LINES_SQL}
SELECT doc_id, piece::INT AS piece, 'chunk_' || (row_number() OVER (ORDER BY doc_id, piece) - 1) AS chunk_id FROM lines
""")
def chunk_sequence(spark, d):
    numbered = number_chunks(document_lines(spark, d).drop("line"), ["doc_id"])
    return numbered.select("doc_id", "piece", "chunk_id")


@query("chunks_per_source", f"WITH {LINES_SQL} SELECT source, count(*) AS n FROM lines GROUP BY source")
def chunks_per_source_query(spark, d):
    from lodeseek.operators.chunking import chunks_per_source

    return chunks_per_source(document_lines(spark, d))


@query("dedupe_suffix", """
SELECT doc_id, path, CASE WHEN k > 0 THEN symbol || '~' || k ELSE symbol END AS symbol FROM (
  SELECT doc_id, source AS path, lang AS symbol,
         row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS k FROM documents)
""")
def dedupe_suffix(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("path"), F.col("lang").alias("symbol"))
    return repeated_ids(rows.withColumn("base", F.col("symbol")), ["path", "base"], ["doc_id"]).drop("base")


@query("gaps_islands", """
SELECT lang, min(doc_id) AS first, max(doc_id) AS last FROM (
  SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS island FROM documents
) GROUP BY lang, island
""")
def gaps_islands(spark, d):
    return integer_runs(table(spark, d, "documents"), ["lang"], "doc_id")


@query("text_chunks")
def text_chunks_query(spark, d):
    """Whole documents cut to size; boundaries come from the splitter, checked by its tests."""
    pieces = stage(text_chunks(table(spark, d, "documents"), ["doc_id"]), "pieces")
    return number_chunks(pieces, ["doc_id"]).select("chunk_id", "doc_id", "source", "heading_path", "text")


@query("code_chunks")
def code_chunks_query(spark, d):
    """Chunks of the code-tree view with the text given to the embedder."""
    chunks = embed_input(code_chunks(kept_files(spark, d)))
    return chunks.select("chunk_id", "path", "lang", "symbol", "start_line", "end_line", "embed_text")


@query("vector_upsert", """
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, quality FROM labels
""")
def vector_upsert(spark, d):
    """Label rows replace the stored rows of the same id."""
    stored = table(spark, d, "embeddings").select("vec_id", "label")
    incoming = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("label"))
    return upsert(stored, incoming, "vec_id")


def new_store(spark, tables, **options) -> Store:
    """A store in the shared folder."""
    return Store(spark, os.path.join(shared_dir(spark), "stages", f"store-{uuid.uuid4().hex}"), tables, **options)


def label_store(spark, d) -> Store:
    """Labels of the embeddings as a stored table, with the rows of ``labels`` written over it."""
    stored = table(spark, d, "embeddings").select("vec_id", "label")
    store = new_store(spark, {"labels": Spec(stored.schema, ("vec_id",))}, bucket_bytes=64 << 10)
    with store.change() as change:
        change.overwrite("labels", stored)
    with store.change() as change:
        change.upsert("labels", table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("label")))
    return store


@query("store_upsert", """
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, quality FROM labels
""")
def store_upsert(spark, d):
    """The versioned table after a write and an upsert."""
    return label_store(spark, d).read("labels")


@query("store_delete", """
SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, quality FROM labels WHERE toxic = 0
""")
def store_delete(spark, d):
    """The same after the toxic ids are deleted; ids that aren't there change nothing."""
    store = label_store(spark, d)
    with store.change() as change:
        change.delete("labels", table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id")))
        change.delete("labels", table(spark, d, "labels").select((-1 - F.col("doc_id")).alias("vec_id")))
    return store.read("labels")


@query("store_lookup", """
SELECT vec_id, label FROM embeddings WHERE vec_id % 20 = 0 AND vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 20 = 0
""")
def store_lookup(spark, d):
    """Rows found by key, from the buckets of the keys alone."""
    store = label_store(spark, d)
    rows = table(spark, d, "embeddings").select("vec_id").union(table(spark, d, "labels").select("doc_id"))
    keys = stage(rows.where("vec_id % 20 = 0").distinct(), "keys")
    return store.near("labels", keys).join(keys, "vec_id", "left_semi")
