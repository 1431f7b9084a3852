"""Versioned keyed tables: immutable files, one pointer swapped per change.

A :class:`Store` is a folder with data folders (never changed once written), one list of them per version, and a pointer to the
current list. A change of any number of tables writes its files and its list first and then swaps the pointer by an atomic
rename. A change that fails leaves the pointer, and so every reader, at the old version; readers keep the version they opened.

Rows lie in hash buckets of their key. A change adds its rows (deletions as marked rows) as delta files of the buckets they fall
in and rewrites nothing; a bucket with ``MERGE_AFTER`` deltas is merged in the same change. A table starts with one bucket and
grows by linear hashing: with ``BUCKET_BYTES`` per bucket passed, the next buckets in turn are split in two, and only those are
rewritten. Spark's rebalancing deals a large bucket to several files.
"""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lodeseek.runtime import delete_path, path_exists, plan_bytes, stage

BUCKET_BYTES = 128 << 20
#: Delta files of a bucket that are merged into one; versions that stay readable.
MERGE_AFTER, KEEP_VERSIONS = 4, 3
POINTER = "CURRENT"
_SEQ, _GONE, _BUCKET = "_seq", "_gone", "_bucket"


class StaleVersion(RuntimeError):
    """Another change was committed since this one began."""


@dataclass(frozen=True)
class Spec:
    """A table: its columns, the columns of its key, and whether a later row replaces an earlier one of the same key.

    Without replacement a table is a log: rows are only added, and the key decides the bucket alone.
    """

    schema: T.StructType
    key: tuple[str, ...]
    replace: bool = True


@dataclass
class Layout:
    """Where a table's rows are: the number of buckets, and per bucket its folders, oldest first, with their bytes."""

    buckets: int = 1
    parts: dict[int, list[tuple[str, int]]] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return sum(size for p in self.parts.values() for _, size in p)

    def names(self) -> set[str]:
        return {folder for p in self.parts.values() for folder, _ in p}

    def folders(self, buckets: Iterable[int] | None = None) -> tuple[list[str], list[str]]:
        """Folders of buckets with one part, where each key has one row, and of those with more."""
        chosen = [self.parts[b] for b in (self.parts if buckets is None else buckets) if b in self.parts]
        return [p[0][0] for p in chosen if len(p) == 1], [f for p in chosen if len(p) > 1 for f, _ in p]


def bucket_of(key: Iterable[str], buckets: int) -> Column:
    """Bucket under linear hashing: by the next power of two, or by half of it where that bucket isn't split off yet."""
    low = 1 << (max(1, buckets).bit_length() - 1)
    at = F.pmod(F.xxhash64(*key), F.lit(2 * low))
    return F.when(at < buckets, at).otherwise(at - low).cast("int")


def parent_of(bucket: int) -> int:
    """The bucket that a new one is split from."""
    return bucket - (1 << (bucket.bit_length() - 1))


class Store:
    """Tables of one folder that change together."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Spec], bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.path, self.tables, self.bucket_bytes = spark, path, tables, bucket_bytes

    # -- versions -------------------------------------------------------------

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        """Whole or not at all: written beside, then renamed over the old file."""
        fs, target = self._fs(path)
        target = fs.makeQualified(target)
        beside = target.suffix(f".{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, target, options)

    def current(self) -> str | None:
        """Name of the current version."""
        pointer = os.path.join(self.path, POINTER)
        return self._read_text(pointer).strip() if path_exists(self.spark, pointer) else None

    def state(self, version: str | None = None) -> tuple[dict[str, Layout], dict, list[str]]:
        """Layouts, notes and readable versions (oldest first) of a version, by default the current one."""
        name = version or self.current()
        if name is None:
            return {t: Layout() for t in self.tables}, {}, []
        told = json.loads(self._read_text(os.path.join(self.path, "versions", name)))
        layouts = {t: Layout(v["buckets"], {int(b): [tuple(f) for f in p] for b, p in v["parts"].items()}) for t, v in told["tables"].items()}
        return {t: layouts.get(t, Layout()) for t in self.tables}, told["notes"], told["versions"]

    # -- reading --------------------------------------------------------------

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """All rows."""
        return self._rows(table, self.state(version)[0][table])

    def near(self, table: str, keys: DataFrame, version: str | None = None) -> DataFrame:
        """The rows of the buckets that ``keys`` (the key columns) fall in; other buckets' files are never listed or opened."""
        layout = self.state(version)[0][table]
        key = self.tables[table].key
        wanted = [r[0] for r in keys.select(bucket_of(key, layout.buckets)).distinct().collect()]  # at most one row per bucket
        return self._rows(table, layout, wanted)

    def _stored(self, table: str) -> T.StructType:
        return T.StructType([*self.tables[table].schema.fields, T.StructField(_SEQ, T.LongType()), T.StructField(_GONE, T.BooleanType())])

    def _open(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._stored(table))
        return self.spark.read.schema(self._stored(table)).parquet(*[os.path.join(self.path, "data", f) for f in folders])

    def _stamped(self, table: str, layout: Layout, buckets: Iterable[int] | None, only: DataFrame | None = None,
                 shown: list | None = None) -> DataFrame:
        """Valid rows with their stamps, of the keys ``only`` if given. Only buckets with deltas are shuffled by key, with what is ``shown``."""
        spec = self.tables[table]
        merged, mixed = layout.folders(buckets)
        cut = self._open if shown is None else lambda *a: self._open(*a).select(*shown, _SEQ, _GONE)
        opened = cut if only is None else lambda *a: cut(*a).join(only, list(spec.key), "left_semi")
        if not spec.replace:
            return opened(table, merged + mixed)
        out = opened(table, merged).where(~F.col(_GONE))
        if mixed:
            newest = Window.partitionBy(*spec.key).orderBy(F.col(_SEQ).desc())
            latest = opened(table, mixed).withColumn("_nth", F.row_number().over(newest)).where((F.col("_nth") == 1) & ~F.col(_GONE))
            out = out.unionByName(latest.drop("_nth"))
        return out

    def _rows(self, table: str, layout: Layout, buckets: Iterable[int] | None = None, only: DataFrame | None = None,
              shown: list | None = None) -> DataFrame:
        rows = self._stamped(table, layout, buckets, only, shown)
        return rows.select(*self.tables[table].schema.names) if shown is None else rows.drop(_SEQ, _GONE)

    # -- changing -------------------------------------------------------------

    @contextmanager
    def change(self):
        """A :class:`Change`; committed at the end of the block, dropped if the block raises."""
        began = self.current()
        layouts, notes, versions = self.state(began)
        change = Change(self, layouts, notes, len(versions) and int(began.split("-")[0]))
        try:
            yield change
        except BaseException:
            for folder in change.written:
                delete_path(self.spark, os.path.join(self.path, "data", folder))
            raise
        if self.current() != began:
            raise StaleVersion(f"{self.path}: {began} is no longer current")
        name = f"{change.seq + 1:012d}-{uuid.uuid4().hex}"
        kept = [*versions, name][-KEEP_VERSIONS:]
        tables = {t: {"buckets": v.buckets, "parts": v.parts} for t, v in change.layouts.items()}
        self._write_text(os.path.join(self.path, "versions", name), json.dumps({"tables": tables, "notes": change.notes, "versions": kept}))
        self._write_text(os.path.join(self.path, POINTER), name)
        self._vacuum(kept, [v for v in versions if v not in kept], change.written)

    def _vacuum(self, kept: list[str], dropped: list[str], written: list[str]) -> None:
        """Remove what no readable version refers to: buckets of dropped versions, and what the change wrote and merged again."""
        old = set(written)
        for version in dropped:
            old |= {f for layout in self.state(version)[0].values() for f in layout.names()}
        used = {f for v in kept for layout in self.state(v)[0].values() for f in layout.names()}
        whole = {f.split("/")[0] for f in used}
        for folder in {f if f.split("/")[0] in whole else f.split("/")[0] for f in old - used} - whole:
            delete_path(self.spark, os.path.join(self.path, "data", folder))
        for version in dropped:
            delete_path(self.spark, os.path.join(self.path, "versions", version))


class Change:
    """New rows of a store's tables; nothing is visible before the commit."""

    def __init__(self, store: Store, layouts: dict[str, Layout], notes: dict, seq: int):
        self.store, self.layouts, self.notes, self.seq, self.written = store, layouts, dict(notes), seq or 0, []
        self._step = 0

    def rows(self, table: str, keys: DataFrame | None = None, exact: bool = False, shown: list | None = None) -> DataFrame:
        """Rows as this change sees them, of the buckets of ``keys`` if given; ``exact`` leaves only the rows of these keys.

        Others are left out before the newest row of a key is looked for, so only rows of ``keys`` are shuffled for that. ``shown``
        are the columns to return, the key among them, made of a row before it is shuffled.
        """
        layout = self.layouts[table]
        if keys is None:
            return self.store._rows(table, layout, shown=shown)
        wanted = [r[0] for r in keys.select(bucket_of(self.store.tables[table].key, layout.buckets)).distinct().collect()]
        return self.store._rows(table, layout, wanted, keys if exact else None, shown)

    def upsert(self, table: str, rows: DataFrame, unique: bool = False, size: int | None = None) -> DataFrame:
        """Add rows, replacing those of the same key. Of several rows with one key in ``rows`` one is taken, the same on every read.

        ``unique`` says that no key repeats, ``size`` about how many bytes the rows take: then they are written once and not
        staged before. Returns the rows as written, readable until the change ends.
        """
        spec = self.store.tables[table]
        rows = rows.select(*spec.schema.names)
        if spec.replace and not unique:
            rows = rows.dropDuplicates(list(spec.key))
        return self._add(table, rows.withColumn(_GONE, F.lit(False)), size)

    append = upsert

    def delete(self, table: str, ids: DataFrame) -> None:
        """Remove rows by key; unknown keys change nothing."""
        spec = self.store.tables[table]
        empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in spec.key else F.col(f.name) for f in spec.schema.fields]
        self._add(table, ids.select(*spec.key).distinct().select(*empty).withColumn(_GONE, F.lit(True)))

    def overwrite(self, table: str, rows: DataFrame) -> None:
        """Replace the whole table; ``rows`` may come from this store."""
        spec = self.store.tables[table]
        rows = rows.select(*spec.schema.names)
        rows = (rows.dropDuplicates(list(spec.key)) if spec.replace else rows).withColumn(_GONE, F.lit(False))
        staged, size = self._staged(rows)
        layout = self.layouts[table] = Layout(max(1, -(-size // self.store.bucket_bytes)))
        self._put(table, layout, staged)

    def clear(self, table: str) -> None:
        self.layouts[table] = Layout()

    def note(self, name: str, value) -> None:
        """A small value kept with the version."""
        self.notes[name] = value

    # -- files ----------------------------------------------------------------

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, int]:
        staged = stage(rows, "change")
        return staged, plan_bytes(staged)  # of a written table: the bytes of its files

    def _add(self, table: str, rows: DataFrame, size: int | None = None) -> DataFrame:
        if size is None:
            rows, size = self._staged(rows)
        layout = self.layouts[table]
        self._grow(table, layout, -(-(layout.size + size) // self.store.bucket_bytes))
        folder = self._put(table, layout, rows)
        crowded = [b for b, p in layout.parts.items() if len(p) > MERGE_AFTER]
        if crowded:
            self._put(table, layout, self.store._stamped(table, layout, crowded), crowded)
        return self.store._open(table, [folder]).select(*self.store.tables[table].schema.names)

    def _grow(self, table: str, layout: Layout, wanted: int) -> None:
        """Split buckets, in turn, until there are ``wanted``; at most doubled per step so that a parent is split once.

        A task that reads a file of a parent writes its two halves: nothing is shuffled, unless deltas have to be merged.
        """
        while layout.buckets < wanted:
            target = min(wanted, 2 * layout.buckets)
            split = sorted({parent_of(b) for b in range(layout.buckets, target)} & set(layout.parts))
            moved = self.store._stamped(table, layout, split) if split else None
            merging = self.store.tables[table].replace and any(len(layout.parts[b]) > 1 for b in split)
            layout.buckets = target
            if moved is not None:
                self._put(table, layout, moved, split, dealt=merging)

    def _put(self, table: str, layout: Layout, rows: DataFrame, instead_of: Iterable[int] = (), dealt: bool = True) -> str:
        """Write rows into a folder of their own and list it under its buckets, those of ``instead_of`` losing what they had.

        Rows are dealt out by bucket first; without ``dealt`` each task writes the buckets it has.
        """
        spec, self._step = self.store.tables[table], self._step + 1
        folder = f"{table}-{uuid.uuid4().hex}"
        self.written.append(folder)
        if _SEQ not in rows.columns:
            rows = rows.withColumn(_SEQ, F.lit((self.seq + 1) * 1000 + self._step))
        names = [*spec.schema.names, _SEQ, _GONE]
        path = os.path.join(self.store.path, "data", folder)
        rows = rows.select(*names, bucket_of(spec.key, layout.buckets).alias(_BUCKET))
        (rows.hint("rebalance", F.col(_BUCKET)) if dealt else rows).write.partitionBy(_BUCKET).parquet(path)
        for bucket in instead_of:
            layout.parts.pop(bucket, None)
        fs, p = self.store._fs(path)
        files, sizes = fs.listFiles(p, True), {}
        while files.hasNext():
            status = files.next()
            name = status.getPath().getParent().getName()
            if name.startswith(f"{_BUCKET}="):
                sizes[name] = sizes.get(name, 0) + status.getLen()
        for name, size in sizes.items():
            layout.parts.setdefault(int(name.split("=")[1]), []).append((f"{folder}/{name}", size))
        return folder
