"""Versioned tables: merges, growth by splitting, bucket lookups, failed and late writes."""

import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from lodeseek.sources.store import KEEP_VERSIONS, Spec, StaleVersion, Store, bucket_of, parent_of

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), {"keyed": Spec(SCHEMA, ("id",)), "log": Spec(SCHEMA, ("id",), False)}, bucket_bytes=4000)


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_linear_hashing(spark):
    """With one bucket more only the rows of its parent move, and only into the new one."""
    df = spark.range(2000).select("id", *[bucket_of(["id"], n).alias(f"b{n}") for n in range(1, 12)])
    for r in df.collect():
        for n in range(1, 11):
            old, new = r[f"b{n}"], r[f"b{n + 1}"]
            assert 0 <= old < n and (new == old or (new == n and old == parent_of(n)))


def test_changes_against_a_dict(spark, store):
    rng, model, log = random.Random(1), {}, 0
    for step in range(7):
        up = {rng.randrange(300): f"{step}-{n}" for n in range(120)}
        gone = [rng.randrange(300) for _ in range(20)]
        with store.change() as change:
            change.upsert("keyed", rows(spark, *up.items()))
            change.delete("keyed", ids(spark, *gone))
            change.append("log", rows(spark, *up.items()))
            change.note("step", step)
        model.update(up)
        for g in gone:
            model.pop(g, None)
        log += len(up)
    assert {r["id"]: r["v"] for r in store.read("keyed").collect()} == model and store.read("log").count() == log
    layouts, notes, versions = store.state()
    assert layouts["keyed"].buckets > 2 and notes == {"step": 6} and len(versions) == KEEP_VERSIONS
    # older versions stay readable, their numbers of rows differ
    assert store.read("log", versions[0]).count() == store.read("log", versions[-1]).count() - sum(
        store.read("log", b).count() - store.read("log", a).count() for a, b in zip(versions, versions[1:]))
    # folders of versions that are gone are removed
    used = {f.split("/")[0] for v in versions for layout in store.state(v)[0].values() for f in layout.names()}
    assert set(os.listdir(os.path.join(store.path, "data"))) == used


def test_lookup_reads_its_buckets_only(spark, store):
    for part in range(3):
        with store.change() as change:
            change.upsert("keyed", spark.range(part * 200, part * 200 + 200).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")))
    found = store.near("keyed", ids(spark, 5, 250))
    assert {r["id"] for r in found.where("id in (5, 250)").collect()} == {5, 250}
    assert 0 < len(found.inputFiles()) < len(store.read("keyed").inputFiles())
    layout = store.state()[0]["keyed"]
    wanted = {r[0] for r in ids(spark, 5, 250).select(bucket_of(["id"], layout.buckets)).collect()}
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in found.inputFiles()} == wanted


def test_failed_write_leaves_the_old_version(spark, store):
    with store.change() as change:
        change.upsert("keyed", rows(spark, (1, "a"), (2, "b")))
    before, files = store.current(), sorted(os.listdir(os.path.join(store.path, "data")))
    broken = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        with store.change() as change:
            change.overwrite("keyed", rows(spark, (9, "z")))
            change.append("log", rows(spark, (1, "x")).withColumn("v", broken("v")))
    assert store.current() == before and {r["id"]: r["v"] for r in store.read("keyed").collect()} == {1: "a", 2: "b"}
    assert store.read("log").count() == 0 and sorted(os.listdir(os.path.join(store.path, "data"))) == files
    with store.change() as change:
        change.overwrite("keyed", store.read("keyed").unionByName(rows(spark, (3, "c"))))
    assert store.read("keyed").count() == 3
    with store.change() as change:
        change.clear("keyed")
    assert store.read("keyed").count() == 0


def test_late_writer_is_refused(spark, store):
    with pytest.raises(StaleVersion):
        with store.change() as late:
            late.upsert("keyed", rows(spark, (1, "late")))
            with store.change() as change:
                change.upsert("keyed", rows(spark, (1, "first")))
    assert [r["v"] for r in store.read("keyed").collect()] == ["first"]


def test_empty_changes(spark, store):
    assert store.read("keyed").count() == 0 and store.near("keyed", ids(spark, 1)).count() == 0
    with store.change() as change:
        change.upsert("keyed", rows(spark))
        change.delete("keyed", ids(spark))
        change.delete("keyed", ids(spark, 7))
    assert store.read("keyed").count() == 0
    with store.change() as change:
        change.upsert("keyed", rows(spark, (None, "n"), (None, "n"), (1, None)))
    assert sorted(map(str, (tuple(r) for r in store.read("keyed").collect()))) == ["(1, None)", "(None, 'n')"]


def test_splits_shuffle_nothing_and_exact_rows_shuffle_their_keys_only(spark, tmp_path, monkeypatch):
    """Buckets are split by the tasks that read them, without a copy; of a change's rows only those asked for reach the window."""
    from lodeseek.sources import store as S

    spec = Spec(T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())]), ("k",))
    store, labels, dealt = Store(spark, str(tmp_path / "s"), {"t": spec}, bucket_bytes=4_000), [], []
    monkeypatch.setattr(S, "stage", lambda df, label="stage", f=S.stage: labels.append(label) or f(df, label))
    monkeypatch.setattr(S.Change, "_put", lambda self, *a, f=S.Change._put, **b: dealt.append(b.get("dealt", True)) or f(self, *a, **b))
    rows = spark.range(600).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    for part in (rows.where("k < 300"), rows.where("k >= 300")):
        with store.change() as change:
            change.upsert("t", part, unique=True)
    assert False in dealt and "split" not in labels
    with store.change() as change:
        change.upsert("t", spark.createDataFrame([(5, "new")], "k long, v string"))
        keys = spark.createDataFrame([(5,), (7,), (10_000,)], "k long")
        found = {r["k"]: r["v"] for r in change.rows("t", keys, exact=True).collect()}
        assert set(found) == {5, 7} and found[5] == "new"
        change.delete("t", keys)
    assert store.read("t").count() == 598 and store.read("t").where("k in (5, 7)").isEmpty()
