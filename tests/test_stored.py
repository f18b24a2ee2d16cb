"""Record stores, keyed tables, and streams that stop and go on."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators.admit import outcomes, split_existing
from almanac.session import child_paths
from almanac.sources.keyed import BUCKET, KeyedTable
from almanac.sources.store import RecordStore
from almanac.streaming import ingest
from test_plans import plan


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def urls(spark, a, b):
    return spark.range(a, b).select(F.concat(F.lit("u"), F.col("id")).alias("url"), F.col("id").alias("n"))


# ------------------------------------------------------------ record store --

@pytest.mark.parametrize("partitions", ["4", "64"])
@pytest.mark.parametrize("kind", ["new", "duplicates"])
def test_store_is_not_moved(spark, tmp_path, no_broadcast, kind, partitions):
    store = RecordStore(spark, str(tmp_path / "s"), urls(spark, 0, 1).schema, "url", 8)
    store.append(urls(spark, 0, 400))
    store.append(urls(spark, 400, 600))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        new, dup = split_existing(urls(spark, 500, 700), store.read(), "url")
        df = new if kind == "new" else dup
        p = plan(df)
        got = sorted(r.n for r in df.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == list(range(600, 700) if kind == "new" else range(500, 600))
    # One exchange, into the store's buckets: that of the candidates.
    assert p.count("Exchange hashpartitioning(url") == p.count("Exchange") == 1 and re.search(r"Exchange hashpartitioning\(url#\d+, 8\)", p)
    scan = [line for line in p.split("\n") if "records_" in line]
    assert len(scan) == 1 and "Bucketed: true" in scan[0] and "SelectedBucketsCount: 8 out of 8" in scan[0]


@pytest.mark.parametrize("kind", ["new", "duplicates"])
def test_stored_keys_are_not_broadcast(spark, tmp_path, kind):
    """Files of a few MB can hold millions of keys: no side goes through the driver."""
    urls(spark, 0, 600).write.parquet(str(tmp_path / "s"))
    asked = urls(spark, 500, 700).unionByName(spark.createDataFrame([(None, -1), ("u500", 500)], "url string, n long"))
    new, dup = split_existing(asked, spark.read.parquet(str(tmp_path / "s")), "url")
    df = new if kind == "new" else dup
    assert "Broadcast" not in plan(df)
    assert sorted(r.n for r in df.collect()) == ([-1, *range(600, 700)] if kind == "new" else [500, *range(500, 600)])


def test_outcome_join_leaves_the_store_in_place(spark, tmp_path, no_broadcast):
    stored = spark.createDataFrame([("u1", "Stored One", True, "new"), ("u2", "Stored Two", False, "updated"), ("u2", "Again", False, "new")],
                                   "url string, stored_name string, stored_is_alumni boolean, stored_tags string")
    store = RecordStore(spark, str(tmp_path / "s"), stored.schema, "url", 4)
    store.append(stored)
    candidates = spark.createDataFrame([("u1", "Ann", "Lee", "a keyword"), ("u3", "Bo", "Ray", "a keyword"), ("u2", None, "X", "keyword")],
                                       "url string, first_name string, last_name string, body string")
    sites = spark.createDataFrame([], "subdomain string, city string, province string")
    gaz = spark.createDataFrame([], "city string, province string, latitude double, longitude double")
    df = outcomes(candidates, store.read(), sites, gaz, mode="simple", keywords=["keyword"])
    assert sorted((r.url, r.status, r.name) for r in df.collect()) == [
        ("u1", "duplicate", "Stored One"), ("u2", "skipped", None), ("u3", "skipped", "Bo Ray")]
    assert not any("Exchange" in line and "_ex_key" in line for line in plan(df).split("\n"))


def test_store_is_attached_again_and_looked_up(spark, tmp_path, no_broadcast):
    path = str(tmp_path / "s")
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("n", T.LongType())])
    RecordStore(spark, path, schema, "url", 8).append(urls(spark, 0, 100).unionByName(spark.createDataFrame([(None, 7)], schema)))
    again = RecordStore(spark, path, schema, "url", 8)
    assert again.read().count() == 101
    found = again.lookup("u42")
    assert "SelectedBucketsCount: 1 out of 8" in plan(found) and [tuple(r) for r in found.collect()] == [("u42", 42)]
    assert again.lookup("u4200").collect() == []
    with pytest.raises(ValueError):
        RecordStore(spark, path, schema, "url", 16)
    with pytest.raises(ValueError):
        RecordStore(spark, path, schema, "n", 8)


def test_empty_store(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "s"), urls(spark, 0, 1).schema, "url", 4)
    assert store.read().count() == 0
    new, dup = split_existing(urls(spark, 0, 5), store.read(), "url")
    assert new.count() == 5 and dup.count() == 0


# ------------------------------------------------------------- keyed table --

STATE = "site string, word string, page long, at long, note string"


def state(spark, rows):
    return spark.createDataFrame(rows, STATE)


def files(spark, folder):
    return sorted(p for p in child_paths(spark, folder) if p.endswith(".parquet"))


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), state(spark, []).schema, ["site", "word"], ["at"], buckets=8)
    assert t.read().collect() == [] and t.version() == 0
    rows = [(f"s{i}", None if i % 7 == 0 else "w", i, i, "first") for i in range(60)]
    assert len(t.upsert(state(spark, rows))) == 8
    before = {b: (folder, files(spark, folder)) for b, folder in t.folders().items()}
    touched = t.upsert(state(spark, [("s1", "w", 100, 500, "newer"), ("s1", "w", 101, 400, "not the last"), ("s0", None, 5, -1, "older")]))
    assert 0 < len(touched) <= 2
    after = t.folders()
    for b, (folder, names) in before.items():
        assert (after[b] != folder) == (b in touched)
        assert names and files(spark, folder) == names  # old files too: a reader may still hold them
    want = {r[:2]: r for r in rows} | {("s1", "w"): ("s1", "w", 100, 500, "newer")}
    assert sorted(map(tuple, t.read().collect()), key=repr) == sorted(want.values(), key=repr)
    assert all(len(files(spark, folder)) == 1 for folder in after.values())


def test_reader_sees_whole_versions_and_dead_batches_leave_nothing(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), state(spark, []).schema, ["site"], ["at"], buckets=4)
    t.upsert(state(spark, [(f"s{i}", "w", 1, 1, "old") for i in range(20)]))
    held = t.read()
    real = spark.createDataFrame

    def dies(data, schema=None, *a, **k):  # after the rows are written, before the manifest is
        if schema is not None and "folder" in str(schema):
            raise RuntimeError("lost")
        return real(data, schema, *a, **k)
    changes = state(spark, [(f"s{i}", "w", 2, 2, "new") for i in range(10)])
    monkeypatch.setattr(spark, "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        t.upsert(changes)
    monkeypatch.undo()
    assert t.version() == 1 and {r.note for r in t.read().collect()} == {"old"}
    t.upsert(changes)
    assert sorted(r.note for r in t.read().collect()) == ["new"] * 10 + ["old"] * 10
    assert {r.note for r in held.collect()} == {"old"}  # a reader of the version before
    n = len(child_paths(spark, str(tmp_path / "t/rows")))
    assert n == 3 and len(t.vacuum(keep=1)) >= 2
    assert sorted(r.note for r in t.read().collect()) == ["new"] * 10 + ["old"] * 10


def test_lookup_reads_one_bucket(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), state(spark, []).schema, ["site", "word"], buckets=8)
    t.upsert(state(spark, [(f"s{i}", None, i, i, "") for i in range(50)]))
    found = t.lookup("s9", None)
    assert [r.page for r in found.collect()] == [9] and len(found.inputFiles()) == 1
    assert found.inputFiles()[0].split(f"{BUCKET}=")[1][0].isdigit()
    assert t.lookup("none", None).collect() == []


def test_replayed_batches_change_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), state(spark, []).schema, ["site"], buckets=4)
    one = state(spark, [("a", "w", 1, 1, "one")])
    t.upsert(one, 0, "x")
    t.upsert(state(spark, [("a", "w", 2, 2, "two")]), 1, "x")
    assert t.upsert(one, 0, "x") == [] and t.upsert(one, 1, "x") == []
    assert [r.note for r in t.read().collect()] == ["two"]
    t.upsert(state(spark, []), 2, "x")  # an empty batch is committed too
    assert t.upsert(one, 2, "x") == [] and t.version() == 3
    assert t.upsert(one, 0, "y") != []  # another writer's


# ------------------------------------------------------- stopped and resumed --

def source(spark, tmp_path, n=5):
    for i in range(n):
        spark.createDataFrame([(k, i * 10 + k) for k in range(4)], "k long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return ingest.file_stream(spark, str(tmp_path / "in"), "k long, v long", max_files_per_trigger=1)


def test_stopped_run_is_continued(spark, tmp_path):
    s = source(spark, tmp_path)
    sink, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ingest.append_batches(s, sink, ck, stop=ingest.batches_done(2))
    first = spark.read.parquet(sink)
    assert 2 <= first.select("batch_id").distinct().count() < 5
    before = {r.batch_id: r.n for r in first.groupBy("batch_id").agg(F.sum("v").alias("n")).collect()}
    ingest.append_batches(s, sink, ck)
    whole = spark.read.parquet(sink)
    assert sorted(r.v for r in whole.collect()) == sorted(i * 10 + k for i in range(5) for k in range(4))
    after = {r.batch_id: r.n for r in whole.groupBy("batch_id").agg(F.sum("v").alias("n")).collect()}
    assert len(after) > len(before) and all(after[b] == n for b, n in before.items())  # what was written stays
    ingest.append_batches(s, sink, ck)  # nothing is left
    assert spark.read.parquet(sink).count() == 20


def test_crash_after_the_write_before_the_commit(spark, tmp_path, monkeypatch):
    """The harshest place: the sink has the batch, the checkpoint does not."""
    s = source(spark, tmp_path)
    agg = s.groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    t = KeyedTable(spark, str(tmp_path / "t"), agg.schema, ["k"], buckets=4)
    real = KeyedTable.upsert

    def dies(self, changes, batch=None, writer=""):
        real(self, changes, batch, writer)
        if batch == 2:
            raise RuntimeError("lost")
    monkeypatch.setattr(KeyedTable, "upsert", dies)
    with pytest.raises(Exception, match="lost"):
        ingest.upsert_table(agg, t, str(tmp_path / "ck"))
    monkeypatch.undo()
    assert {r.n for r in t.read().collect()} == {3}
    version = t.version()
    ingest.upsert_table(agg, t, str(tmp_path / "ck"))
    assert sorted(map(tuple, t.read().collect())) == [(k, 100 + 5 * k, 5) for k in range(4)]
    assert t.version() == version + 2  # batches 3 and 4; batch 2 was known
