"""The page stream equals the batch operator, whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.operators.frontier import repeated_pages
from almanac.sources.keyed import KeyedTable
from almanac.streaming.ingest import file_stream
from almanac.streaming.page_flow import repeated_pages_stream, stop_table

SCHEMA = "site string, page long, links array<string>"


def pages(seed, n=60):
    rng = random.Random(seed)
    lists = [["/a", "/b"], ["/b", "/a"], ["/c"], ["/d", "/e", "/f"], *[[f"/{i}"] for i in range(20)]]
    pick = lambda: rng.choice([None, []]) if rng.random() < 0.04 else rng.choice(lists)
    return [(s, p, pick()) for s in ("x", "y", "z") for p in range(1, n + 1)]


def land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def result(df):
    cols = ["site", "page", "n_links", "sighting", "is_repeat", "stop_reason", "read", "n_yielded"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("threshold", [1, 3])
def test_equals_the_batch_operator(spark, tmp_path, threshold):
    rows = pages(threshold) + [(None, 1, ["/a"]), (None, 2, ["/a"]), (None, 5, ["/a"])]
    random.Random(1).shuffle(rows)
    stops = stop_table(spark, str(tmp_path / "stops"), 4)
    for low, high in ((0, 10), (10, 11), (11, 40), (40, 99)):
        land(spark, [r for r in rows if low < r[1] <= high], str(tmp_path / "in"))
        stream = file_stream(spark, str(tmp_path / "in"), SCHEMA)
        repeated_pages_stream(stream, "site", "page", "links", stops, str(tmp_path / "out"), str(tmp_path / "ck"), threshold=threshold)
    got = result(spark.read.parquet(str(tmp_path / "out")))
    # The batch operator joins a null site with nothing; it is a site like others here.
    named = spark.createDataFrame([(s or "none", p, x) for s, p, x in rows], SCHEMA)
    want = result(repeated_pages(named, "site", "page", "links", threshold=threshold)
                  .withColumn("site", F.nullif("site", F.lit("none"))))
    assert got == want
    assert any(not r[6] for r in got) and any(r[4] for r in got)


def test_a_batch_done_again(spark, tmp_path, monkeypatch):
    stops = stop_table(spark, str(tmp_path / "stops"), 4)
    first = [("x", 1, ["/a"]), ("x", 2, ["/b"])]
    second = [("x", 3, ["/a"]), ("x", 4, ["/c"])]
    run = lambda: repeated_pages_stream(file_stream(spark, str(tmp_path / "in"), SCHEMA), "site", "page", "links", stops,
                                        str(tmp_path / "out"), str(tmp_path / "ck"), threshold=1)
    land(spark, first, str(tmp_path / "in"))
    run()
    land(spark, second, str(tmp_path / "in"))
    real = KeyedTable.upsert

    def dies(self, *a, **k):
        real(self, *a, **k)
        raise RuntimeError("lost")
    monkeypatch.setattr(KeyedTable, "upsert", dies)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    run()
    got = result(spark.read.parquet(str(tmp_path / "out")))
    assert got == result(repeated_pages(spark.createDataFrame(first + second, SCHEMA), "site", "page", "links", threshold=1))
    assert [(r[1], r[6]) for r in got] == [(1, True), (2, True), (3, True), (4, False)]
