"""Streaming results equal the batch results over the same table."""

from conftest import SMALL
import __spark_entry__ as E


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_stream_equals_batch(spark):
    q = E.queries()
    assert rows(q["stream_counters"](spark, SMALL)) == rows(q["run_counters"](spark, SMALL))
    assert rows(q["stream_state"](spark, SMALL)) == rows(q["latest_state"](spark, SMALL))
    d = q["stream_dedup"](spark, SMALL)
    assert d.count() == d.select("user_id").distinct().count()


def test_history_dedup_across_batches(spark, tmp_path):
    """Two files arriving in two micro-batches: keys already written in the
    first batch are not appended again by the second."""
    from almanac.streaming.ingest import dedup_history, file_stream
    src = tmp_path / "src"
    a = spark.createDataFrame([(1, 10), (2, 11), (1, 5)], "k long, t long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "k long, t long")
    a.coalesce(1).write.parquet(str(src / "a"))
    b.coalesce(1).write.parquet(str(src / "b"))
    s = file_stream(spark, str(src) + "/*", a.schema, max_files_per_trigger=1)
    dedup_history(s, "k", ["t"], str(tmp_path / "sink"), str(tmp_path / "ck"), columns=["t"], buckets=4)
    got = sorted((r["k"], r["t"]) for r in spark.read.parquet(str(tmp_path / "sink")).collect())
    # first seen wins across batches: key 2 keeps its batch-1 row although
    # batch 2 brings a smaller order value
    assert got == [(1, 5), (2, 11), (3, 2)]


def test_notice_stream_equals_batch(spark):
    q = E.queries()
    s = q["stream_notice_outcomes"](spark, SMALL)
    b = q["notice_outcomes"](spark, SMALL)
    assert rows(s) == rows(b)


def test_notice_stream_of_a_table_in_parts(spark, tmp_path):
    """The page table as a folder of part files gives the rows of one file."""
    from test_extract import GRADUATE, notice
    pages = spark.createDataFrame([(i, f"https://windsorstar.remembering.ca/obituary/{i}", notice(f"Ann{i}", "LEE", body=GRADUATE))
                                   for i in range(6)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "parts" / "pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "file" / "pages.parquet")
    query = E.queries()["stream_notice_outcomes"]
    got = rows(query(spark, str(tmp_path / "parts")))
    assert len(got) == 6 and got == rows(query(spark, str(tmp_path / "file")))


def test_notice_stream_replay_and_history(spark, tmp_path):
    """Second batch sees the first batch's records (duplicate); replaying a
    batch id overwrites its partition."""
    from almanac.streaming.ingest import file_stream, notices_stream
    from test_extract import GRADUATE, notice
    src = tmp_path / "src"
    a = spark.createDataFrame([("https://windsorstar.remembering.ca/obituary/a", notice("Ann", "LEE", body=GRADUATE))],
                              "url string, html string")
    a.coalesce(1).write.parquet(str(src / "1"))
    a.coalesce(1).write.parquet(str(src / "2"))
    sites = spark.createDataFrame([("windsorstar", "Windsor", "Ontario")], "subdomain string, city string, province string")
    gaz = spark.createDataFrame([("Windsor", "Ontario", 1.0, 2.0)], "city string, province string, latitude double, longitude double")
    stream = file_stream(spark, str(src) + "/*", a.schema, max_files_per_trigger=1)
    notices_stream(stream, str(tmp_path / "rec"), str(tmp_path / "out"), sites, gaz, str(tmp_path / "ck"))
    out = sorted((r["batch_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [(0, "saved"), (1, "duplicate")]
    assert spark.read.parquet(str(tmp_path / "rec")).count() == 1
