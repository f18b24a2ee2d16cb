"""Run ledger, state, attempts, tags."""

import datetime as dt

from pyspark.sql import functions as F

from almanac.operators import admit, curate, ledger


def test_counters(spark):
    rows = [(1, 1, "duplicate", None, None), (1, 2, "saved", None, None), (1, 3, "stopped", None, None),
            (1, 4, "error", "", None), (1, 5, None, None, True), (1, 6, None, None, None),
            (2, 1, "error", "boom", None)]
    df = spark.createDataFrame(rows, "run long, seq int, status string, error string, is_alumni boolean")
    got = {r["run"]: r for r in ledger.run_counters(df, "run", order=F.col("seq")).collect()}
    r1 = got[1]
    assert (r1["saved_count"], r1["duplicate_count"], r1["skipped_count"]) == (2, 1, 2)
    assert r1["error_message"] == "Obituary processing error."
    assert got[2]["error_message"] == "boom"


def test_state_and_runs(spark):
    ev = spark.createDataFrame([("s", "k", 1, "u1", "running", 1), ("s", "k", 2, "u2", "completed", 2)],
                               "subdomain string, search_keyword string, page_number int, last_processed_url string, "
                               "status string, updated_at int")
    r = ledger.latest_state(ev, ["subdomain", "search_keyword"], ["updated_at"]).first()
    assert (r["page_number"], r["status"]) == (2, "completed")
    runs = spark.createDataFrame(
        [(1, "running", dt.datetime(2026, 1, 1), None, None), (2, "running", dt.datetime(2026, 1, 2), None, "kept"),
         (3, "success", dt.datetime(2026, 1, 3), dt.datetime(2026, 1, 4), None)],
        "id long, status string, started_at timestamp, finished_at timestamp, error_message string")
    closed = {r["id"]: r for r in ledger.close_stale_runs(runs, "2026-02-01 00:00:00").collect()}
    assert closed[1]["status"] == "stopped" and closed[1]["error_message"].startswith("Marked stopped")
    assert closed[2]["error_message"] == "kept" and closed[3]["status"] == "success"
    assert ledger.latest_run(runs).first()["id"] == 3
    lab = spark.createDataFrame([("__listing__",), ("UWindsor",)], "k string").select(ledger.keyword_label("k").alias("l"))
    assert [r["l"] for r in lab.collect()] == ["Listing scan", "UWindsor"]


def test_attempts(spark):
    a = spark.createDataFrame([("u", 1, False, None, "e1"), ("u", 2, True, "saved", None),
                               ("v", 1, False, None, "e1"), ("v", 2, False, None, "e2"), ("v", 3, False, None, "e3"),
                               ("v", 4, True, "saved", None)],
                              "url string, attempt int, ok boolean, outcome string, error string")
    got = {r["url"]: r for r in admit.resolve_attempts(a, "url", "attempt", "ok", "outcome", "error").collect()}
    assert (got["u"]["status"], got["u"]["resolved_attempt"]) == ("saved", 2)
    assert (got["v"]["status"], got["v"]["message"]) == ("skipped", "e3")


def test_tags(spark):
    recs = spark.createDataFrame([(1, None), (2, "new"), (3, "updated")], "id long, tags string")
    ch = spark.createDataFrame([(1, 1, "updated"), (1, 2, "bad"), (2, 1, "updated"), (2, 2, "new")],
                               "id long, seq int, tags string")
    got = {r["id"]: r["tags"] for r in curate.apply_tag_changes(recs, ch, "id", ["seq"]).collect()}
    assert got == {1: "updated", 2: "new", 3: "updated"}
    _, rejected = curate.split_tag_changes(ch)
    assert rejected.count() == 1


def test_run_totals(spark):
    out = spark.createDataFrame([("saved", None, 1), ("skipped", None, 2), ("error", "boom", 3)],
                                "status string, error string, seq int")
    dups = spark.createDataFrame([("u1",), ("u2",)], "url string")
    skipped = spark.createDataFrame([("s", "k")], "site string, keyword string")
    r = ledger.run_totals(7, out, dups, skipped, order=F.col("seq")).first()
    assert (r["id"], r["status"], r["saved_count"], r["skipped_count"], r["duplicate_count"]) == (7, "success", 1, 3, 2)
    assert r["error_message"] == "boom"
    assert ledger.run_totals(8, duplicates=dups, stopped=True).first()["status"] == "stopped"
