"""Crawl plans (listing scan and keyword search) on small fixtures."""

import datetime as dt


from almanac.operators.crawl import keyword_search_plan, listing_scan_plan

STATE = "subdomain string, search_keyword string, page_number int, last_processed_url string, status string"


def listing(spark, pages, state=(), existing=(), **kw):
    p = spark.createDataFrame(pages, "site string, page int, links array<string>")
    s = spark.createDataFrame(list(state), STATE)
    e = spark.createDataFrame([(u,) for u in existing], "url string")
    work, dups, end = listing_scan_plan(p, s, e, **kw)
    return (sorted((r["page"], r["url"]) for r in work.collect()), sorted(r["url"] for r in dups.collect()),
            {r["site"]: (r["page_number"], r["last_processed_url"], r["status"]) for r in end.collect()})


PAGES = [("s", 1, ["a", "b"]), ("s", 2, ["c"])]


def test_listing_once_and_state(spark):
    work, dups, end = listing(spark, PAGES, existing=["b"])
    assert work == [(1, "a"), (2, "c")] and dups == ["b"]
    assert end["s"] == (2, "c", "running")


def test_listing_completed_skip_and_force(spark):
    st = [("s", "__listing__", 2, "c", "completed")]
    work, _, end = listing(spark, PAGES, st)
    assert work == [] and end["s"] == (2, "c", "completed")
    work, _, _ = listing(spark, PAGES, st, force=True)
    assert work == [(1, "a"), (1, "b"), (2, "c")]


def test_listing_resume(spark):
    st = [("s", "__listing__", 1, "a", "running")]
    work, _, _ = listing(spark, PAGES, st)
    assert work == [(1, "b"), (2, "c")]
    work, _, _ = listing(spark, PAGES, st, resume=False)
    assert work == [(1, "a"), (1, "b"), (2, "c")]


def test_listing_repeated_page_blocks(spark):
    pages = [("s", 1, ["a", "b"]), ("s", 2, ["a", "b"]), ("s", 3, ["z"])]
    work, _, end = listing(spark, pages, threshold=1, max_pages=5)
    assert work == [(1, "a"), (1, "b")]
    assert end["s"] == (2, "b", "pagination_blocked")


def search(spark, pages, state=(), existing=(), **kw):
    p = spark.createDataFrame(pages, "site string, keyword string, page int, links array<string>")
    s = spark.createDataFrame(list(state), STATE)
    e = spark.createDataFrame([(u,) for u in existing], "url string")
    work, dups, end = keyword_search_plan(p, s, e, **kw)
    got = sorted((r["url"], r["page"], tuple(r["keywords"])) for r in work.unionByName(dups).collect())
    return got, sorted(r["url"] for r in dups.collect()), \
        {(r["site"], r["keyword"]): (r["page_number"], r["status"]) for r in end.collect()}


KW_PAGES = [("s", "A", 1, ["u1", "u2"]), ("s", "A", 2, ["u3", "u2"]),
            ("s", "B", 1, ["u2", "u4"]), ("s", "B", 2, [])]


def test_search_page_first_merge(spark):
    got, dups, end = search(spark, KW_PAGES, existing=["u4"])
    assert got == [("u1", 1, ("A",)), ("u2", 1, ("A", "B")), ("u3", 2, ("A",)), ("u4", 1, ("B",))]
    assert dups == ["u4"]
    assert end[("s", "B")] == (2, "completed") and end[("s", "A")] == (2, "running")


def test_search_completed_keyword_skipped(spark):
    got, _, end = search(spark, KW_PAGES, [("s", "B", 1, "u4", "completed")])
    assert [u for u, _, _ in got] == ["u1", "u2", "u3"] and end[("s", "B")][1] == "completed"


def test_search_current_month(spark):
    dates = spark.createDataFrame(
        [("u1", dt.datetime(2026, 6, 3)), ("u2", dt.datetime(2026, 6, 9)), ("u3", dt.datetime(2026, 5, 2)),
         ("u4", dt.datetime(2026, 6, 1))], "url string, publication_date timestamp")
    got, _, end = search(spark, KW_PAGES, url_dates=dates, as_of="2026-06-20")
    # A page 2: u3 is stale -> cut and stop; u2 was handled on page 1
    assert [u for u, _, _ in got] == ["u1", "u2", "u4"]
    assert end[("s", "A")] == (2, "completed")
