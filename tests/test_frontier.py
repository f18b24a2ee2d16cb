"""Crawl-plan predicates: links, repeats, stale cut, resume."""

from pyspark.sql import functions as F

from almanac.functions import html as H
from almanac.operators import frontier as FR


def test_links_dedup_in_order(spark):
    html = '<a href="/obituary/a">1</a><a class="x" href="/obituary/b">2</a><a href="/obituary/a">3</a><a href="/o">4</a>'
    df = spark.createDataFrame([("https://site.remembering.ca/list", html)], "url string, html string")
    r = df.select(H.absolute_links("html", "url", "/obituary/").alias("l")).first()["l"]
    assert r == ["https://site.remembering.ca/obituary/a", "https://site.remembering.ca/obituary/b"]


def test_repeated_listing_pages(spark):
    rows = [("s", 1, ["a", "b"]), ("s", 2, ["a", "b"]), ("s", 3, ["c"]), ("s", 4, ["a", "b"]),
            ("s", 5, ["a", "b"]), ("s", 6, ["d"]), ("t", 1, []), ("t", 2, ["e"])]
    df = spark.createDataFrame(rows, "site string, page int, links array<string>")
    got = {(r["site"], r["page"]): r for r in FR.repeated_pages(df, "site", "page", "links", threshold=3).collect()}
    assert [got[("s", p)]["n_yielded"] for p in range(1, 7)] == [2, 0, 1, 0, 0, 0]
    assert got[("s", 5)]["stop_reason"] == "repeated_page" and not got[("s", 6)]["read"]
    assert got[("t", 1)]["stop_reason"] == "no_links" and not got[("t", 2)]["read"]
    one = {(r["site"], r["page"]): r for r in FR.repeated_pages(df, "site", "page", "links", threshold=1).collect()}
    assert one[("s", 2)]["stop_reason"] == "repeated_page" and not one[("s", 3)]["read"]


def test_stale_cut(spark):
    rows = [("k", 1, 1, "2026-06-20"), ("k", 1, 2, "2026-06-25"), ("k", 1, 3, "2026-05-30"), ("k", 1, 4, "2026-06-01"),
            ("k", 2, 1, "2026-06-03"),
            ("f", 1, 1, "2026-06-02"), ("f", 1, 2, "2026-07-01"),
            ("g", 1, 1, "2026-05-01"), ("g", 1, 2, "2026-06-05"),
            ("h", 1, 1, "2026-06-09"), ("h", 1, 2, None), ("h", 2, 1, "2026-06-08")]
    df = spark.createDataFrame(rows, "k string, page int, pos int, d string").withColumn("ts", F.to_timestamp("d"))
    got = sorted((r["k"], r["page"], r["pos"]) for r in FR.stale_cut(df, ["k"], "page", "pos", "ts", "2026-06-15").collect())
    # k: newest first 25, 20, 01, then May 30 (stale) cuts; page 1 stops, page 2 never read
    # f: a future row at the head empties the page; g: first listed row on page 1 is stale
    # h: undated row dropped, nothing stale: pages 1 and 2 both read
    assert got == [("h", 1, 1), ("h", 2, 1), ("k", 1, 1), ("k", 1, 2), ("k", 1, 4)]


def test_resume(spark):
    cands = spark.createDataFrame(
        [("s", 1, 1, "u1"), ("s", 1, 2, "u2"), ("s", 1, 3, "u3"), ("s", 2, 1, "u4"),
         ("c", 1, 1, "v1"), ("n", 1, 1, "w1"), ("m", 1, 1, "z1"), ("m", 1, 2, "z2")],
        "site string, page int, pos int, url string")
    state = spark.createDataFrame(
        [("s", 1, "u2", "running"), ("c", 1, "v1", "completed"), ("m", 1, "gone", "running")],
        "site string, page_number int, last_processed_url string, status string")
    got = sorted(r["url"] for r in FR.resume_slice(cands, state, ["site"], "page", "pos", "url").collect())
    assert got == ["u3", "u4", "w1", "z1", "z2"]
    assert sorted(r["url"] for r in FR.resume_slice(cands, state, ["site"], "page", "pos", "url", resume=False).collect()) \
        == sorted(r["url"] for r in cands.collect())
    sp = {r["site"]: r["start_page"] for r in FR.resume_start_page(state, "site").collect()}
    assert sp == {"s": 1, "c": 1, "m": 1}


def test_site_order_and_grid(spark):
    sites = spark.createDataFrame([("lfpress",), ("aaa",), ("windsorstar",), ("zzz",), ("aaa",)], "subdomain string")
    assert [r["subdomain"] for r in FR.order_sites(sites).collect()] == ["windsorstar", "lfpress", "aaa", "zzz"]
    assert [r["subdomain"] for r in FR.order_sites(sites, target="zzz").collect()] == ["zzz"]
    g = FR.request_grid(sites.distinct().where("subdomain = 'aaa'"), "subdomain", ["Essex College"], max_pages=2)
    urls = sorted(r["search_url"] for r in g.collect())
    assert urls[0].endswith("ap_search_keyword=Essex+College&sort_by=date&order=desc")
    assert urls[1].endswith("&p=2")
