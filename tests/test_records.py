"""Options and the record flow over fetched notice pages."""

from almanac.operators.records import process_notices
from almanac.options import JobOptions
from almanac.sources.tables import RECORD_SCHEMA
from test_extract import GRADUATE, notice


def test_options_from_env():
    o = JobOptions.from_env({"SCRAPER_MODE": "listing_scan", "SCRAPER_SEARCH_KEYWORDS": "Alpha, Beta,, Gamma ",
                             "SCRAPER_INSTITUTION_KEYWORDS": "School A, School B",
                             "SCRAPER_STATUS_KEYWORDS": "graduate, degree", "SCRAPER_MATCH_WINDOW": "80",
                             "SCRAPER_CURRENT_MONTH_ONLY": "false", "SCRAPER_CITY": "WindsorStar",
                             "SCRAPER_REPEATED_PAGE_STOP_THRESHOLD": "0", "SCRAPER_MATCH_MODE": "bogus"})
    assert o.mode == "listing_scan" and o.search_keywords == ["Alpha", "Beta", "Gamma"]
    assert o.institution_keywords == ["School A", "School B"] and o.status_keywords == ["graduate", "degree"]
    assert (o.match_window, o.current_month_only, o.target_site) == (80, False, "windsorstar")
    assert o.repeat_threshold == 1 and o.match_mode == "proximity"
    assert o.alumni_keywords == ["Alpha", "Gamma", "Beta"]
    d = JobOptions.from_env({})
    assert (d.mode, d.max_pages, d.resume, d.force, d.current_month_only) == ("keyword_search", 2, True, False, True)


def test_process_notices(spark):
    pages = [
        ("https://windsorstar.remembering.ca/obituary/a", notice("Ann", "LEE", body=GRADUATE)),
        ("https://windsorstar.remembering.ca/obituary/b", notice("Bo", "KIM", body=GRADUATE)),
        ("https://nowhere.remembering.ca/obituary/c", notice("Cy", "DOE", body=GRADUATE)),
        ("https://windsorstar.remembering.ca/obituary/d", notice("Di", "RAY")),
        ("https://windsorstar.remembering.ca/obituary/e", "<p>no name here</p>"),
        ("https://windsorstar.remembering.ca/obituary/a", notice("Ann", "LEE", body=GRADUATE)),  # listed twice
    ]
    pdf = spark.createDataFrame(pages, "url string, html string")
    stored = spark.createDataFrame([], RECORD_SCHEMA).unionByName(spark.createDataFrame(
        [(7, "updated", "Bo Kim", "Bo", "Kim", None, None, None, "https://windsorstar.remembering.ca/obituary/b",
          None, None, True, None, None, None, None, None)] * 2, RECORD_SCHEMA))  # stored twice
    sites = spark.createDataFrame([("windsorstar", "Windsor", "Ontario")], "subdomain string, city string, province string")
    gaz = spark.createDataFrame([("Windsor", "Ontario", 1.0, 2.0)], "city string, province string, latitude double, longitude double")
    out, new = process_notices(pdf, stored, sites, gaz)
    got = sorted(((r["url"][-1], r["status"], r["reason"], r["tags"]) for r in out.collect()), key=str)
    assert got == [("a", "saved", None, "new"), ("a", "skipped", "already_visited", None),
                   ("b", "duplicate", "existing_url", "updated"), ("c", "skipped", "unknown_city", "new"),
                   ("d", "skipped", "no_alumni_keyword", "new"), ("e", "skipped", "missing_name", None)]
    (rec,) = new.collect()
    assert (rec["name"], rec["city"], rec["latitude"], rec["death_date"]) == ("Ann Lee", "Windsor", 1.0, "April 30, 2025")
    assert rec["publication_date"].year == 2025 and new.columns == [f.name for f in RECORD_SCHEMA.fields]


def _run(spark, pages, **more):
    sites = spark.createDataFrame([("windsorstar", "Windsor", "Ontario")], "subdomain string, city string, province string")
    gaz = spark.createDataFrame([("Windsor", "Ontario", 1.0, 2.0)], "city string, province string, latitude double, longitude double")
    df = spark.createDataFrame(pages, "url string, html string, position long")
    return process_notices(df, spark.createDataFrame([], RECORD_SCHEMA), sites, gaz, **more)


def test_first_sighting_by_position_and_stop(spark):
    u = "https://windsorstar.remembering.ca/obituary/"
    pages = [(u + "a", notice("Zoe", "LATE", body=GRADUATE), 9), (u + "a", notice("Ann", "LEE", body=GRADUATE), 1),
             (u + "a", notice("Bob", "NOWHEN", body=GRADUATE), None), (u + "b", notice("Bo", "KIM", body=GRADUATE), 20),
             (u + "b", notice("Bo", "KIM", body=GRADUATE), 30), (u + "c", None, 3), (u + "d", notice("Di", "RAY", body=GRADUATE), 19),
             (u + "d", notice("Di", "AGAIN", body=GRADUATE), 25), (None, notice("No", "URL"), 4), (None, "", 5)]
    out, new = _run(spark, pages, order_col="position", stop_at=20)
    got = sorted(((r["url"] or "-")[-1], r["status"], r["reason"] or "", r["name"] or "") for r in out.collect())
    assert got == [("-", "skipped", "already_visited", ""), ("-", "skipped", "no_alumni_keyword", "No Url"),
                   ("a", "saved", "", "Ann Lee"), ("a", "skipped", "already_visited", ""), ("a", "skipped", "already_visited", ""),
                   ("b", "stopped", "stop_requested", ""), ("b", "stopped", "stop_requested", ""),
                   ("c", "skipped", "missing_name", ""),
                   ("d", "saved", "", "Di Ray"), ("d", "stopped", "stop_requested", "")]
    assert sorted(r["name"] for r in new.collect()) == ["Ann Lee", "Di Ray"]
    assert _run(spark, pages[:0], order_col="position", stop_at=20)[0].count() == 0


def test_no_exchange_carries_html(spark, tmp_path):
    import re
    path = str(tmp_path / "pages")
    spark.createDataFrame([("https://windsorstar.remembering.ca/obituary/a", notice(), 1)],
                          "url string, html string, position long").write.parquet(path)
    sites = spark.createDataFrame([("windsorstar", "Windsor", "Ontario")], "subdomain string, city string, province string")
    gaz = spark.createDataFrame([("Windsor", "Ontario", 1.0, 2.0)], "city string, province string, latitude double, longitude double")
    out, _ = process_notices(spark.read.parquet(path), spark.createDataFrame([], RECORD_SCHEMA), sites, gaz,
                             order_col="position", stop_at=5)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any(re.search(r"\bhtml#", m) for m in moved)
    assert re.search(r"\(\d+\) WindowGroupLimit", plan)
