"""Page extraction (Arrow extractor + column cascades) on notice markup."""

from almanac.sources.pages import page_fields


GRADUATE = "Ferry captain and graduate of the University of Windsor."


def notice(first="Ottilie", last="BRANDVOLD", published="May 4, 2025", body="Kept bees on the island. <i>Sang &amp; laughed.</i>"):
    return (f"<html><head><title>{first} {last.title()} Obituary | Harbour Gazette</title></head><body>"
            f'<span class="obit-fh">Quiet Bay Chapel</span>'
            f'<h1 class="obit-name">{first} {last}</h1><span class="obit-lastname-upper">{last}</span>'
            '<h2 class="obit-dates"><em>April 12, 1941</em><em>April 30, 2025</em></h2>'
            f'<div class="details-published">Published online {published}</div>'
            '<script>document.write("<span class=details-copy>hidden</span>")</script>'
            f'<span class="details-copy">{body}</span>'
            '<p><a href="/obituary/first">1</a> <a href="/about">2</a> <a href="/obituary/second">3</a>'
            ' <a href="/obituary/first">4</a></p></body></html>')


def fields(spark, pages):
    df = spark.createDataFrame(pages, "url string, html string")
    return {r["url"]: r.asDict() for r in page_fields(df).collect()}


def test_full_notice(spark):
    r = fields(spark, [("u1", notice())])["u1"]
    assert (r["first_name"], r["last_name"]) == ("Ottilie", "Brandvold")
    assert (r["birth_date"], r["death_date"]) == ("April 12, 1941", "April 30, 2025")
    assert r["publication_text"] == "May 04, 2025"
    assert r["body"] == "Kept bees on the island. Sang & laughed."
    assert r["funeral_home"] == "Quiet Bay Chapel"
    assert r["links"] == ["/obituary/first", "/obituary/second"] and r["error"] is None


def test_pages_are_read_a_few_at_a_time(spark):
    """A batch stays in Arrow's memory; a few of its pages are Python objects at once."""
    df = spark.createDataFrame([(f"u{i}", notice(first=f"Ann{i}") if i % 7 else None) for i in range(130)], "url string, html string").coalesce(1)
    out = page_fields(df)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = [(r.url, r.first_name) for r in out.collect()]
    assert got == [(f"u{i}", f"Ann{i}" if i % 7 else None) for i in range(130)]


def test_cascades(spark):
    pages = [
        ("testid", '<h1 data-testid="desktop-menu-fullname">Ines Marta Kolb</h1>'),
        ("title", "<title>Ines Marta Kolb Obituary | Harbour Gazette</title>"),
        ("article", "<article>Mended clocks for sixty years; died July 9, 2024.</article>"),
        ("empty", "<html><body></body></html>"),
    ]
    got = fields(spark, pages)
    for where in ("testid", "title"):
        assert (got[where]["first_name"], got[where]["last_name"]) == ("Ines Marta", "Kolb")
    assert got["article"]["body"] == "Mended clocks for sixty years; died July 9, 2024."
    assert got["article"]["death_date"] == "July 9, 2024"
    assert got["empty"]["body"] == "" and got["empty"]["first_name"] is None
    assert got["empty"]["publication_text"] is None and got["empty"]["funeral_home"] == "N/A"


def test_deep_markup_is_read(spark):
    deep = "<p>" * 5000 + "<article>Low tide</article>"
    r = fields(spark, [("deep", deep), ("plain", "<article>High tide</article>")])
    assert r["deep"]["body"] == "Low tide" and r["plain"]["body"] == "High tide"
    assert r["deep"]["error"] is None


def test_a_page_that_fails_is_its_own_error(spark, monkeypatch):
    from almanac.sources import pages as P

    def broken(url, html, prefix):
        raise ValueError("bad page")

    monkeypatch.setattr(P, "_raw_fields", broken)
    assert P._fields_or_error("u", "<p>", "/", 13)[-1] == "ValueError: bad page"


def test_link_forms(spark):
    from pyspark.sql import functions as F

    from almanac.functions import html as H
    page = ("<a data-href='/no' href='/a'>x</a><!-- <a href='/hidden'>x</a> --><a href=/b>x</a>"
            '<a class="k" href="/c?x=1&amp;y=2">x</a><abbr href="/d"></abbr>')
    got = spark.createDataFrame([(page,)], "h string").select(H.links(F.col("h")).alias("l")).first()["l"]
    assert got == ["/a", "/b", "/c?x=1&y=2"]
