"""Text and date expressions."""

from pyspark.sql import functions as F

from almanac.functions import dates as D
from almanac.functions import text as T


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_split_name(spark):
    r = one(spark, T.split_name(F.col("v")), "  Berit   Ann VANDERLUND Obituary ")
    assert (r["first_name"], r["last_name"]) == ("Berit Ann", "Vanderlund")
    r = one(spark, T.split_name(F.col("v")), "Plato")
    assert r["first_name"] is None and r["last_name"] is None
    r = one(spark, T.split_name(T.title_name(F.col("v"))), "Ines Marta Kolb Obituary | Harbour Gazette")
    assert (r["first_name"], r["last_name"]) == ("Ines Marta", "Kolb")


def test_paragraphs_remove_header_noise(spark):
    body = ("Ines KolbMay 2, 1940-July 9, 2024"
            "Ines KolbObituaryEventsGuestbookShare"
            "Ines Kolb ObituaryThe shop bell rang all day. "
            "Clocks came from three counties.Tea was at four.")
    df = spark.createDataFrame([(body, "Ines Kolb")], "b string, n string")
    p = T.with_paragraphs(df, "b", "n", "p").first()["p"]
    assert p[0] == "The shop bell rang all day. Clocks came from three counties."
    assert p[1] == "Tea was at four."


def test_donation_items(spark):
    df = spark.createDataFrame([("Charity of your choice.; Contributions to the lifeboat.",), ("N/A",), (None,)], "d string")
    got = [r["i"] for r in T.with_donation_items(df, "d", "i").collect()]
    assert got == [["Charity of your choice", "Contributions to the lifeboat"], [], []]


def test_sentence_filter(spark):
    r = one(spark, T.sentence_filter(F.col("v")),
            "He was kind. Donations to the Heart Fund. Memorial Fund gifts welcome. Thanks")
    assert r == "Donations to the Heart Fund; Memorial Fund gifts welcome"


def test_year_and_body_dates(spark):
    cases = {"June 12": 2012, "5/6/99": 2099, "March 3, 1999": 1999, "nothing": None, "01-02-2024": 2024}
    for text, year in cases.items():
        assert one(spark, D.year_from_text(F.col("v")), text) == year
    df = spark.createDataFrame([("Died June 12 at home, born 1950.",), ("Died June 5.",),
                                ("On 5/6/99 she left",), ("Born March 3, 1931; died 2024",)], "b string")
    got = [r["death_date"] for r in D.with_body_dates(df, F.col("b")).collect()]
    assert got == ["June 12", None, "5/6/99", None]


def test_publication_date_candidates(spark):
    df = spark.createDataFrame([(["Published online soon", "2026-06-01"],), (["Published on June 10, 2026"],),
                                (["nope"],)], "c array<string>")
    got = [r["p"] for r in df.select(D.publication_date_from_candidates(F.col("c")).alias("p")).collect()]
    assert got == ["June 01, 2026", "June 10, 2026", None]


def test_display_normalize_and_host(spark):
    assert one(spark, T.display_normalize(F.col("v")), " He left.Then  we metSam ") == "He left. Then we met Sam"
    assert one(spark, T.host_label(F.col("v")), "https://WindsorStar.remembering.ca/obituary/x") == "windsorstar"
    assert one(spark, T.host_label(F.col("v")), "not a url") is None
    assert one(spark, T.quote_plus(F.col("v")), "a b~c*d") == "a+b~c%2Ad"


def test_dates_as_sites_write_them(spark):
    cases = {"Published online\n June 10,\n 2026": "June 10, 2026", "Published in The Lamp on June 10, 2026": "June 10, 2026",
             "June 10th, 2026": "June 10, 2026", "2026-06-10T08:00:00.000Z": "June 10, 2026", "jun. 3 2024 at noon": "June 03, 2024",
             "soon": None}
    for text, want in cases.items():
        assert one(spark, D.canonical_date(D.strip_published(F.col("v"))), text) == want, text


def test_no_break_space_in_a_body_date(spark):
    assert one(spark, D.first_body_date(F.col("v")), "Left us June\u00a01, 2026.") == "June\u00a01, 2026"
