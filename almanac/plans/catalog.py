"""Query catalog: the operators bound to the corpus tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables.  Every computed column is aliased to the name used by the
matching SQL in :mod:`almanac.plans.oracle`.  Timestamps leave as
``yyyy-MM-dd``-style text and arrays as joined text so both engines render
identical values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import html as H
from ..functions import match as M
from ..functions import text as T
from ..operators import serve
from ..sources.tables import table

QUERIES = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


# ---------------------------------------------------------------- J7 serve --

def order_records(spark, sf):
    """orders as records: key = customer, date = order date, flag = finished."""
    o = table(spark, sf, "orders")
    return o.withColumn("flag", F.col("o_orderstatus") == "F")


def customer_records(spark, sf):
    """customer x nation x region as searchable records (city = nation,
    province = region)."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, F.col("n_regionkey") == r.r_regionkey, "left")
             .select("c_custkey", "c_name", "c_mktsegment", "c_acctbal",
                     F.col("n_name").alias("city"), F.col("r_name").alias("province"),
                     "n_nationkey", "n_regionkey",
                     F.concat_ws(" ", "c_name", "c_mktsegment", "n_name").alias("body"),
                     (F.col("c_acctbal") > 0).alias("flag")))


@register("latest_per_key")
def q_latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    recs = order_records(spark, sf)
    out = serve.latest_per_key(recs, key="o_custkey", ts="o_orderdate", id_col="o_orderkey", flag="flag")
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      _day("o_orderdate").alias("order_date"))


@register("faceted_search")
def q_faceted_search(spark, sf):
    recs = customer_records(spark, sf)
    out = serve.search(recs, first_name="customer#0000", city="a", query="build",
                       flag="flag", first_col="c_name", last_col="c_mktsegment",
                       city_col="city", province_col="province", body_col="body", id_col="c_custkey")
    return out.select("c_custkey", "c_name", "c_mktsegment", "city", "province")


@register("faceted_search_province")
def q_faceted_search_province(spark, sf):
    recs = customer_records(spark, sf)
    out = serve.search(recs, last_name="mobile", province="ASIA", flag="flag",
                       first_col="c_name", last_col="c_mktsegment", city_col="city",
                       province_col="province", body_col="body", id_col="c_custkey")
    return out.select("c_custkey", "c_name", "c_mktsegment", "city", "province")


@register("dashboard_counts")
def q_dashboard_counts(spark, sf):
    recs = customer_records(spark, sf).withColumn(
        "city", F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("city")))
    return serve.dashboard_counts(recs, name="c_mktsegment", city="city")


@register("year_buckets")
def q_year_buckets(spark, sf):
    o = table(spark, sf, "orders").withColumn("flag", F.col("o_orderpriority") != "5-LOW")
    return serve.year_buckets(o, as_of_year=2002, ts="o_orderdate", id_col="o_orderkey",
                              flag="flag", floor=1998)


@register("year_buckets_fixed")
def q_year_buckets_fixed(spark, sf):
    o = table(spark, sf, "orders").withColumn("flag", F.col("o_orderpriority") != "5-LOW")
    return serve.year_buckets(o, as_of_year=2000, ts="o_orderdate", id_col="o_orderkey",
                              flag="flag", floor=1996, fixed_years=[1996, 1997, 1998, 1999, 2000])


@register("year_bucket_rows")
def q_year_bucket_rows(spark, sf):
    o = table(spark, sf, "orders").withColumn("flag", F.col("o_orderpriority") != "5-LOW")
    out = serve.year_bucket_rows(o, ts="o_orderdate", id_col="o_orderkey", flag="flag", floor=1998)
    return out.select("bucket", "o_orderkey", _day("o_orderdate").alias("order_date"))


def _located(spark, sf):
    recs = customer_records(spark, sf)
    lat = F.when(F.col("c_acctbal") >= 0, F.col("n_nationkey") * 2.5 - 30.0)
    lon = F.when(F.col("c_acctbal") >= 0, F.col("n_regionkey") * 15.0 - 100.0)
    return recs.withColumn("latitude", lat.cast("double")).withColumn("longitude", lon.cast("double"))


@register("location_groups")
def q_location_groups(spark, sf):
    return serve.location_groups(_located(spark, sf), name="c_name", city="city", id_col="c_custkey")


@register("location_members")
def q_location_members(spark, sf):
    return serve.location_members(_located(spark, sf), name="c_name", id_col="c_custkey",
                                  columns=("c_name", "city", "province", "c_custkey"))


@register("location_bounds")
def q_location_bounds(spark, sf):
    g = serve.location_groups(_located(spark, sf), name="c_name", city="city", id_col="c_custkey")
    return serve.location_bounds(g)


# ------------------------------------------------------------- J2 match --

# Keyword sets for the corpus binding (job parameters, not fixed values).
DOC_SIMPLE_KEYWORDS = ["Apache License", "MIT License", "License", "secret", "password", "und", "les"]
DOC_INSTITUTIONS = ["MIT License", "Apache License", "GNU General Public License", "License"]
DOC_STATUSES = ["released", "licensed", "under the", "version", "the"]
DOC_WINDOW = 30


@register("keyword_hits_simple")
def q_keyword_hits_simple(spark, sf):
    d = M.with_simple_match(table(spark, sf, "documents"), "text", "m", DOC_SIMPLE_KEYWORDS)
    return d.select("doc_id", M.matching_keyword(F.col("m")).alias("keyword"),
                    M.is_match(F.col("m")).alias("is_match"))


@register("proximity_match")
def q_proximity_match(spark, sf):
    d = M.with_proximity_match(table(spark, sf, "documents"), "text", "m",
                               DOC_INSTITUTIONS, DOC_STATUSES, window=DOC_WINDOW)
    m = F.col("m")
    return d.select("doc_id", M.is_match(m).alias("is_match"),
                    m["institution"].alias("institution"), m["status"].alias("status"),
                    m["matched_text"].alias("matched_text"))


@register("keyword_occurrences")
def q_keyword_occurrences(spark, sf):
    """M1 flattened: one row per occurrence with code-point spans."""
    d = M.with_occurrences(table(spark, sf, "documents"), T.collapse_ws("text"),
                           DOC_INSTITUTIONS + DOC_STATUSES, "occ")
    # posexplode_outer + a filter on the generated column: a plain explode
    # makes the optimizer infer a size filter on the array and push it down
    # through (and inline) the staged span columns
    return (d.select("doc_id", F.posexplode_outer("occ").alias("pos", "o")).where(F.col("o").isNotNull())
             .select("doc_id", (F.col("pos") + 1).alias("ordinal"),
                     F.col("o.start").alias("start"), F.col("o.end").alias("end"),
                     F.col("o.keyword").alias("keyword")))


# ----------------------------------------------------------- J1 extract --

LINK_PREFIX = "/"
PRIORITY_SITES = ["m", "blog", "nosuchsite", "www"]
DISCOVERY_DOMAIN = "example.com"


def _page_links(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.posexplode(H.absolute_links("html", "url", LINK_PREFIX)).alias("pos", "link"))


@register("page_links")
def q_page_links(spark, sf):
    return _page_links(spark, sf).select("page_id", (F.col("pos") + 1).alias("position"), "link")


@register("distinct_links")
def q_distinct_links(spark, sf):
    """U1 across pages: first sighting (page, position) and page count per link."""
    l = _page_links(spark, sf)
    return (l.groupBy("link")
             .agg(F.min(F.struct("page_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n_pages"))
             .select("link", F.col("first.page_id").alias("first_page_id"),
                     (F.col("first.pos") + 1).alias("first_position"), "n_pages"))


@register("page_title_h1")
def q_page_title_h1(spark, sf):
    """P1 (title, h1) and the P3(b)/(c) name cascade: h1 split into two parts,
    else the title cut at ' Obituary'."""
    p = table(spark, sf, "pages").select(
        "page_id", H.element_text("html", "title").alias("title"), H.element_text("html", "h1").alias("h1"))
    b = T.split_name("h1")
    c = T.split_name(T.title_name("title"))
    use_b = b["first_name"].isNotNull() & b["last_name"].isNotNull()
    return p.select("page_id", "title", "h1",
                    F.when(use_b, b["first_name"]).otherwise(c["first_name"]).alias("first_name"),
                    F.when(use_b, b["last_name"]).otherwise(c["last_name"]).alias("last_name"))


@register("page_body")
def q_page_body(spark, sf):
    """P2 cascade over the leaf selectors the regex path supports."""
    p = table(spark, sf, "pages")
    return p.select("page_id", H.first_present(H.element_text("html", "article"),
                                               H.element_text("html", "main")).alias("body"))


@register("page_fields")
def q_page_fields(spark, sf):
    """The Arrow extractor with the full selector cascades."""
    from ..sources.pages import page_fields
    p = table(spark, sf, "pages")
    f = page_fields(p, "url", "html", LINK_PREFIX)
    return f.select("url", "first_name", "last_name", F.length("body").alias("body_chars"),
                    "death_date", "publication_text", "funeral_home", F.size("links").alias("n_links"))


def _site_dimension(pages):
    """Sites seen in the corpus (host label) with a derived city/province;
    labels shorter than five characters are left out, so they stay unknown."""
    lab = pages.select(T.host_label("url").alias("subdomain")).where(F.length("subdomain") >= 5).distinct()
    return lab.select("subdomain", F.upper("subdomain").alias("city"),
                      F.concat(F.lit("P"), (F.length("subdomain") % 5).cast("string")).alias("province"))


@register("site_lookup")
def q_site_lookup(spark, sf):
    """F15 + JN1: host label -> (city, province); unknown sites keep NULLs."""
    from ..operators.enrich import with_site
    p = table(spark, sf, "pages").select("page_id", "url")
    dim = _site_dimension(table(spark, sf, "pages"))
    return with_site(p, "url", dim).select("page_id", "subdomain", "city", "province")


@register("site_discovery")
def q_site_discovery(spark, sf):
    """P10: distinct subdomains of the base domain, sorted."""
    p = table(spark, sf, "pages")
    return (p.select(H.subdomain_of("url", DISCOVERY_DOMAIN).alias("subdomain"))
             .where(F.col("subdomain").isNotNull()).distinct().orderBy("subdomain"))


@register("site_order")
def q_site_order(spark, sf):
    """O4 + U4: priority sites first in list order, then the rest by name."""
    from ..operators.frontier import order_sites
    p = table(spark, sf, "pages")
    sites = p.select(T.host_label("url").alias("subdomain")).where(F.col("subdomain").isNotNull())
    return order_sites(sites, PRIORITY_SITES)


# --------------------------------------------------- F1-F13 text & dates --

# Date layouts used to write synthetic notice text from order dates: each
# exercises a different body-date pattern.
BODY_DATE_LAYOUTS = ["MMMM d, yyyy", "MMM d, yyyy", "M/d/yy", "M-d-yyyy", "MMMM d", "MMM d", "yyyy"]
PUBLICATION_AS_OF = "1998-06-15"
BODY_TERMS = ["license", "licence", "donation", "charity", "memorial fund", "contributions"]


def _notice_orders(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    layout = F.col("o_orderkey") % len(BODY_DATE_LAYOUTS)
    date_text = F.coalesce(*[F.when(layout == i, F.date_format(d, f)) for i, f in enumerate(BODY_DATE_LAYOUTS)])
    body = F.concat(F.lit("Notice "), F.col("o_orderkey").cast("string"), F.lit(": passed away "),
                    date_text, F.lit(". Customer "), F.col("o_custkey").cast("string"), F.lit("."))
    header = (F.when(F.col("o_orderpriority") == "1-URGENT",
                     F.array(F.lit("N/A"), F.date_format(d, "MMMM d, yyyy")))
              .when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit(" "), F.lit(""))))
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
                    body.alias("body"), header.alias("header"))


@register("death_date_text")
def q_death_date_text(spark, sf):
    """F3 + F4 + F5: date header when it has text, else the first body date
    (kept only after 2000)."""
    n = D.with_body_dates(_notice_orders(spark, sf), F.col("body"), F.col("header"))
    return n.select("o_orderkey", "candidate", "candidate_year", "birth_date", "death_date")


@register("publication_date")
def q_publication_date(spark, sf):
    """P7 + F2 + F6: first parseable publication candidate, its timestamp,
    and the current-month test against a fixed as-of date."""
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    c1 = F.when(F.col("o_orderstatus") == "P", F.lit("Published online soon")) \
        .otherwise(F.concat(F.lit("Published online "), F.date_format(d, "MMMM d, yyyy")))
    c2 = F.when(F.col("o_orderpriority") != "5-LOW", F.date_format(d, "yyyy-MM-dd"))
    cands = F.filter(F.array(c1, c2), lambda x: x.isNotNull())
    text = D.publication_date_from_candidates(cands)
    ts = D.publication_timestamp(text)
    return o.select("o_orderkey", text.alias("publication_text"), _day(ts).alias("publication_day"),
                    D.is_current_month(ts, PUBLICATION_AS_OF).alias("is_current"))


@register("sentence_filter")
def q_sentence_filter(spark, sf):
    """sentences mentioning any term, joined with '; '."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.sentence_filter("text", BODY_TERMS).alias("donation_information"))


def _named_documents(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("Ana Lee"), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 3
    body = (F.when(k == 0, F.concat(name, F.lit(" January 1, 1950 - June 1, 2026 "), name, F.lit(" "), name,
                                     F.lit(" Obituary Events Guestbook Share "), F.col("text")))
            .when(k == 1, F.concat(F.lit("Share "), name, F.lit(" Obituary "), F.col("text")))
            .otherwise(F.col("text")))
    return d.select("doc_id", name.alias("name"), body.alias("body"))


@register("clean_body")
def q_clean_body(spark, sf):
    """F10 + F11: display normalisation and header clean-up."""
    d = T.with_clean_body(_named_documents(spark, sf), "body", "name", "cleaned")
    return d.select("doc_id", "cleaned")


@register("paragraphs")
def q_paragraphs(spark, sf):
    """sentences paired into paragraphs."""
    d = T.with_paragraphs(_named_documents(spark, sf), "body", "name", "p")
    return d.select("doc_id", F.size("p").alias("n_paragraphs"), F.array_join("p", " || ").alias("paragraphs"))


@register("donation_items")
def q_donation_items(spark, sf):
    """F9 -> F13: the matched sentences split back into display items."""
    d = table(spark, sf, "documents").select(
        "doc_id", T.sentence_filter("text", BODY_TERMS).alias("donations"))
    d = T.with_donation_items(d, "donations", "items")
    return d.select("doc_id", F.size("items").alias("n_items"), F.array_join("items", " | ").alias("items"))


# ------------------------------------------------- J3/J4 enrich & admit --

def _doc_candidates(spark, sf):
    """documents as fetched notices: URL on the source's site, a name from
    the first words of the first line, the text as body."""
    d = table(spark, sf, "documents")
    first_line = F.substring_index(F.coalesce(F.col("text"), F.lit("")), "\n", 1)
    name_text = F.array_join(F.slice(F.split(T.collapse_ws(first_line), " ", -1), 1, 3), " ")
    nm = T.split_name(name_text)
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/doc/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", url.alias("url"), nm["first_name"].alias("first_name"),
                    nm["last_name"].alias("last_name"), F.col("text").alias("body"))


def _doc_sites(spark, sf):
    """Site dimension: one site per nation outside AFRICA."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey).where(F.col("r_name") != "AFRICA")
             .select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("subdomain"),
                     F.col("n_name").alias("city"), F.col("r_name").alias("province")))


def _gazetteer(spark, sf):
    """Gazetteer: coordinates for nations outside EUROPE (European cities miss)."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey).where(F.col("r_name") != "EUROPE")
             .select(F.col("n_name").alias("city"), F.col("r_name").alias("province"),
                     (F.col("n_nationkey") * 2.5 - 30.0).alias("latitude"),
                     (F.col("n_regionkey") * 15.0 - 100.0).alias("longitude")))


def _doc_existing(spark, sf):
    """Already stored records: the labelled documents."""
    l = table(spark, sf, "labels")
    return l.select("doc_id", F.concat(F.lit("Stored "), F.col("doc_id").cast("string")).alias("stored_name"),
                    (F.col("quality") == 1).alias("stored_is_alumni"),
                    F.when(F.col("toxic") == 1, F.lit("updated")).otherwise(F.lit("new")).alias("stored_tags"))


def _outcomes(spark, sf):
    from ..operators.admit import outcomes
    return outcomes(_doc_candidates(spark, sf), _doc_existing(spark, sf), _doc_sites(spark, sf),
                    _gazetteer(spark, sf), key="doc_id", url_col="url", body_col="body",
                    mode="simple", keywords=DOC_SIMPLE_KEYWORDS)


@register("outcomes")
def q_outcomes(spark, sf):
    """T1 + T2 + W12 + JN1/JN2/JN4: the record pipeline's outcome per notice."""
    return _outcomes(spark, sf).select(
        "doc_id", "url", "status", "reason", "name", "is_alumni", "institution",
        "city", "province", "latitude", "longitude", "tags")


@register("site_saved")
def q_site_saved(spark, sf):
    """A10: saved records per site city."""
    o = _outcomes(spark, sf)
    return o.groupBy("city").agg(F.count_if(F.col("status") == "saved").alias("saved_count"),
                                 F.count(F.lit(1)).alias("n_outcomes"))


@register("admit_new")
def q_admit_new(spark, sf):
    """JN3 anti join: candidates with no stored record."""
    from ..operators.admit import split_existing
    new, _ = split_existing(table(spark, sf, "documents").select("doc_id", "source"),
                            table(spark, sf, "labels"), "doc_id")
    return new


@register("admit_duplicates")
def q_admit_duplicates(spark, sf):
    """JN3 semi join: candidates that already have a record."""
    from ..operators.admit import split_existing
    _, dup = split_existing(table(spark, sf, "documents").select("doc_id", "source"),
                            table(spark, sf, "labels"), "doc_id")
    return dup


@register("dedup_by_text")
def q_dedup_by_text(spark, sf):
    """U3 by content: first document per distinct text and its copy count."""
    from ..operators.admit import first_per_value
    return first_per_value(table(spark, sf, "documents"), "text", "doc_id")


# ---------------------------------------------------------- J5 frontier --

STALE_AS_OF = "2001-07-20"


@register("stop_at_stale")
def q_stop_at_stale(spark, sf):
    """N2 + N5 + N6 + W15: orders as candidate pages of a customer's
    search (page = key mod 3 + 1), current-month mode."""
    from ..operators.frontier import stale_cut
    o = table(spark, sf, "orders")
    ts = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"),
                F.lit(None)).otherwise(F.col("o_orderdate"))
    c = o.select("o_custkey", ((F.col("o_orderkey") % 3) + 1).alias("page"), "o_orderkey", ts.alias("ts"))
    k = stale_cut(c, ["o_custkey"], "page", "o_orderkey", "ts", STALE_AS_OF)
    return k.select("o_custkey", "page", "o_orderkey", _day("ts").alias("order_date"), "stop_page")


REPEAT_THRESHOLD = 1


@register("repeated_pages")
def q_repeated_pages(spark, sf):
    """N3/N4 + N5 + A12: listing pages of a site (host label) in page order,
    with repeat sightings and the stop page."""
    from ..operators.frontier import repeated_pages
    p = table(spark, sf, "pages").select(
        "page_id", T.host_label("url").alias("site"), H.absolute_links("html", "url", LINK_PREFIX).alias("links"))
    return repeated_pages(p, "site", "page_id", "links", threshold=REPEAT_THRESHOLD)


def _event_pages(spark, sf):
    e = table(spark, sf, "events")
    url = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/obituary/"),
                   F.col("event_id").cast("string"))
    return e.select("user_id", F.dayofmonth("ts").alias("page"), "event_id", url.alias("url"),
                    "event_type", "value", "ts")


def _event_state(spark, sf):
    """Progress state per user: the last error event marks where a run
    stopped ('completed' when its value is high, else 'running'); for every
    state whose error value is below 10 the stored URL is no longer on the page."""
    e = _event_pages(spark, sf).where(F.col("event_type") == "error")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("page", "url", "value"), F.col("event_id")).alias("s"))
    url = F.when(F.col("s.value") < 10, F.lit("https://gone.example.com/x")).otherwise(F.col("s.url"))
    return last.select("user_id", F.col("s.page").alias("page_number"), url.alias("last_processed_url"),
                       F.when(F.col("s.value") > 45, F.lit("completed")).otherwise(F.lit("running")).alias("status"))


@register("resume_slice")
def q_resume_slice(spark, sf):
    """T6 + W13 + JN7: events as (user, day-page) candidate URLs resumed
    from the per-user state."""
    from ..operators.frontier import resume_slice
    c = _event_pages(spark, sf).select("user_id", "page", "event_id", "url")
    return resume_slice(c, _event_state(spark, sf), ["user_id"], "page", "event_id", "url") \
        .select("user_id", "page", "event_id")


@register("resume_start_page")
def q_resume_start_page(spark, sf):
    """Resume start page per site (site = user mod 7)."""
    from ..operators.frontier import resume_start_page
    s = _event_state(spark, sf).withColumn("site", (F.col("user_id") % 7).cast("int"))
    return resume_start_page(s, "site")


URL_KEYWORDS = ["the", "und", "les", "License", "secret"]
ACTIVE_KEYWORDS = ["the", "und", "les", "License"]


@register("url_keywords")
def q_url_keywords(spark, sf):
    """Keywords that surfaced each source, over all documents."""
    from ..operators.frontier import url_keywords
    d = table(spark, sf, "documents")
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    hits = d.select("source", F.explode(F.filter(F.array(*[F.lit(k) for k in URL_KEYWORDS]),
                                                 lambda k: F.contains(low, F.lower(k)))).alias("keyword"))
    u = url_keywords(hits, "source", "keyword", ACTIVE_KEYWORDS)
    return u.select("source", F.array_join("keywords", ",").alias("keywords"))


GRID_KEYWORDS = ["University of Windsor", "UWindsor", "Essex College"]


@register("request_grid")
def q_request_grid(spark, sf):
    """JN9 + W14 + F16: sites x keywords x pages request URLs."""
    from ..operators.frontier import request_grid
    sites = table(spark, sf, "nation").select(F.lower(F.replace("n_name", F.lit(" "), F.lit(""))).alias("site"))
    return request_grid(sites, "site", GRID_KEYWORDS, max_pages=2)


# ------------------------------------------------------------ J6 ledger --

def _event_outcomes(spark, sf):
    e = table(spark, sf, "events")
    status = (F.when(F.col("event_type") == "purchase", F.lit("saved"))
              .when(F.col("event_type") == "view", F.lit("skipped"))
              .when(F.col("event_type") == "click", F.lit("duplicate"))
              .when(F.col("event_type") == "error", F.lit("error"))
              .when(F.col("event_type") == "signup", F.lit("stopped")))
    return e.withColumn("status", status).withColumn("is_alumni", F.col("event_type") == "purchase")


@register("run_counters")
def q_run_counters(spark, sf):
    """A9 + T8: outcome counters and last error per run (run = user)."""
    from ..operators.ledger import run_counters
    o = _event_outcomes(spark, sf)
    return run_counters(o, "user_id", error="props", order=F.struct("ts", "event_id"))


@register("latest_state")
def q_latest_state(spark, sf):
    """T5 + T7: latest progress row per (site, keyword) = (user, event type)."""
    from ..operators.ledger import latest_state, state_from_reason
    e = _event_pages(spark, sf)
    reason = (F.when(F.col("event_type") == "error", F.lit("error"))
              .when(F.col("event_type") == "click", F.lit("repeated_page"))
              .when(F.col("event_type") == "purchase", F.lit("no_links")))
    ev = e.select("user_id", "event_type", "ts", "event_id",
                  F.floor("value").cast("int").alias("page_number"),
                  F.col("url").alias("last_processed_url"), state_from_reason(reason).alias("status"),
                  F.col("ts").alias("updated_at"))
    s = latest_state(ev, ["user_id", "event_type"], ["ts", "event_id"])
    return s.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


STALE_RUN_AS_OF = "2024-02-01 00:00:00"


def _event_runs(spark, sf):
    """Runs from events: one run per user; finished (at its last event) when
    the last event is a purchase or a view, else still open."""
    from ..operators.ledger import run_counters
    e = _event_outcomes(spark, sf)
    order = F.struct("ts", "event_id")
    runs = e.groupBy("user_id").agg(
        F.min("ts").alias("started_at"),
        F.when(F.max_by("event_type", order).isin("purchase", "view"), F.max("ts")).alias("finished_at"),
        F.max_by(F.when((F.col("event_type") == "error") & (F.col("value") > 40), F.col("props")),
                 F.when((F.col("event_type") == "error") & (F.col("value") > 40), order)).alias("error_message"),
        F.max_by("event_type", order).alias("_last_type"),
        F.max_by(F.floor("value").cast("int"), order).alias("page_number"))
    runs = runs.select(
        F.col("user_id").alias("id"),
        F.when(F.col("finished_at").isNull(), F.lit("running")).otherwise(F.lit("success")).alias("status"),
        "started_at", "finished_at",
        F.concat(F.lit("city"), (F.col("user_id") % 7).cast("string")).alias("city"),
        F.when(F.col("_last_type") == "view", F.lit("__listing__")).otherwise(F.col("_last_type")).alias("search_keyword"),
        "page_number", "error_message")
    counts = run_counters(e, "user_id", error="props", order=order).withColumnRenamed("user_id", "id") \
        .drop("error_message")
    return runs.join(counts, "id", "left")


@register("stale_runs")
def q_stale_runs(spark, sf):
    """Open runs closed as 'stopped' at a fixed as-of time."""
    from ..operators.ledger import close_stale_runs
    r = close_stale_runs(_event_runs(spark, sf), STALE_RUN_AS_OF)
    return r.select("id", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
                    F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"), "error_message")


@register("latest_run")
def q_latest_run(spark, sf):
    """O3 + S9: the newest run, projected with its label."""
    from ..operators.ledger import latest_run, project_run
    return project_run(latest_run(_event_runs(spark, sf)))


@register("attempts")
def q_attempts(spark, sf):
    """Per URL (user) the first three tries decide; an error is a failed try."""
    from pyspark.sql import Window
    from ..operators.admit import resolve_attempts
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = (e.withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= 3)
          .withColumn("ok", F.col("event_type") != "error"))
    return resolve_attempts(a, "user_id", "attempt", "ok", "event_type", "props")


# ---------------------------------------------------- J8/J9 export, curate --

def _order_records(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(n, F.col("c_nationkey") == n.n_nationkey, "left")
          .join(r, F.col("n_regionkey") == r.r_regionkey, "left"))
    nm = T.split_name(F.concat_ws(" ", "c_mktsegment", "c_name"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"),
        nm["first_name"].alias("first_name"), nm["last_name"].alias("last_name"),
        F.lit(None).cast("string").alias("birth_date"),
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("death_date"),
        F.col("o_orderdate").alias("publication_date"),
        F.col("n_name").alias("city"), F.col("r_name").alias("province"),
        F.lit("N/A").alias("funeral_home"),
        F.concat(F.lit("https://example.com/obituary/"), F.col("o_orderkey").cast("string")).alias("obituary_url"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("updated")).otherwise(F.lit("new")).alias("tags"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_orderstatus") == "F").alias("is_alumni"),
        F.when(F.col("r_name") != "EUROPE", F.col("n_nationkey") * 2.5 - 30.0).alias("latitude"),
        F.when(F.col("r_name") != "EUROPE", F.col("n_regionkey") * 15.0 - 100.0).alias("longitude"),
        F.concat(F.lit("  Order\t"), F.col("o_orderpriority"), F.lit("  for\n "), F.col("c_name"), F.lit(" ")).alias("family_information"),
        F.lit("").alias("donation_information"))


@register("csv_rows")
def q_csv_rows(spark, sf):
    """F14 + O2: the CSV cells of flagged records, newest first."""
    from ..operators.export import csv_rows
    return csv_rows(_order_records(spark, sf))


@register("tag_updates")
def q_tag_updates(spark, sf):
    """T11 + W10 + JN8 + S10: tags after the last valid change per customer."""
    from ..operators.curate import apply_tag_changes
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise(F.lit("new")).alias("tags"))
    o = table(spark, sf, "orders")
    ch = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey",
                  F.when(F.col("o_orderstatus") == "F", F.lit("updated"))
                   .when(F.col("o_orderstatus") == "O", F.lit("new")).otherwise(F.lit("archived")).alias("tags"))
    return apply_tag_changes(c, ch, "c_custkey", ["o_orderdate", "o_orderkey"])


# ------------------------------------------------------- J10 streaming --
# Each call runs its stream to completion (availableNow) into a fresh folder
# under the shared checkpoint folder and returns the sink table.

def _events_stream(spark, sf):
    from ..streaming.ingest import file_stream
    return file_stream(spark, f"{sf.rstrip('/')}/{{events.parquet}}", table(spark, sf, "events").schema)


@register("stream_dedup")
def q_stream_dedup(spark, sf):
    """R1 + R2: first event per user across the whole stream history."""
    from ..streaming.ingest import dedup_history, new_run_dir
    d = new_run_dir(spark, "dedup")
    s = _events_stream(spark, sf).select("user_id", "ts", "event_id")
    dedup_history(s, "user_id", ["ts", "event_id"], f"{d}/sink", f"{d}/checkpoint", columns=["ts", "event_id"])
    out = spark.read.parquet(f"{d}/sink").drop("_kb")
    return out.select("user_id", F.col("event_id").alias("first_event_id"),
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@register("stream_dedup_watermark")
def q_stream_dedup_watermark(spark, sf):
    """R2 within a bounded delay (state kept for one hour of event time)."""
    from ..streaming.ingest import dedup_within_watermark, new_run_dir
    d = new_run_dir(spark, "dedupwm")
    s = dedup_within_watermark(_events_stream(spark, sf).select("user_id", "ts"), "user_id", "ts", "1 hour")
    q = (s.writeStream.format("parquet").option("path", f"{d}/sink")
          .option("checkpointLocation", f"{d}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{d}/sink").select("user_id")


@register("stream_counters")
def q_stream_counters(spark, sf):
    """Running outcome counters per run, complete mode."""
    from ..operators.ledger import run_counters
    from ..streaming.ingest import complete_table, new_run_dir
    d = new_run_dir(spark, "counters")
    e = _events_stream(spark, sf)
    status = (F.when(F.col("event_type") == "purchase", F.lit("saved"))
              .when(F.col("event_type") == "view", F.lit("skipped"))
              .when(F.col("event_type") == "click", F.lit("duplicate"))
              .when(F.col("event_type") == "error", F.lit("error"))
              .when(F.col("event_type") == "signup", F.lit("stopped")))
    e = e.withColumn("status", status).withColumn("is_alumni", F.col("event_type") == "purchase")
    agg = run_counters(e, "user_id", error="props", order=F.struct("ts", "event_id"))
    complete_table(agg, f"{d}/sink", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/sink")


@register("stream_state")
def q_stream_state(spark, sf):
    """Latest progress row per key, complete mode."""
    from ..operators.ledger import latest_state, state_from_reason
    from ..streaming.ingest import complete_table, new_run_dir
    d = new_run_dir(spark, "state")
    e = _events_stream(spark, sf)
    url = F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/obituary/"),
                   F.col("event_id").cast("string"))
    reason = (F.when(F.col("event_type") == "error", F.lit("error"))
              .when(F.col("event_type") == "click", F.lit("repeated_page"))
              .when(F.col("event_type") == "purchase", F.lit("no_links")))
    ev = e.select("user_id", "event_type", "ts", "event_id", F.floor("value").cast("int").alias("page_number"),
                  url.alias("last_processed_url"), state_from_reason(reason).alias("status"),
                  F.col("ts").alias("updated_at"))
    complete_table(latest_state(ev, ["user_id", "event_type"], ["ts", "event_id"]), f"{d}/sink", f"{d}/checkpoint")
    return spark.read.parquet(f"{d}/sink").withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


# ------------------------------------------------- T3/T4/T12 crawl plans --



def _plan_pages(spark, sf):
    """pages as fetched listing/search result pages: site = host label,
    keyword = the page language, page number = page id, links = P9.
    Written once to the shared checkpoint folder (as J1 output would be),
    so each plan reads extracted links instead of re-parsing the HTML."""
    from ..session import cut_lineage
    p = table(spark, sf, "pages")
    return cut_lineage(p.select(T.host_label("url").alias("site"),
                                F.regexp_extract("html", r'<html[^>]*\slang="([^"]*)"', 1).alias("keyword"),
                                F.col("page_id").alias("page"),
                                H.absolute_links("html", "url", LINK_PREFIX).alias("links")))


def _plan_existing(pages):
    """Stored records: every link URL listed on two or more pages."""
    l = pages.select("page", F.explode("links").alias("url"))
    return l.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("url")


def _plan_state(pages, keys, keyword_value=None):
    """Prior progress per plan key: completed when the site label length is
    a multiple of 5, else running after the first link of the key's first
    page when the label length is even; no row otherwise."""
    first = pages.groupBy(*keys).agg(F.min("page").alias("page_number"))
    firsts = first.join(pages.select(*keys, F.col("page").alias("page_number"), "links"), keys + ["page_number"])
    n = F.length("site")
    status = F.when(n % 5 == 0, F.lit("completed")).when(n % 2 == 0, F.lit("running"))
    kw = F.lit(keyword_value) if keyword_value is not None else F.col("keyword")
    return firsts.select(F.col("site").alias("subdomain"), kw.alias("search_keyword"), "page_number",
                         F.element_at("links", 1).alias("last_processed_url"), status.alias("status")) \
        .where(F.col("status").isNotNull())


def _listing_plan(spark, sf):
    from ..operators.crawl import listing_scan_plan
    all_pages = _plan_pages(spark, sf)
    pages = all_pages.where(F.col("site").isNotNull()).drop("keyword")
    state = _plan_state(pages, ["site"], "__listing__")
    return listing_scan_plan(pages, state, _plan_existing(all_pages), max_pages=None, threshold=1)


@register("listing_plan_work")
def q_listing_plan_work(spark, sf):
    """T4 + T12: URLs the listing scan hands on (new work and duplicates)."""
    work, dups, _ = _listing_plan(spark, sf)
    return (work.withColumn("kind", F.lit("new")).unionByName(dups.withColumn("kind", F.lit("duplicate")))
                .select("site", "page", "pos", "url", "kind"))


@register("listing_plan_state")
def q_listing_plan_state(spark, sf):
    """T4 + T7: listing-scan progress per site after the run."""
    _, _, state = _listing_plan(spark, sf)
    return state


def _search_plan(spark, sf):
    from ..operators.crawl import keyword_search_plan
    all_pages = _plan_pages(spark, sf)
    pages = all_pages.where(F.col("site").isNotNull())
    state = _plan_state(pages, ["site", "keyword"])
    return keyword_search_plan(pages, state, _plan_existing(all_pages), max_pages=None)


@register("search_plan_work")
def q_search_plan_work(spark, sf):
    """T3 + A8 + T12: URLs the keyword search hands on, page-first, with the
    keywords that surfaced them."""
    work, dups, _ = _search_plan(spark, sf)
    both = work.withColumn("kind", F.lit("new")).unionByName(dups.withColumn("kind", F.lit("duplicate")))
    return both.select("site", "url", "page", "pos", F.array_join("keywords", ",").alias("keywords"), "kind")


@register("search_plan_state")
def q_search_plan_state(spark, sf):
    """Keyword-search progress per (site, keyword) after the run."""
    _, _, state = _search_plan(spark, sf)
    return state


@register("notice_outcomes")
def q_notice_outcomes(spark, sf):
    """T1 + T12 over fetched pages: Arrow extraction, simple-mode matching
    with the corpus keywords, site/gazetteer enrichment, existing-record
    check against the records already stored (the saved rows of the
    document outcomes, by URL).  Rows-only: the extractor has no SQL form."""
    from ..operators.records import process_notices
    from ..options import JobOptions
    pages = table(spark, sf, "pages").select("url", "html")
    dim = _site_dimension(table(spark, sf, "pages"))
    gaz = dim.select("city", "province", (F.length("city") * 1.5).alias("latitude"),
                     (F.length("province") * -2.0).alias("longitude"))
    stored = _outcomes(spark, sf).where("status = 'saved'").select(
        F.col("url").alias("obituary_url"), "name", "is_alumni", "tags")
    opts = JobOptions(match_mode="simple", alumni_keywords=DOC_SIMPLE_KEYWORDS)
    out, _ = process_notices(pages, stored, dim, gaz, opts, link_prefix=LINK_PREFIX)
    return out


@register("stream_notice_outcomes")
def q_stream_notice_outcomes(spark, sf):
    """J10 record flow: pages arriving as a file stream, processed per batch
    by the same plan as ``notice_outcomes``.  Rows-only (HTML extractor)."""
    from ..options import JobOptions
    from ..streaming.ingest import file_stream, new_run_dir, notices_stream
    d = new_run_dir(spark, "notices")
    pages = table(spark, sf, "pages")
    # The table may be one file or a folder of parts.  A source takes a file by a pattern only.
    stream = file_stream(spark, f"{sf.rstrip('/')}/{{pages.parquet}}", pages.schema).select("url", "html")
    dim = _site_dimension(pages)
    gaz = dim.select("city", "province", (F.length("city") * 1.5).alias("latitude"),
                     (F.length("province") * -2.0).alias("longitude"))
    opts = JobOptions(match_mode="simple", alumni_keywords=DOC_SIMPLE_KEYWORDS)
    notices_stream(stream, f"{d}/records", f"{d}/outcomes", dim, gaz, f"{d}/checkpoint", opts, LINK_PREFIX)
    return spark.read.parquet(f"{d}/outcomes").drop("batch_id")


@register("serving_copy")
def q_serving_copy(spark, sf):
    """U5 derived serving table: one row per URL (the lowest id) from a
    record table whose URLs repeat (orders, URL per customer)."""
    from ..operators.admit import serving_copy
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("https://example.com/c/"), F.col("o_custkey").cast("string")).alias("obituary_url"),
        "o_orderstatus", _day("o_orderdate").alias("order_date"))
    return serving_copy(o).select("obituary_url", "id", "o_orderstatus", "order_date")


@register("record_lookup")
def q_record_lookup(spark, sf):
    """One record by id."""
    recs = customer_records(spark, sf)
    return serve.point_lookup(recs, 7, id_col="c_custkey").select("c_custkey", "c_name", "city", "province")


@register("target_site")
def q_target_site(spark, sf):
    """A run limited to one site."""
    from ..operators.frontier import order_sites
    p = table(spark, sf, "pages")
    sites = p.select(T.host_label("url").alias("subdomain")).where(F.col("subdomain").isNotNull())
    return order_sites(sites, PRIORITY_SITES, target="www")


@register("json_records")
def q_json_records(spark, sf):
    """The public projection with dates as ISO text."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"),
        F.col("o_orderdate").cast("timestamp").alias("publication_date"), F.col("o_orderpriority").alias("tags"))
    return serve.json_projection(o, ["id", "name", "publication_date", "tags"])


@register("custom_keyword_hits")
def q_custom_keyword_hits(spark, sf):
    """S6 + M5: a job's own keyword list, given as comma-separated text."""
    from ..sources.fixed import parse_keyword_list
    words = parse_keyword_list(" apache license , ,mit license,that ", [])
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = M.with_alumni_match(d, "text", "m", "simple", keywords=words)
    return out.where("m IS NOT NULL").select("doc_id", F.col("m.institution").alias("keyword"))


@register("appended_records")
def q_appended_records(spark, sf):
    """S2 + JN3: append the admitted orders to a record table twice; the
    second run admits nothing, so the table holds each URL once."""
    import uuid

    from ..operators.admit import split_existing
    from ..session import shared_path
    from ..sources.tables import RECORD_SCHEMA, append_records, read_records
    path = shared_path(spark, f"records-{uuid.uuid4().hex}")
    o = table(spark, sf, "orders")
    given = {"id": F.col("o_orderkey"), "name": F.col("o_orderstatus"), "is_alumni": F.lit(True),
             "obituary_url": F.concat(F.lit("https://example.com/o/"), F.col("o_orderkey").cast("string"))}
    recs = o.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA.fields])
    append_records(recs.where("name = 'F'"), path)
    for _ in range(2):
        new, _dup = split_existing(recs, read_records(spark, path), "obituary_url")
        append_records(new, path)
    return read_records(spark, path).select("id", "name", "obituary_url")
