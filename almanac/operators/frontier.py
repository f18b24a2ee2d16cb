"""J5 frontier: which candidate URLs a crawl plan processes.

The original walks sites, keywords and pages one by one and stops early on
several rules.  Here every rule is a set-based predicate over a table of
(site, keyword, page, position, url) rows, partitioned by the plan key, so
sites run in parallel and the order inside a plan key only shows up as an
ordering column.  Per-key "first/last/min" facts are aggregates (map-side
partial, skew-proof) joined back on the key; adaptive execution splits a
skewed join partition unless an aggregate on the same key follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..sources import fixed


def order_sites(sites: DataFrame, priority=None, target: str | None = None,
                col: str = "subdomain") -> DataFrame:
    """O4 + U4 + W11: distinct sites; with a target site only that one (or
    nothing); otherwise priority sites first in list order, then the rest by
    name.  ``priority_pos`` is the 1-based list position (NULL for the rest)."""
    s = sites.select(col).where(F.col(col).isNotNull()).distinct()
    if target:
        return s.where(F.col(col) == F.lit(target)).withColumn("priority_pos", F.lit(None).cast("int"))
    pr = F.array(*[F.lit(x) for x in (priority or fixed.PRIORITY_SUBDOMAINS)])
    pos = F.array_position(pr, F.col(col)).cast("int")
    return (s.withColumn("priority_pos", F.when(pos > 0, pos))
             .orderBy(F.asc_nulls_last("priority_pos"), F.asc(col)))


def stale_cut(cands: DataFrame, plan_key: list[str], page: str, pos: str, ts: str, as_of: str) -> DataFrame:
    """N2 + N5 + N6 + W15 (current-month mode) over candidate rows
    ``(plan_key..., page, pos, ts)``.

    Per page: undated rows drop (W15); rows sorted newest first (position
    breaks ties) are kept up to the first one outside the ``as_of`` month; a
    page whose cut leaves nothing, or that had to cut, stops the plan key.
    On page 1 a non-current *first-listed* row stops the key with nothing
    kept (N6).  Pages after the first stopping page are never read (N5).

    The first stale row of a page is the newest non-current row, so the
    prefix is "current and newer than it".  Whether a page stops its key, and
    where a key stops, follow from four facts per page, which are partial
    aggregates over one scan; they return to the rows by one join of a table
    of one row per page.  Returns the kept rows plus ``stop_page``."""
    pk = list(plan_key) + [page]
    cur = D.is_current_month(F.col(ts), as_of)
    dated = F.col(ts).isNotNull()
    rows = cands.withColumn("_cur", cur)
    facts = rows.groupBy(*pk).agg(
        F.max(F.when(dated & ~F.col("_cur"), F.col(ts))).alias("_stale_ts"),
        F.max(F.when(dated & F.col("_cur"), F.col(ts))).alias("_newest"),
        F.min_by("_cur", F.col(pos)).alias("_first_cur"))  # first listed row, dated or not
    stale = F.col("_stale_ts").isNotNull()
    facts = facts.withColumn("_gate", (F.col(page) == 1) & ~F.coalesce(F.col("_first_cur"), F.lit(False)))
    empty = F.col("_gate") | F.col("_newest").isNull() | (stale & (F.col("_newest") <= F.col("_stale_ts")))
    stops = facts.where(empty | stale).groupBy(*plan_key).agg(F.min(page).alias("stop_page"))
    open_pages = (facts.where(~empty).join(stops, list(plan_key), "left")
                       .where(F.col("stop_page").isNull() | (F.col(page) <= F.col("stop_page")))
                       .select(*pk, "_stale_ts", "stop_page"))
    kept = rows.join(open_pages, pk)
    kept = kept.where(dated & F.col("_cur") & (F.col("_stale_ts").isNull() | (F.col(ts) > F.col("_stale_ts"))))
    return kept.select(*cands.columns, "stop_page")


def repeated_pages(pages: DataFrame, site: str, page: str, links: str,
                   threshold: int = fixed.DEFAULT_REPEAT_THRESHOLD) -> DataFrame:
    """N3 + N5 + A12 (listing mode; N4 is ``threshold=1`` per keyword).

    A page with no links stops the site ('no_links').  A page whose ordered
    link list was seen on an earlier page of the site is a repeat and yields
    nothing; the repeat with count >= ``threshold`` (the threshold+1-th
    sighting) stops the site ('repeated_page').  Pages after the first
    stopping page are not read.

    Sighting numbers come from a top-(threshold+1) row_number per
    (site, signature); Catalyst runs that limit map-side, so a signature
    repeated a million times ships threshold+1 rows per task.  Every
    sighting past the limit is a stopping repeat, so the result is exact."""
    k = threshold + 1
    sig = F.sha2(F.concat_ws("\n", F.col(links)), 256)
    failed = F.col(links).isNull()  # the page could not be fetched
    # Everything after this needs the count and the signature only.
    p = pages.withColumn("_n_links", F.when(failed, 0).otherwise(F.size(links))).withColumn("_sig", F.when(F.col("_n_links") > 0, sig))
    p = p.withColumn("_failed", failed).drop(links)
    failed = F.col("_failed")
    w = Window.partitionBy(site, "_sig").orderBy(F.col(page))
    firsts = (p.where(F.col("_sig").isNotNull()).select(site, "_sig", page)
              .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k))
    p = p.join(firsts, [site, "_sig", page], "left")
    sighting = F.when(F.col("_sig").isNotNull(), F.coalesce(F.col("_rn"), F.lit(k + 1)))
    repeats = sighting - 1
    p = p.withColumn("sighting", sighting)
    stop_reason = (F.when(failed, F.lit(fixed.STOP_ERROR)).when(F.col("_n_links") == 0, F.lit(fixed.STOP_NO_LINKS))
                   .when(repeats >= threshold, F.lit(fixed.STOP_REPEATED)))
    p = p.withColumn("stop_reason", stop_reason)
    stops = p.where(F.col("stop_reason").isNotNull()).groupBy(site).agg(F.min(page).alias("stop_page"))
    p = p.join(stops, site, "left")
    read = F.col("stop_page").isNull() | (F.col(page) <= F.col("stop_page"))
    return p.select(
        *[c for c in pages.columns if c != links],
        F.col("_n_links").alias("n_links"),
        "sighting",
        F.coalesce(F.col("sighting") > 1, F.lit(False)).alias("is_repeat"),
        "stop_reason", read.alias("read"),
        F.when(read & (F.col("sighting") == 1), F.col("_n_links")).otherwise(F.lit(0)).alias("n_yielded"))


def resume_slice(cands: DataFrame, state: DataFrame, plan_key: list[str], page: str, order_col: str,
                 url_col: str, resume: bool = True, force: bool = False) -> DataFrame:
    """T6 + W13 + JN7 over candidate rows ``(plan_key..., page, order, url)``.

    ``state`` has one row per plan key with ``page_number``,
    ``last_processed_url`` and ``status``.  With resume on and force off:
    'completed' (and 'pagination_blocked') keys are skipped whole; a
    'running' state with page and URL drops earlier pages, keeps only the
    rows after that URL on its page when the URL is there, and keeps later
    pages whole.  The state table has one row per plan key."""
    if not resume or force:
        return cands
    st = state.select(*plan_key, F.col("page_number").alias("_sp"),
                      F.col("last_processed_url").alias("_su"), F.col("status").alias("_ss"))
    c = cands.join(st, list(plan_key), "left")
    done = F.coalesce(F.col("_ss").isin(fixed.STATE_COMPLETED, fixed.STATE_BLOCKED), F.lit(False))
    c = c.where(~done)
    # position of the resume URL on its page (a per-key fact, joined back)
    marks = (c.where((F.col(url_col) == F.col("_su")) & (F.col(page) == F.col("_sp")))
             .groupBy(*plan_key).agg(F.min(order_col).alias("_mark")))
    c = c.join(marks, list(plan_key), "left")
    active = (F.col("_ss") == fixed.STATE_RUNNING) & F.col("_sp").isNotNull() & \
        F.coalesce(F.col("_su") != "", F.lit(False))
    keep = (~F.coalesce(active, F.lit(False))
            | (F.col(page) > F.col("_sp"))
            | ((F.col(page) == F.col("_sp")) & (F.col("_mark").isNull() | (F.col(order_col) > F.col("_mark")))))
    return c.where(keep).drop("_sp", "_su", "_ss", "_mark")


def resume_start_page(state: DataFrame, site: str, resume: bool = True, force: bool = False) -> DataFrame:
    """Per site, the lowest page among 'running' states, else 1 (always
    1 with resume off or force on)."""
    if not resume or force:
        return state.select(site).distinct().withColumn("start_page", F.lit(1))
    running = (F.col("status") == fixed.STATE_RUNNING) & F.coalesce(F.col("page_number") > 0, F.lit(False))
    return state.groupBy(site).agg(
        F.coalesce(F.min(F.when(running, F.col("page_number"))), F.lit(1)).alias("start_page"))


def url_keywords(hits: DataFrame, url_col: str, keyword_col: str, active=None) -> DataFrame:
    """Per URL the sorted set of keywords that surfaced it, restricted to
    the active keywords.  Sets are bounded by the keyword list, and
    ``collect_set`` combines map-side."""
    h = hits.where(F.col(keyword_col).isin(*active)) if active is not None else hits
    return h.groupBy(url_col).agg(F.array_sort(F.collect_set(keyword_col)).alias("keywords"))


def search_url(site, keyword, page, base_domain: str = fixed.BASE_DOMAIN,
               limit: int = fixed.DEFAULT_PAGE_LIMIT):
    """F16: keyword-search page URL; '&p=n' only after page 1."""
    from ..functions.text import quote_plus
    base = F.concat(F.lit("https://"), site, F.lit(f".{base_domain}/obituaries/obituaries/search?limit={limit}"
                                                   "&search_type=advanced&ap_search_keyword="),
                    quote_plus(keyword), F.lit("&sort_by=date&order=desc"))
    return F.when(page > 1, F.concat(base, F.lit("&p="), page.cast("string"))).otherwise(base)


def listing_url(site, page, base_domain: str = fixed.BASE_DOMAIN, limit: int = fixed.DEFAULT_PAGE_LIMIT):
    """F16: listing page URL."""
    base = F.concat(F.lit("https://"), site, F.lit(f".{base_domain}/obituaries/obituaries/search?limit={limit}"))
    return F.when(page > 1, F.concat(base, F.lit("&p="), page.cast("string"))).otherwise(base)


def request_grid(sites: DataFrame, site: str, keywords, max_pages: int = fixed.DEFAULT_MAX_PAGES,
                 start_page=1, base_domain: str = fixed.BASE_DOMAIN) -> DataFrame:
    """JN9 + W14 + F16: every (site, keyword, page) request with
    ``start_page <= page <= max_pages``.  Generated per site row with two
    generators (no join), so it parallelises over the site table."""
    max_pages = max(1, int(max_pages))
    start = start_page if not isinstance(start_page, int) else F.lit(start_page)
    g = (sites.select(site, F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword"))
         .select(site, "keyword", F.explode(F.sequence(F.least(start, F.lit(max_pages)), F.lit(max_pages))).alias("page"))
         .where(F.col("page") >= start))
    return g.withColumn("search_url", search_url(F.col(site), F.col("keyword"), F.col("page"), base_domain)) \
            .withColumn("listing_url", listing_url(F.col(site), F.col("page"), base_domain))
