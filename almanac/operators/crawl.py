"""The two crawl plans over every site at once.

The original walks one site after another and, per site, page after page.
Here a plan is one DataFrame job over the table of fetched listing/search
pages, parallel across sites (and keywords); the ordered stop rules of a
site are per-key aggregates joined back (see :mod:`.frontier`).

Stage boundaries are cut with a reliable checkpoint in the shared
checkpoint folder: the stop rules join per-key facts back onto their own
input, and without the cut every such step would copy the whole upstream
plan into both join sides.  The cut keeps plans linear and lets a run
resume from the last stage after losing executors.

Each plan returns three frames:

* ``work``: URLs to fetch and process, with the page and position that
  surfaced them first (and, in keyword mode, the set of keywords);
* ``duplicates``: URLs that already have a record (counted, not fetched);
* ``state``: the end progress row per plan key (page, last URL, status).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..session import cut_lineage
from ..sources import fixed
from . import frontier as FR
from .ledger import state_from_reason


def _explode_urls(pages: DataFrame, keys: list[str], page: str, urls: str) -> DataFrame:
    return pages.select(*keys, page, F.posexplode(urls).alias("pos", "url"))


def _first_sighting(rows: DataFrame, keys: list[str], page: str) -> DataFrame:
    """U3 inside a run: each URL once per run key, at its first (page, pos);
    a partial aggregate (min of a struct), so a URL listed on every page does
    not gather in one task."""
    first = rows.groupBy(*keys, "url").agg(F.min(F.struct(F.col(page).alias("p"), F.col("pos").alias("q"))).alias("_f"))
    return first.select(*keys, "url", F.col("_f.p").alias(page), F.col("_f.q").alias("pos"))


def _end_state(processed: DataFrame, stops: DataFrame, old_state: DataFrame, keys: list[str], page: str,
               stop_status=None) -> DataFrame:
    """State after the run: the last processed URL (in page, position
    order) and its page; a stopped key takes the stop page and the status
    of its stop reason; keys without news keep their old row."""
    last = processed.groupBy(*keys).agg(
        F.max(F.struct(F.col(page).alias("p"), F.col("pos").alias("q"), F.col("url").alias("u"))).alias("_l"))
    old = old_state.select(*keys, F.col("page_number").alias("_op"), F.col("last_processed_url").alias("_ou"),
                           F.col("status").alias("_os"))
    s = old.join(stops, keys, "full").join(last, keys, "full")
    status = stop_status if stop_status is not None else state_from_reason(F.col("stop_reason"))
    stopped = F.col("stop_page").isNotNull()
    news = F.col("_l").isNotNull()
    return s.select(
        *keys,
        F.when(stopped, F.col("stop_page")).otherwise(F.coalesce(F.col("_l.p"), F.col("_op"))).alias("page_number"),
        F.coalesce(F.col("_l.u"), F.col("_ou")).alias("last_processed_url"),
        F.when(stopped, status).when(news, F.lit(fixed.STATE_RUNNING))
         .otherwise(F.coalesce(F.col("_os"), F.lit(fixed.STATE_RUNNING))).alias("status"))


def listing_scan_plan(pages: DataFrame, state: DataFrame, existing: DataFrame, *, site: str = "site",
                      page: str = "page", links: str = "links", url_col: str = "url",
                      max_pages: int | None = fixed.DEFAULT_MAX_PAGES, threshold: int = fixed.DEFAULT_REPEAT_THRESHOLD,
                      resume: bool = True, force: bool = False):
    """T4 + T14 + T12.  ``pages``: (site, page, links) with links already
    absolute and distinct (P9).  ``state``: crawl state rows (subdomain =
    site, search_keyword '__listing__').  ``existing``: stored records with
    ``url_col``.

    Order of rules: completed/blocked sites are skipped (W13); the resume
    start page (A11) applies *before* repeat counting, as earlier pages are
    never fetched; repeats and empty pages stop the site (N3, N5); the resume
    slice (T6) applies on the remaining pages; each URL once (U3); existing
    URLs are duplicates (JN3)."""
    st = (state.where(F.col("search_keyword") == fixed.LISTING_STATE_KEYWORD)
          .select(F.col("subdomain").alias(site), "page_number", "last_processed_url", "status"))
    p = pages.select(site, page, links)
    if resume and not force:
        done = st.where(F.col("status").isin(fixed.STATE_COMPLETED, fixed.STATE_BLOCKED)).select(site)
        p = p.join(done, site, "left_anti")
        start = FR.resume_start_page(st, site)
        p = p.join(start, site, "left").where(F.col(page) >= F.coalesce(F.col("start_page"), F.lit(1))).drop("start_page")
    p = cut_lineage(p if max_pages is None else p.where(F.col(page) <= max_pages))
    scanned = cut_lineage(FR.repeated_pages(p, site, page, links, threshold))
    stops = (scanned.where(F.col("stop_reason").isNotNull())
             .groupBy(site).agg(F.min(F.struct(F.col(page).alias("p"), F.col("stop_reason").alias("r"))).alias("_s"))
             .select(site, F.col("_s.p").alias("stop_page"), F.col("_s.r").alias("stop_reason")))
    yielding = scanned.where(F.col("n_yielded") > 0).select(site, page)
    rows = _explode_urls(p.join(yielding, [site, page], "left_semi"), [site], page, links)
    if resume and not force:
        rows = FR.resume_slice(rows, st, [site], page, "pos", "url")
    rows = cut_lineage(_first_sighting(rows, [site], page))
    ex = existing.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    work = rows.join(ex, "url", "left_anti")
    dups = rows.join(ex, "url", "left_semi")
    end = _end_state(rows, stops, st, [site], page)
    return work, dups, end


def keyword_search_plan(pages: DataFrame, state: DataFrame, existing: DataFrame, *, site: str = "site",
                        keyword: str = "keyword", page: str = "page", links: str = "links",
                        url_col: str = "url", url_dates: DataFrame | None = None, as_of: str | None = None,
                        max_pages: int | None = fixed.DEFAULT_MAX_PAGES, resume: bool = True, force: bool = False):
    """T3 + T13 + T15 + T12.  ``pages``: (site, keyword, page, links).
    Optional current-month mode: ``url_dates`` (url, publication_date) and
    ``as_of`` apply N6, W15 and N2 per page.

    Completed keywords are skipped (W13); pages start at the site's resume
    start page (A11) and each keyword also skips pages before its own
    running state's page; an empty page or a repeated link list stops the
    keyword (N4); pages after a keyword's stop page are not read (N5); the
    resume slice (T6) applies per keyword; pages are processed page-first,
    so a URL is handled once, at its first page, with the set of keywords
    that surfaced it there (A8); existing URLs are duplicates (JN3).  A
    stopped keyword ends 'completed'."""
    keys = [site, keyword]
    st = state.select(F.col("subdomain").alias(site), F.col("search_keyword").alias(keyword),
                      "page_number", "last_processed_url", "status")
    p = pages.select(site, keyword, page, links)
    if resume and not force:
        done = st.where(F.col("status") == fixed.STATE_COMPLETED).select(*keys)
        p = p.join(done, keys, "left_anti")
        active_states = st.join(done, keys, "left_anti")
        start = FR.resume_start_page(active_states, site)
        own = active_states.where(F.col("status") == fixed.STATE_RUNNING).select(*keys, F.col("page_number").alias("_own"))
        p = (p.join(start, site, "left").join(own, keys, "left")
             .where((F.col(page) >= F.coalesce(F.col("start_page"), F.lit(1)))
                    & (F.col(page) >= F.coalesce(F.col("_own"), F.lit(1))))
             .drop("start_page", "_own"))
    if max_pages is not None:
        p = p.where(F.col(page) <= max_pages)
    # Per (site, keyword) a repeated link list stops the keyword
    p = cut_lineage(p.withColumn("_kw_site", F.concat_ws("\u0000", F.col(site), F.col(keyword))))
    scanned = FR.repeated_pages(p.select("_kw_site", site, keyword, page, links), "_kw_site", page, links, 1)
    scanned = cut_lineage(scanned.drop("_kw_site"))
    rows = _explode_urls(p.join(scanned.where(F.col("n_yielded") > 0).select(*keys, page), keys + [page], "left_semi"),
                         keys, page, links)
    stop_pages = scanned.where(F.col("stop_reason").isNotNull()).select(*keys, page)
    if url_dates is not None and as_of is not None:
        n4 = stop_pages.groupBy(*keys).agg(F.min(page).alias("stop_page"))
        rows, month_stops = _month_pages(rows, n4, url_dates, url_col, as_of, st, keys, site, page,
                                         resume and not force)
        stops = stop_pages.unionByName(month_stops).groupBy(*keys).agg(F.min(page).alias("stop_page"))
    else:
        stops = stop_pages.groupBy(*keys).agg(F.min(page).alias("stop_page"))
        rows = rows.join(stops, keys, "left").where(F.col("stop_page").isNull() | (F.col(page) <= F.col("stop_page"))) \
            .drop("stop_page")
        rows = cut_lineage(rows)
        if resume and not force:
            rows = cut_lineage(FR.resume_slice(rows, st, keys, page, "pos", "url"))
    # page-first: a URL is handled at its first page over all keywords of the site
    first_page = rows.groupBy(site, "url").agg(F.min(page).alias("_fp"))
    at_first = cut_lineage(rows.join(first_page, [site, "url"]).where(F.col(page) == F.col("_fp")).drop("_fp"))
    merged = at_first.groupBy(site, "url").agg(
        F.min(page).alias(page), F.min(F.struct(F.col(keyword), F.col("pos"))).alias("_first"),
        F.array_sort(F.collect_set(keyword)).alias("keywords"))
    merged = merged.select(site, "url", page, F.col("_first.pos").alias("pos"), "keywords")
    ex = existing.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    work = merged.join(ex, "url", "left_anti")
    dups = merged.join(ex, "url", "left_semi")
    processed = at_first.select(*keys, page, "pos", "url")
    end = _end_state(processed, stops.withColumn("stop_reason", F.lit(None).cast("string")), st, keys, page,
                     stop_status=F.lit(fixed.STATE_COMPLETED))
    return work, dups, end


def _month_pages(rows: DataFrame, n4_stops: DataFrame, url_dates: DataFrame, url_col: str, as_of: str,
                 st: DataFrame, keys: list[str], site: str, page: str, resume: bool):
    """Current-month mode (N6, W15, N2) page by page.

    A URL already handled on an earlier page of the site is dropped *before*
    a page is sorted by date, so whether a page is cut depends on what the
    earlier pages yielded: the pages are evaluated in order, one distributed
    step per page number, each step over all sites and keywords at once,
    with the visited set and the retired keys carried as tables (lineage cut
    per step).  There is no cap on pages: the steps end after the last page
    that any key still reads."""
    dated = rows.join(url_dates.select(F.col(url_col).alias("url"), F.col("publication_date").alias("_ts")),
                      "url", "left")
    dated = dated.join(n4_stops, keys, "left").where(F.col("stop_page").isNull() | (F.col(page) <= F.col("stop_page")))
    dated = cut_lineage(dated.drop("stop_page").withColumn("_cur", D.is_current_month(F.col("_ts"), as_of)))
    reading_now = dated.select(*keys, page)
    n = dated.agg(F.min(page)).first()[0]
    visited = retired = None
    yielded, stops = [], []
    while n is not None:
        cur = dated.where(F.col(page) == n)
        if retired is not None:
            cur = cur.join(retired, keys, "left_anti")
        cand = cur if visited is None else cur.join(visited, [site, "url"], "left_anti")
        cand = cand.where(F.col("_ts").isNotNull())
        stale = cand.where(~F.col("_cur")).groupBy(*keys).agg(F.max("_ts").alias("_stale_ts"))
        kept = (cand.join(stale, keys, "left")
                .where(F.col("_cur") & (F.col("_stale_ts").isNull() | (F.col("_ts") > F.col("_stale_ts")))))
        reading = cur.select(*keys).distinct()
        stop = reading.join(stale.select(*keys), keys, "left_semi").unionByName(
            reading.join(kept.select(*keys).distinct(), keys, "left_anti"))
        if n == 1:  # N6: the first listed URL of page 1 must be current
            gate = cur.groupBy(*keys).agg(F.min_by("_cur", "pos").alias("_first_cur")) \
                .where(~F.coalesce(F.col("_first_cur"), F.lit(False))).select(*keys)
            kept = kept.join(gate, keys, "left_anti")
            stop = stop.unionByName(gate)
        kept = kept.select(*keys, page, "pos", "url")
        if resume:
            kept = FR.resume_slice(kept, st, keys, page, "pos", "url")
        kept = cut_lineage(kept)
        stop = cut_lineage(stop.distinct())
        yielded.append(kept)
        stops.append(stop.withColumn(page, F.lit(n).cast(dated.schema[page].dataType)))
        new_seen = kept.select(site, "url")
        visited = cut_lineage((new_seen if visited is None else visited.unionByName(new_seen)).distinct())
        retired = stop if retired is None else cut_lineage(retired.unionByName(stop).distinct())
        n = reading_now.where(F.col(page) > n).join(retired, keys, "left_anti").agg(F.min(page)).first()[0]
    empty_rows = dated.select(*keys, page, "pos", "url").where(F.lit(False))
    empty_stops = dated.select(*keys, page).where(F.lit(False))
    out_rows = empty_rows
    for y in yielded:
        out_rows = out_rows.unionByName(y)
    out_stops = empty_stops
    for x in stops:
        out_stops = out_stops.unionByName(x.select(*keys, page))
    return cut_lineage(out_rows), cut_lineage(out_stops)
