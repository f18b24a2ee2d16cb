"""T1/T12 over fetched record pages: extract (J1) -> match (J2) -> admit
(J4) -> enrich (J3) as one lazy plan, producing the outcome per URL and the
record rows to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import JobOptions
from ..sources import fixed
from ..sources.pages import page_fields
from .admit import outcomes


def process_notices(record_pages: DataFrame, records: DataFrame, sites: DataFrame, gazetteer: DataFrame,
                    options: JobOptions | None = None, url_col: str = "url", html_col: str = "html",
                    link_prefix: str = fixed.RECORD_LINK_PREFIX,
                    order_col: str | None = None, stop_at=None):
    """Returns ``(outcome_rows, new_records)``.

    ``record_pages``: fetched notice pages (url, html); ``records``: the
    stored record table (``obituary_url``, ``name``, ``is_alumni``, ``tags``);
    ``sites``/``gazetteer``: dimensions.  New records carry the full record
    schema; their id is a hash of the URL (stable across runs).

    ``order_col`` tells which of a URL's sightings is the first (nulls last;
    ties, and pages without such a column, by a hash of the page).  A stop
    requested at position ``stop_at`` of it turns every sighting from there on
    into ``stopped`` / ``stop_requested``, unread; one without a position is
    read.  No pages give no rows; null HTML is a page without fields, and rows
    with a null URL are sightings of one unknown URL."""
    o = options or JobOptions()
    order = F.col(order_col) if order_col else F.lit(0)
    pages = record_pages.select(url_col, html_col, order.alias("_order"), F.xxhash64(html_col).alias("_digest"))
    halted = F.coalesce(F.col("_order") >= stop_at, F.lit(False)) if stop_at is not None else F.lit(False)
    read = pages.where(~halted)
    # In-run visited rule: a URL counts once, at its first sighting; the later ones are skipped.
    # Fields are taken where the page lies, so no exchange carries HTML, and of a URL's
    # sightings one row a task is shuffled.
    again = (read.groupBy(url_col).agg(F.count(F.lit(1)).alias("_sightings")).where("_sightings > 1")
                 .select(url_col, F.explode(F.sequence(F.lit(2).cast("long"), "_sightings")).alias("_n")))
    sighting = Window.partitionBy(url_col).orderBy(F.col("_order").asc_nulls_last(), "_digest")
    f = (page_fields(read, url_col, html_col, link_prefix, keep=("_order", "_digest"))
         .withColumn("_sighting", F.row_number().over(sighting)).where("_sighting = 1")
         .drop("_sighting", "_order", "_digest"))
    existing = records.select(F.col("obituary_url").alias(url_col), F.col("name").alias("stored_name"),
                              F.col("is_alumni").alias("stored_is_alumni"), F.col("tags").alias("stored_tags"))
    out = outcomes(f, existing, sites, gazetteer, key=url_col, url_col=url_col, body_col="body",
                   mode=o.match_mode, institutions=o.institution_keywords, statuses=o.status_keywords,
                   keywords=o.alumni_keywords, window=o.match_window, error_col="error")
    saved = out.where(F.col("status") == fixed.SAVED)
    new_records = saved.select(
        F.xxhash64(url_col).alias("id"), F.lit(fixed.DEFAULT_TAG).alias("tags"),
        T.full_name(F.col("first_name"), F.col("last_name")).alias("name"), "first_name", "last_name",
        "birth_date", "death_date", F.col("publication_date").cast("timestamp").alias("publication_date"),
        F.col(url_col).alias("obituary_url"), F.col("body").alias("family_information"),
        T.sentence_filter(F.col("body")).alias("donation_information"),
        F.lit(True).alias("is_alumni"), "city", "province", "funeral_home", "latitude", "longitude")
    columns = (url_col, "status", "reason", "name", "is_alumni", "institution", "publication_text",
               "tags", "city", "province", "error")
    first = out.select(*columns)
    none = [F.lit(None).cast(first.schema[c].dataType).alias(c) for c in columns[3:]]

    def unread(rows: DataFrame, status: str, reason: str) -> DataFrame:
        return rows.select(url_col, F.lit(status).alias("status"), F.lit(reason).alias("reason"), *none)

    found = first.unionByName(unread(again, fixed.SKIPPED, fixed.STOP_VISITED))
    if stop_at is not None:
        found = found.unionByName(unread(pages.where(halted), fixed.STOPPED, fixed.STOP_REQUESTED))
    return found, new_records
