"""Line dedup by site-relative frequency.

Per host, a line's share is the number of the host's pages that hold it over
the number of the host's pages; lines from ``ratio`` on, on ``least_pages``
pages at least, are boilerplate of that host and dropped from all its pages.
Pages of a host with equal texts are one page: a copy of a whole page is no
further evidence that its lines are furniture.

Lines are counted by digest with partial aggregates, so that neither a hot
host nor a hot line meets in one task.  A host has at most (lines a page) /
``ratio`` boilerplate lines, because the shares of its lines add up to the
lines of a page; they return to its pages as one row a host, and the texts
themselves are shuffled only if that table is too large for Spark to broadcast
(a hot host's pages are then split by adaptive execution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RATIO = 0.1
LEAST_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    """Equal for lines that differ in spaces at their ends only."""
    return F.md5(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, dropped): the digests of each host's boilerplate lines, for
    ``pages`` (host, text) without nulls."""
    marked = pages.select("host", F.md5("text").alias("page"), "text")
    totals = marked.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    line = F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _digest)))
    held = (marked.select("host", "page", line.alias("line")).distinct()
                  .groupBy("host", "line").agg(F.count("*").alias("held")).filter(F.col("held") >= least_pages))
    return (held.join(totals, "host").filter(F.col("held") >= F.col("pages") * ratio)
                .groupBy("host").agg(F.collect_list("line").alias("dropped")))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                     least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with ``text_col`` rid of boilerplate lines, and with n_lines
    and n_removed (long) added; columns with these names are replaced.

    A null text stays null and has no lines; an empty one has one, empty.
    Blank lines are never boilerplate and stay.  Rows without a host are one
    host.  Repeated rows count as one page and get the same answer each.  An
    empty table gives an empty result; other columns are carried along.
    """
    pages = pages.drop(*[c for c in pages.columns if c.lower() in ("n_lines", "n_removed")])
    host, text = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`").cast("string")
    known = pages.select(host.alias("host"), text.alias("text")).filter("text IS NOT NULL")
    per_host = staged(boilerplate(known, ratio, least_pages), "boilerplate").withColumnsRenamed(
        {"host": "_line_host", "dropped": "_line_dropped"})
    joined = pages.join(per_host, F.col("_line_host") == host, "left")
    dropped = F.col("_line_dropped")
    kept = F.when(dropped.isNull(), _lines(text)).otherwise(
        F.filter(_lines(text), lambda x: ~F.array_contains(dropped, _digest(x))))
    out = joined.withColumn("_line_kept", kept)
    return out.select(*[F.array_join("_line_kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns],
                      F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
                      F.when(text.isNull(), 0).otherwise(F.size(_lines(text)) - F.size("_line_kept")).cast("long").alias("n_removed"))
