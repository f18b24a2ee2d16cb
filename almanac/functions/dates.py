"""Date-text expressions (built-in Column functions only).

Dates in notices are free text.  Fuzzy parsing that fills missing parts
from "today" is not reproducible, so parsing uses a fixed format list and
gives NULL when no format fits.  ANSI mode is on in Spark 4, so only
``try_*`` parsers are used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import fixed
from ..sources.fixed import BODY_DATE_PATTERNS, PUBLISHED_IN_PAGE, PUBLISHED_PREFIX  # noqa: F401

CANONICAL = fixed.CANONICAL_DATE
# Month name or abbreviation, day, year, anywhere in a text.
WRITTEN_OUT = r"(?i)\b(" + fixed.MONTHS + "|" + fixed.MONTHS_ABBR + r")\.? (\d{1,2}),? (\d{4})\b"
# Accepted inputs, tried in order (our fixed list, see the module note).
FORMATS = [
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "M/d/yyyy",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_text_date(c, formats=None) -> Column:
    """Timestamp of the first format that parses the text, else of the first
    date written out inside it, else NULL.  White space of any kind and line
    breaks count as one space, and '10th' as '10'."""
    t = F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")
    whole = [F.try_to_timestamp(t, F.lit(f)) for f in (formats or FORMATS)]
    inside = WRITTEN_OUT
    month = F.substring(F.initcap(F.regexp_extract(t, inside, 1)), 1, 3)
    written = F.concat(month, F.lit(" "), F.regexp_extract(t, inside, 2), F.lit(", "), F.regexp_extract(t, inside, 3))
    return F.coalesce(*whole, F.try_to_timestamp(written, F.lit("MMM d, yyyy")))


def canonical_date(c, formats=None) -> Column:
    """text -> 'June 01, 2026' or NULL."""
    return F.date_format(parse_text_date(c, formats), CANONICAL)


def publication_timestamp(c) -> Column:
    """non-fuzzy parse of a canonical publication date; NULL on failure."""
    return F.try_to_timestamp(F.trim(_col(c)), F.lit("MMMM d, yyyy"))


def year_from_text(c) -> Column:
    """first free-standing 4-digit number; else two trailing digits after
    '/', '-' or whitespace read as 2000+yy."""
    c = _col(c)
    four = F.regexp_extract(c, fixed.YEAR_FOUR_DIGITS, 1)
    two = F.regexp_extract(c, fixed.YEAR_TWO_TRAILING, 1)
    return F.coalesce(
        F.nullif(four, F.lit("")).try_cast("int"),
        F.nullif(two, F.lit("")).try_cast("int") + F.lit(2000),
    )


def first_body_date(c) -> Column:
    """The candidate date text of a body: first match of the first pattern
    that matches anywhere."""
    c = F.coalesce(_col(c), F.lit(""))
    patterns = [p.replace("(?i)", "(?iU)") for p in BODY_DATE_PATTERNS]  # white space as Unicode has it
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in patterns])


def death_date_from_body(c, min_year_exclusive: int = fixed.MIN_DEATH_YEAR_EXCLUSIVE) -> Column:
    """the candidate, kept only if its year is after 2000."""
    cand = first_body_date(c)
    return F.when(year_from_text(cand) > min_year_exclusive, cand)


def header_date_pair(strings) -> Column:
    """From the non-empty text nodes of the date header: one -> death only;
    two or more -> first birth, last death; 'N/A' -> NULL.  STRUCT<birth, death>."""
    s = F.filter(F.transform(_col(strings), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(s)
    birth = F.when(n >= 2, F.element_at(s, 1))
    death = F.when(n >= 1, F.element_at(s, -1))
    return F.struct(
        F.when(birth != "N/A", birth).alias("birth_date"),
        F.when(death != "N/A", death).alias("death_date"),
    )


def header_or_body_dates(header_strings, body) -> Column:
    """the header pair when the header has text, else the body date."""
    has_header = F.coalesce(F.size(F.filter(_col(header_strings), lambda x: F.trim(x) != "")), F.lit(0)) > 0
    pair = header_date_pair(header_strings)
    return F.when(has_header, pair).otherwise(
        F.struct(F.lit(None).cast("string").alias("birth_date"),
                 death_date_from_body(body).alias("death_date")))


def is_current_month(ts, as_of) -> Column:
    """same calendar month and year as ``as_of`` (a parameter, never the
    wall clock); NULL -> false."""
    as_of_c = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    t = _col(ts)
    return F.coalesce(
        (F.year(t) == F.year(as_of_c)) & (F.month(t) == F.month(as_of_c)), F.lit(False))


def strip_published(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), PUBLISHED_PREFIX, ""))


def publication_date_from_candidates(candidates, page_text=None) -> Column:
    """Candidates in order (tag texts and datetime attributes), then the
    'Published ... Month d, yyyy' phrase of the whole page; strip the prefix;
    first that parses -> canonical text."""
    cands = _col(candidates)
    if page_text is not None:
        phrase = F.nullif(F.regexp_extract(_col(page_text), PUBLISHED_IN_PAGE, 1), F.lit(""))
        cands = F.concat(cands, F.filter(F.array(phrase), lambda x: x.isNotNull()))
    parsed = F.transform(cands, lambda x: canonical_date(strip_published(x)))
    return F.get(F.filter(parsed, lambda x: x.isNotNull()), 0)


def with_body_dates(df, body, header=None, prefix: str = "") -> "DataFrame":
    """F3 + F4 + F5 staged as columns: ``candidate`` (first body date),
    ``candidate_year``, then ``birth_date``/``death_date`` from the header
    pair when the header has text, else the body candidate kept only after
    2000.  Each regex pass runs once per row."""
    c, y = prefix + "candidate", prefix + "candidate_year"
    df = df.withColumn(c, first_body_date(body))
    df = df.withColumn(y, year_from_text(F.col(c)))
    body_death = F.when(F.col(y) > fixed.MIN_DEATH_YEAR_EXCLUSIVE, F.col(c))
    if header is None:
        return (df.withColumn(prefix + "birth_date", F.lit(None).cast("string"))
                  .withColumn(prefix + "death_date", body_death))
    h = F.coalesce(_col(header), F.array().cast("array<string>"))
    df = df.withColumn("_hs", F.filter(F.transform(h, lambda x: F.trim(x)), lambda x: x != ""))
    hs = F.col("_hs")
    n = F.size(hs)
    birth = F.when(n >= 2, F.element_at(hs, 1))
    death = F.when(n >= 1, F.element_at(hs, -1))
    return (df.withColumn(prefix + "birth_date", F.when(n > 0, F.when(birth != "N/A", birth)))
              .withColumn(prefix + "death_date", F.when(n > 0, F.when(death != "N/A", death)).otherwise(body_death))
              .drop("_hs"))
