"""Scalar text expressions (built-in Column functions only, JVM side).

Every function takes and returns ``Column``; none runs Python per row.
Java regexes are ASCII by default, so every pattern that must see Unicode
whitespace or word characters carries the ``(?U)`` flag.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import fixed

_WS = r"(?U)\s+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """collapse every run of (Unicode) whitespace to one space and trim;
    NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), _WS, " "))


def clean_name(c) -> Column:
    """Collapse whitespace, then drop the suffix ' Obituary' and then
    ' obituary' (each at most once, in that order)."""
    x = collapse_ws(c)
    for suffix in fixed.NAME_SUFFIXES:
        x = F.regexp_replace(x, F.lit(suffix + "$"), F.lit(""))
    return F.trim(x)


def capitalize(c) -> Column:
    """First character upper, the rest lower (not initcap)."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def split_name(c) -> Column:
    """P5: STRUCT<first_name, last_name>; fewer than two tokens -> NULLs.
    The last token is the last name, capitalised; the rest is the first name."""
    cleaned = clean_name(c)
    toks = F.split(cleaned, " ", -1)
    n = F.size(toks)
    ok = (cleaned != "") & (n >= 2)
    first = F.array_join(F.slice(toks, 1, n - 1), " ")
    last = capitalize(F.element_at(toks, -1))
    return F.struct(
        F.when(ok, first).alias("first_name"),
        F.when(ok, last).alias("last_name"),
    )


def title_name(c) -> Column:
    """Text before the first ' Obituary' of a page title."""
    return F.substring_index(F.coalesce(_col(c), F.lit("")), fixed.TITLE_NAME_CUT, 1)


def strip_lastname(full, last) -> Column:
    """P3(a): remove the last-name text everywhere from the full name."""
    return F.trim(F.replace(_col(full), _col(last), F.lit("")))


def is_blank_sentinel(c) -> Column:
    return collapse_ws(c).isin(*fixed.EMPTY_SENTINELS)


def display_normalize(c) -> Column:
    """sentinels -> ''; collapse whitespace; insert a space where a lower
    case letter, digit or , ; : is followed by a capital, and where . ! ? is.
    ``c`` should be a column reference (it is read twice)."""
    c = _col(c)
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), _WS, " ")
    t = F.regexp_replace(t, fixed.GLUE_AFTER_LOWER, " ")
    t = F.regexp_replace(t, fixed.GLUE_AFTER_STOP, " ")
    return F.when(c.isNull() | is_blank_sentinel(c), F.lit("")).otherwise(F.trim(t))


# The body operators below are staged as one column per step: each step
# reads the previous result more than once, and as nested expressions the
# regex work would repeat at every level.  Catalyst keeps projections apart
# when collapsing them would repeat non-trivial expressions.

def with_clean_body(df: DataFrame, text, name=None, out: str = "cleaned") -> DataFrame:
    """display-normalise; drop 'Obituary Events Guestbook Share'; drop a
    leading repeated name with an optional date range; if '<name> Obituary'
    starts within the first 500 characters keep only what follows it; drop
    one leading navigation word."""
    s0, s1, s2, s3 = "_cb0", "_cb1", "_cb2", "_cb3"
    df = df.withColumn(s0, _col(text))
    df = df.withColumn(s1, F.regexp_replace(display_normalize(s0), "(?iU)" + fixed.NAV_PHRASE, " "))
    last = s1
    if name is not None:
        df = df.withColumn("_cbn", _col(name))
        nm = F.trim(F.col("_cbn"))
        q = F.concat(F.lit(r"\Q"), F.replace(nm, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        date = fixed.HEADER_DATE
        header = F.concat(F.lit(r"(?iU)^(?:"), q, F.lit(r"\s*)?(?:" + date + r"\s*-\s*" + date + r"\s*)?(?:"),
                          q, F.lit(r"\s*)+"))
        has_name = nm.isNotNull() & (nm != "")
        df = df.withColumn(s2, F.when(has_name, F.trim(F.regexp_replace(F.col(s1), header, F.lit(""))))
                           .otherwise(F.col(s1)))
        title = F.concat(F.col("_cbn"), F.lit(" Obituary"))
        df = df.withColumn("_cbi", F.instr(F.lower(F.col(s2)), F.lower(title)))  # 1-based, 0 = absent
        idx = F.col("_cbi")
        df = df.withColumn(s3, F.when(has_name & (idx > 0) & (idx <= fixed.TITLE_INDEX_LIMIT),
                                      F.trim(F.substring(F.col(s2), idx + F.length(title), 1 << 30)))
                           .otherwise(F.col(s2)))
        last = s3
    df = df.withColumn(out, F.trim(F.regexp_replace(F.col(last), "(?U)" + fixed.NAV_WORD_AT_START, "")))
    return df.drop(s0, s1, s2, s3, "_cbn", "_cbi")


SENTENCE_BREAK = fixed.SENTENCE_BREAK


def with_paragraphs(df: DataFrame, text, name=None, out: str = "paragraphs") -> DataFrame:
    """sentences (split after . ! ? before a capital or quote), joined in
    pairs; one sentence -> [whole text]; empty -> []."""
    df = with_clean_body(df, text, name, "_pg_clean")
    c = F.col("_pg_clean")
    df = df.withColumn("_pg_s", F.filter(F.transform(F.split(c, SENTENCE_BREAK, -1), lambda s: F.trim(s)),
                                         lambda s: s != ""))
    sents = F.col("_pg_s")
    n = F.size(sents)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(2)),
                        lambda i: F.array_join(F.slice(sents, i, 2), " "))
    df = df.withColumn(out, F.when(c == "", F.array().cast("array<string>"))
                       .when(n <= 1, F.array(c)).otherwise(pairs))
    return df.drop("_pg_clean", "_pg_s")


def with_donation_items(df: DataFrame, text, out: str = "donation_items") -> DataFrame:
    """display-normalise, split on ';' or newline, keep non-blank items,
    strip trailing dots."""
    df = df.withColumn("_di_in", _col(text))
    df = df.withColumn("_di_t", display_normalize("_di_in"))
    t = F.col("_di_t")
    parts = F.filter(F.split(t, fixed.DONATION_ITEM_SPLIT, -1), lambda s: F.trim(s) != "")
    items = F.transform(parts, lambda s: F.regexp_replace(F.trim(s), r"\.+$", ""))
    df = df.withColumn(out, F.when(t == "", F.array().cast("array<string>")).otherwise(items))
    return df.drop("_di_in", "_di_t")


def sentence_filter(text, terms=None, sep: str = fixed.DONATION_JOIN) -> Column:
    """split on '. ', keep pieces whose lower-cased text contains any term,
    join with '; '."""
    terms = list(terms or fixed.DONATION_TERMS)
    pieces = F.split(F.coalesce(_col(text), F.lit("")), re.escape(fixed.DONATION_SENTENCE_SPLIT), -1)

    def keep(s):
        low = F.lower(s)
        cond = F.lit(False)
        for t in terms:
            cond = cond | F.contains(low, F.lit(t.lower()))
        return cond

    return F.concat_ws(sep, F.filter(pieces, keep))


def host_label(url) -> Column:
    """first host label, lower-cased; no host -> NULL."""
    host = F.lower(F.try_parse_url(_col(url), F.lit("HOST")))
    return F.when(host.isNotNull() & (host != ""), F.split_part(host, F.lit("."), F.lit(1)))


def truncate_message(c, limit: int = fixed.ERROR_MESSAGE_LIMIT) -> Column:
    """first ``limit`` characters."""
    return F.substring(_col(c), 1, limit)


def full_name(first, last) -> Column:
    """'first last'."""
    return F.concat_ws(" ", _col(first), _col(last))


def quote_plus(c) -> Column:
    """Form encoding as Python's quote_plus: Java's URLEncoder differs on '~'
    (encodes it) and '*' (keeps it)."""
    e = F.url_encode(_col(c))
    return F.replace(F.replace(e, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def csv_text(c) -> Column:
    """F14 text cell: collapse whitespace, NULL -> ''."""
    return collapse_ws(c)
