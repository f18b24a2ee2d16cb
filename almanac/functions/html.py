"""Leaf-tag HTML extraction with built-in regex columns (J1, oracle-checkable).

Regexes are only right for tags that do not nest in themselves (title, h1,
article, anchors).  Nested selectors (``span.details-copy`` inside spans,
text-node lists of the date header) go through the Arrow extractor in
``almanac.sources.pages``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

NA = "N/A"
# HTML character references decoded by the regex path, '&amp;' last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&nbsp;", " "), ("&amp;", "&")]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def element_pattern(tag: str) -> str:
    """First ``<tag ...>inner</tag>``; group 1 is the inner markup."""
    return r"(?is)<" + tag + r"(?:\s[^>]*)?>(.*?)</" + tag + r"\s*>"


def unescape(c) -> Column:
    c = _col(c)
    for k, v in ENTITIES:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def markup_text(inner) -> Column:
    """Visible text of a markup fragment: drop script/style bodies and
    comments, tags become separators, decode entities, collapse whitespace."""
    x = F.regexp_replace(_col(inner), r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<style(?:\s[^>]*)?>.*?</style\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    return T.collapse_ws(unescape(x))


def element_text(html, tag: str, missing: str | None = NA) -> Column:
    """P1 for a leaf tag: text of the first element, or ``missing``."""
    found = F.regexp_extract(F.coalesce(_col(html), F.lit("")), element_pattern(tag), 0)
    inner = F.regexp_extract(F.coalesce(_col(html), F.lit("")), element_pattern(tag), 1)
    return F.when(found != "", markup_text(inner)).otherwise(F.lit(missing))


def first_present(*cols) -> Column:
    """P2 cascade: first value that is neither empty nor 'N/A', else ''."""
    return F.coalesce(*[F.when((c != "") & (c != NA), c) for c in cols], F.lit(""))


def link_pattern(prefix: str = "/") -> str:
    """``href`` values of anchors that start with ``prefix`` (group 1)."""
    lit = "".join("\\" + ch if not ch.isalnum() else ch for ch in prefix)
    return r"""(?i)<a\s[^>]*?href\s*=\s*["'](""" + lit + r"""[^"']*)["']"""


# An anchor's start tag, and the value of its own href (not of data-href),
# quoted either way or not at all.
ANCHOR = r"""(?i)<a(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*>"""
HREF = r"""(?i)[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def links(html, prefix: str = "/") -> Column:
    """P9 raw: every ``href`` starting with ``prefix``, in page order; links in
    comments are none, and character references are decoded."""
    shown = F.regexp_replace(F.coalesce(_col(html), F.lit("")), r"(?s)<!--.*?(?:-->|$)", " ")
    anchors = F.regexp_extract_all(shown, F.lit(ANCHOR), F.lit(0))
    href = lambda a: unescape(F.concat(*[F.regexp_extract(a, HREF, k) for k in (1, 2, 3)]))
    return F.filter(F.transform(anchors, href), lambda x: x.startswith(prefix))


def site_root(url) -> Column:
    """Scheme and host of a URL, e.g. 'https://a.example.com'."""
    return F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def absolute_links(html, url, prefix: str = "/") -> Column:
    """Distinct links in first-seen order, absolutised against the page's
    site (``array_distinct`` keeps first-seen order)."""
    root = site_root(url)
    return F.transform(F.array_distinct(links(html, prefix)), lambda x: F.concat(root, x))


def host(url) -> Column:
    return F.lower(F.try_parse_url(_col(url), F.lit("HOST")))


def subdomain_of(url, base_domain: str) -> Column:
    """P10: first host label when the host ends with the base domain, has more
    than two labels and does not start with 'www'; else NULL."""
    h = host(url)
    labels = F.split(h, r"\.", -1)
    first = F.element_at(labels, 1)
    ok = (h.endswith(base_domain.lower()) & (F.size(labels) > 2) & (first != "www"))
    return F.when(ok, first)
