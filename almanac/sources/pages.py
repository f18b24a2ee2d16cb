"""One Arrow pass over page HTML (``mapInArrow``).

The only Python on the row path.  It parses each page once with the
standard-library HTML parser and emits the *raw* texts of the selectors the
record pipeline needs; every cascade, split, date parse and match after that
is a built-in column expression (see :func:`page_fields`).

Text of an element follows the usual ``get_text(" ", strip=True)`` rule:
descendant text nodes, each stripped, empty ones dropped, joined with one
space; script, style and comment text excluded.  A missing element is
'N/A'.
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import dates as D
from ..functions import text as T
from . import fixed

NA = "N/A"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "param", "source", "track", "wbr"}
ERROR_CHARS = 4000
#: Pages whose HTML and texts are Python objects at once; a batch has 10,000.
AT_ONCE = 50
HIDDEN = {"script", "style", "template"}

RAW_SCHEMA = (
    "url string, name_full string, name_upper string, testid_names array<string>, "
    "meta_titles array<string>, body_candidates array<string>, date_strings array<string>, "
    "date_header_text string, published_candidates array<string>, published_phrase string, "
    "funeral_home string, links array<string>, error string"
)

# plain values copied here: the row path below is shipped to workers by value
PHRASE_PATTERN = fixed.PUBLISHED_IN_PAGE
BODY_SELECTORS = fixed.BODY_SELECTORS
TESTID_SELECTORS = fixed.TESTID_SELECTORS
PUBLISHED_SELECTORS = fixed.PUBLISHED_SELECTORS


class _Node:
    __slots__ = ("tag", "attrs", "children", "classes")

    def __init__(self, tag, attrs):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.classes = (attrs.get("class") or "").split()


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: (v if v is not None else "") for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(_Node(tag, {k: (v if v is not None else "") for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _walk(node):
    """Elements below ``node`` in page order, by a stack of our own: markup
    may be nested deeper than Python calls can be."""
    todo = [ch for ch in reversed(node.children) if isinstance(ch, _Node)]
    while todo:
        cur = todo.pop()
        yield cur
        todo.extend(ch for ch in reversed(cur.children) if isinstance(ch, _Node))


def _strings(node):
    todo = list(reversed(node.children))
    while todo:
        cur = todo.pop()
        if isinstance(cur, str):
            yield cur
        elif cur.tag not in HIDDEN:
            todo.extend(reversed(cur.children))


def _text(node):
    if node is None:
        return NA
    return " ".join(s.strip() for s in _strings(node) if s.strip())


def _find(nodes, tag=None, cls=None, attr=None):
    for n in nodes:
        if tag is not None and n.tag != tag:
            continue
        if cls is not None and cls not in n.classes:
            continue
        if attr is not None and n.attrs.get(attr[0]) != attr[1]:
            continue
        return n
    return None


def _find_all(nodes, tag=None, cls=None):
    return [n for n in nodes if (tag is None or n.tag == tag) and (cls is None or cls in n.classes)]


_PHRASE = None


def _raw_fields(url, html, link_prefix):
    import re
    global _PHRASE
    if _PHRASE is None:
        _PHRASE = re.compile(PHRASE_PATTERN)
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    nodes = list(_walk(b.root))
    name_full = _find(nodes, "h1", "obit-name")
    name_upper = _find(nodes, "span", "obit-lastname-upper")
    testids = [_text(_find(nodes, attr=("data-testid", t))) for t in TESTID_SELECTORS]
    testids.append(_text(_find(nodes, "h1")))
    og = _find(nodes, "meta", attr=("property", "og:title"))
    tw = _find(nodes, "meta", attr=("name", "twitter:title"))
    title = _find(nodes, "title")
    metas = [og.attrs.get("content", "") if og else None,
             tw.attrs.get("content", "") if tw else None,
             "".join(_strings(title)) if title else None]
    bodies = [_text(_find(nodes, t, c)) for t, c in BODY_SELECTORS]
    h2 = _find(nodes, "h2", "obit-dates")
    date_strings = [s.strip() for s in _strings(h2) if s.strip()] if h2 else None
    header_text = "".join(s.strip() for s in _strings(h2)) if h2 else None
    pubs = []
    for t, c in PUBLISHED_SELECTORS:
        for n in _find_all(nodes, t, c):
            txt = _text(n)
            if txt:
                pubs.append(txt)
            if n.attrs.get("datetime"):
                pubs.append(n.attrs["datetime"])
    page_text = " ".join(s.strip() for s in _strings(b.root) if s.strip())
    m = _PHRASE.search(page_text)
    fh = _text(_find(nodes, "span", "obit-fh"))
    links = [n.attrs["href"] for n in nodes
             if n.tag == "a" and n.attrs.get("href", "").startswith(link_prefix)]
    return (url, _text(name_full) if name_full else None, _text(name_upper) if name_upper else None,
            testids, metas, bodies, date_strings, header_text, pubs, m.group(1) if m else None, fh, links, None)


def _fields_or_error(url, html, link_prefix, n_cols):
    """A page that cannot be read is an error of that page, not of the job."""
    try:
        return _raw_fields(url, html, link_prefix)
    except Exception as e:  # noqa: BLE001
        return (url,) + (None,) * (n_cols - 2) + (f"{type(e).__name__}: {e}"[:ERROR_CHARS],)


# Ship this module's code with the task (pickled by value), so Python
# workers need only pyarrow, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def raw_page_fields(pages: DataFrame, url_col="url", html_col="html", link_prefix=fixed.RECORD_LINK_PREFIX,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Arrow-batched extractor: one output row per page with the raw
    selector texts (schema ``RAW_SCHEMA``) and the columns of ``keep``."""
    cols = [c.split()[0] for c in RAW_SCHEMA.split(", ")]
    # Kept columns pass the extractor as text, so that Arrow changes no type.
    texts = {c: f"_keep{i}" for i, c in enumerate(keep)}
    schema = StructType.fromDDL(", ".join([RAW_SCHEMA, *[f"{t} string" for t in texts.values()]]))
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                part = whole.slice(at, AT_ONCE)
                rows = [_fields_or_error(u, h, link_prefix, len(cols))
                        for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist())]
                found = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays([*found, *[part.column(t).cast(pa.string()) for t in texts.values()]], schema=arrow)

    raw = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"),
                       *[F.col(c).cast("string").alias(t) for c, t in texts.items()]).mapInArrow(run, schema)
    raw = raw.withColumnRenamed("url", url_col)
    return raw.withColumns({c: F.col(t).cast(pages.schema[c].dataType) for c, t in texts.items()}).drop(*texts.values()) \
        if keep else raw


def page_fields(pages: DataFrame, url_col="url", html_col="html", link_prefix=fixed.RECORD_LINK_PREFIX,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """P1-P8 + P11: the record fields of each page, and its columns ``keep``.

    name (P3): (a) the obit-name header minus the upper-case last name,
    (b) the first of the full-name selectors and h1 that splits into two
    parts, (c) og:title, twitter:title, <title> cut at ' Obituary'.
    body (P2): first of span.details-copy, .details-copy, article, main
    that is neither empty nor 'N/A'.  Dates: header pair when the header has
    text, else the body date (F5); publication date (P7).

    The candidate lists have fixed length, so each candidate is its own
    staged column (code-generated, computed once) rather than a lambda."""
    raw = raw_page_fields(pages, url_col, html_col, link_prefix, keep)
    n_b, n_c = len(TESTID_SELECTORS) + 1, 3
    for i in range(n_b):
        raw = raw.withColumn(f"_nb{i}", T.split_name(F.element_at("testid_names", i + 1)))
    for j in range(n_c):
        m = F.element_at("meta_titles", j + 1)
        raw = raw.withColumn(f"_nc{j}", F.when(m.isNotNull(), T.split_name(T.title_name(m))))
    a_first = T.strip_lastname("name_full", "name_upper")
    a_last = T.capitalize(F.col("name_upper"))
    raw = raw.withColumn("_na", F.when(F.col("name_full").isNotNull() & F.col("name_upper").isNotNull(),
                                       F.struct(a_first.alias("first_name"), a_last.alias("last_name"))))

    def usable(c):
        s = F.col(c)
        return F.when(F.coalesce(s["first_name"] != "", F.lit(False)) & F.coalesce(s["last_name"] != "", F.lit(False)), s)

    cascade = ["_na"] + [f"_nb{i}" for i in range(n_b)] + [f"_nc{j}" for j in range(n_c)]
    raw = raw.withColumn("_name", F.coalesce(*[usable(c) for c in cascade]))
    body = F.coalesce(*[F.when((x != "") & (x != NA), x) for x in
                        [F.element_at("body_candidates", k + 1) for k in range(len(BODY_SELECTORS))]], F.lit(""))
    out = raw.withColumn("body", body)
    has_header = F.coalesce(F.col("date_header_text"), F.lit("")) != ""
    out = D.with_body_dates(out, F.col("body"), F.when(has_header, F.col("date_strings")), prefix="_d_")
    out = out.select(
        url_col,
        F.col("_name.first_name").alias("first_name"),
        F.col("_name.last_name").alias("last_name"),
        "body",
        F.col("_d_birth_date").alias("birth_date"),
        F.col("_d_death_date").alias("death_date"),
        D.publication_date_from_candidates(
            F.concat(F.col("published_candidates"),
                     F.filter(F.array(F.col("published_phrase")), lambda x: x.isNotNull()))).alias("publication_text"),
        "funeral_home",
        F.array_distinct("links").alias("links"),
        "error",
        *keep,
    )
    return out.withColumn("publication_date", D.publication_timestamp("publication_text"))
