"""Main text of a page by tag-path ratios.

A page is cut into blocks, each with its path of tags from the root.  Per path
the text length and the punctuation are added up and divided by the number of
blocks on it; the two ratios are smoothed over the neighbouring paths in page
order, fused by multiplication, and paths from a share of the best score on
are content, with the blocks beside them under the same parent and those of
the ``article`` or ``main`` element that a content path lies in.  An element
without a content path, such as a teaser card, is not kept for its name.  Link
lists go: runs of linked siblings, headings excepted, outside of an
``article`` with a content path.

Containers that say what they are (navigation, footers, advertising, comments
...) are left out beforehand.  Where class, id, role or ``form`` says it, this
does not hold for one that wraps the page's content, see :func:`_wraps`.

A page is small, and its paths are its own; so each is worked on by itself in
an Arrow batch, and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Paths from this share of the best fused score on are content.
SHARE = 0.15
#: From this share of its text in links on, a block without an end of
#: sentence is linked; with linked siblings beside it, it is a link list.
LINKS = 0.5
#: More than this share of the page's text is most of it.
MOST = 0.5

# Element names of the HTML standard, and the usual names of
# page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe xmp noembed noframes".split())
BLOCK = frozenset("""html head body address article aside blockquote center details dialog dd dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre section
summary table caption colgroup tbody td tfoot th thead tr ul""".split())
OUTSIDE = frozenset("""head nav footer aside menu dialog button select option svg math object audio video canvas
map""".split())
ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
CONTENT = frozenset(("article", "main"))
FURNITURE = frozenset("""ad ads adbox advert adverts advertisement advertising alert alerts banner breadcrumb
breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer form gdpr login masthead menu
menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo
promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored
subscribe subscription toolbar widget complementary""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SENTENCE = re.compile(r"[.!?…。！？](?:[\s\"')\]»”]|$)")
PUNCTUATION = re.compile(r"[,.;:!?…，。；：！？]")

MARKUP = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""",
    re.S)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


class _Block:
    __slots__ = ("tag", "path", "parent", "pieces", "linked", "content", "inside", "text")

    def __init__(self, tag: str, path: int, parent: int, content: tuple[tuple[int, str], ...], inside: tuple[int, ...]):
        # content: path and tag of the article and main elements around the
        # block, outermost first; inside: the furniture containers around it.
        self.tag, self.path, self.parent, self.content, self.inside = tag, path, parent, content, inside
        self.pieces, self.linked, self.text = [], 0, ""


def _is_hidden(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or \
                name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _is_furniture(attributes: str, in_content: bool) -> bool:
    """Whether a whole word of class, id or role names page furniture."""
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for word in next(filter(None, values), "").lower().split():
                if word in FURNITURE or word == "header" and not in_content:
                    return True
    return False


def _plain(b: _Block) -> int:
    """Length of the text that is not linked."""
    return max(0, len(b.text) - b.linked)


def _wraps(found: list[_Block], marked: list[int]) -> set[int]:
    """The furniture containers that wrap the page's content: with an
    ``article`` or ``main`` that holds most of the page's text; and, if no
    sentence ends outside of furniture, with any ``article`` or ``main``, or
    with most of the text in blocks below the container itself, one of which
    ends a sentence.  ``marked``: the path of each container."""
    whole = sum(map(_plain, found))
    rest_reads = any(not b.inside and SENTENCE.search(b.text) for b in found)
    held: dict[int, list[_Block]] = {}
    for b in found:
        for c in b.inside:
            held.setdefault(c, []).append(b)
    wraps = set()
    for c, own in held.items():
        articles = [b for b in own if any(path > marked[c] for path, _ in b.content)]
        below = [b for b in own if b.path != marked[c]]
        if sum(map(_plain, articles)) > MOST * whole or not rest_reads and (
                articles or sum(map(_plain, below)) > MOST * whole and any(SENTENCE.search(b.text) for b in below)):
            wraps.add(c)
    return wraps


def blocks(page: str) -> list[_Block]:
    """Blocks with text outside the page's furniture, in page order.  The walk
    is a loop over tags, so that neither depth nor unclosed tags matter."""
    found: list[_Block] = []
    paths: dict[tuple[int, str], int] = {}
    # tag, path, left out, article and main elements around, furniture around, in a link
    stack: list[tuple[str, int, bool, tuple[tuple[int, str], ...], tuple[int, ...], bool]] = [("", 0, False, (), (), False)]
    opened: dict[str, int] = {}
    marked: list[int] = []
    block: _Block | None = None
    at, end = 0, len(page)

    def pop_to(size: int) -> None:
        while len(stack) > size:
            opened[stack.pop()[0]] -= 1

    def add(text: str) -> None:
        nonlocal block
        _, _, out, content, inside, link = stack[-1]
        if out or not text:
            return
        if block is None:
            depth = len(stack) - 1
            while depth and stack[depth][0] not in BLOCK:
                depth -= 1
            block = _Block(stack[depth][0], stack[depth][1], stack[max(0, depth - 1)][1], content, inside)
            found.append(block)
        text = html.unescape(text)
        block.pieces.append(text)
        if link:
            block.linked += len(text.strip())

    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            block = None
        if m[1]:
            if opened.get(tag):
                size = len(stack) - 1
                while stack[size][0] != tag:
                    size -= 1
                pop_to(size)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        if tag in BLOCK and opened.get("p"):
            size = len(stack) - 1
            while stack[size][0] not in BLOCK:
                size -= 1
            if stack[size][0] == "p":
                pop_to(size)
        if any(opened.get(t) for t in ITEM.get(tag, ())):
            size = len(stack) - 1
            while stack[size][0] not in ITEM[tag] and stack[size][0] not in ("ul", "ol", "dl", "table", "menu", "") and \
                    (stack[size][0] not in BLOCK or stack[size][0] in ("p", *ITEM)):
                size -= 1
            if stack[size][0] in ITEM[tag]:
                pop_to(size)
        _, path, out, content, inside, link = stack[-1]
        own = paths.setdefault((path, tag), len(paths) + 1)
        if not out and tag not in ("html", "body"):
            out = tag in OUTSIDE or tag == "header" and not content or (
                tag not in CONTENT and bool(m[3]) and _is_hidden(m[3].rstrip(">")))
            if tag == "form" or tag not in CONTENT and m[3] and _is_furniture(m[3].rstrip(">"), bool(content)):
                # By the place in the page: containers of one path may differ.
                inside = (*inside, len(marked))
                marked.append(own)
        if not m[3].endswith("/>") or tag in BLOCK:
            stack.append((tag, own, out, (*content, (own, tag)) if tag in CONTENT and not out else content, inside, link or tag == "a"))
            opened[tag] = opened.get(tag, 0) + 1
    for b in found:
        b.text = " ".join("".join(b.pieces).split())
    found = [b for b in found if b.text]
    wraps = _wraps(found, marked)
    return [b for b in found if wraps.issuperset(b.inside)]


def _is_linked(b: _Block) -> bool:
    return b.linked >= LINKS * len(b.text) and not SENTENCE.search(b.text)


def _link_lists(own: list[_Block]) -> set[int]:
    """Places of the blocks in runs of linked siblings; headings are in none."""
    linked = [b.tag not in HEADINGS and _is_linked(b) for b in own]
    found = set()
    for at in range(1, len(own)):
        if linked[at - 1] and linked[at] and (own[at - 1].path, own[at - 1].parent) == (own[at].path, own[at].parent):
            found |= {at - 1, at}
    return found


def path_scores(own: list[_Block]) -> dict[int, float]:
    """Fused and smoothed ratios of each path."""
    length: dict[int, float] = {}
    marks: dict[int, float] = {}
    count: dict[int, int] = {}
    for b in own:
        count[b.path] = count.get(b.path, 0) + 1
        length[b.path] = length.get(b.path, 0) + len(b.text) - min(b.linked, len(b.text))
        marks[b.path] = marks.get(b.path, 0) + len(PUNCTUATION.findall(b.text))
    order = list(count)  # in page order
    texts = [length[p] / count[p] for p in order]
    points = [marks[p] / count[p] for p in order]

    def smooth(xs: list[float], i: int) -> float:
        beside = xs[max(0, i - 1):i] + xs[i + 1:i + 2]
        return 0.8 * xs[i] + 0.2 * (sum(beside) / len(beside) if beside else xs[i])

    return {p: smooth(texts, i) * (1 + smooth(points, i)) for i, p in enumerate(order)}


def main_text(page: str | None) -> str:
    own = blocks(page or "")
    if not own:
        return ""
    scores = path_scores(own)
    least = SHARE * max(scores.values())
    chosen = {p for p, s in scores.items() if s >= least}
    parents = {b.parent for b in own if b.path in chosen}
    elements = {c for b in own if b.path in chosen for c in b.content}
    lists = _link_lists(own)
    kept = []
    for at, b in enumerate(own):
        in_element = bool(b.content) and b.content[-1] in elements
        if b.path in chosen or in_element or b.parent in parents and not b.content:
            if at not in lists or in_element and b.content[-1][1] == "article":
                kept.append(b)
    return " ".join(b.text for b in kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row for each row of ``pages``.

    A null or blank page, and one of furniture only, has an empty text.  Rows
    are worked on one by one, so repeated rows, null ids and null URLs give
    the same answer each.  Characters that are no markup are text, wherever a
    page is cut off.  An empty table gives an empty result; other columns are
    not looked at.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    return (rows.mapInArrow(_extracted, "id long, url string, text string, n_chars long")
                .withColumnsRenamed({"id": id_col, "url": url_col}))
