"""Main text of web pages by tag-path ratios.

Each text block of a page has a root-to-leaf tag path. For each path the text length and
the punctuation of its blocks are summed and divided by their number; the two ratios are
smoothed along the page with a Gaussian, fused by their product, averaged back over the
path, and paths at or above a share of the page's spread are content. The elements that
hold content blocks are the article. Elements that name themselves as something else
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments)
take no part.

In elements that are named ``article`` or ``main`` the page itself says what the article
is: blocks stay there unless their path falls short and most of their text is links.
Elsewhere the ratios decide: a block stays if its path is content, or if it stands between
content blocks and most of it isn't links (items, captions); a heading stays if content
follows it before the next heading of its kind.

Defined results: a null or empty page gives an empty text; a page without markup is one
block; unclosed and stray tags, unknown references and truncated pages are read as far
as they go; repeated rows give repeated results; an empty table gives an empty one;
other columns are not read. No length is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import exp, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|select|textarea|title|object|canvas)\b(?>[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?>[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle semantics annotation".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An open paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("html body article main section div ul ol dl table tbody thead tfoot blockquote td th form aside nav header footer figure details fieldset".split())
OTHER_TAGS = frozenset("nav footer aside form button dialog menu head input label fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OTHER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|adsense|sponsor(?:ed|s)?|promos?|promotion|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|recommended|recommendations|sidebar|aside|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|comments?|commentlist|disqus|replies|respond|search|pagination|pager|toolbar|copyright|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
#: Names of an article's own headings, which hold words of the above.
OWN_NAMES = re.compile(r"(?:^|(?<=\s))(?:post|entry|article|story|content|section|chapter|page)[_-]+(?:header|heading|title)(?=$|\s)", re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
#: The share of the spread that makes a path content, where the page names its article and where it doesn't.
NAMED_SHARE, SHARE = 0.5, 0.75
#: Blocks before the text in which its title is looked for.
LEAD = 3
#: Smoothing reaches this many blocks to each side, with this spread.
REACH, SPREAD = 2, 1.0
KERNEL = [exp(-((d / SPREAD) ** 2) / 2) for d in range(-REACH, REACH + 1)]


class Block:
    __slots__ = ("path", "nodes", "text", "linked", "heading", "fused")

    def __init__(self, path: str, nodes: tuple[int, ...], text: str, linked: int, heading: bool) -> None:
        self.path, self.nodes, self.text, self.linked, self.heading, self.fused = path, nodes, text, linked, heading, 0.0


def other(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element names itself as something that isn't the article."""
    if tag in OTHER_TAGS or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and OTHER_NAMES.search(OWN_NAMES.sub("", value)) or name == "role" and value.lower() in OTHER_ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks_of(page: str) -> tuple[list[Block], dict[int, str]]:
    """The text blocks outside other elements, and each element's tag."""
    stack: list[tuple[str, int, bool]] = []  # tag, element, whether it or an ancestor is other
    tags: dict[int, str] = {}
    out: list[Block] = []
    parts: list[str] = []
    linked = n = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not (stack and stack[-1][2]):
                path = [x for x in stack if x[0] not in INLINE]
                out.append(Block("/".join(x[0] for x in path), tuple(x[1] for x in path), text, linked, any(x[0] in HEADINGS for x in path)))
            parts.clear()
        linked = 0

    def pop_to(names: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in SCOPES:
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if any(x[0] == "a" for x in stack):
                linked += len(piece)
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attrs = m[2] or m[5], m[4] or m[7] or ""
        block = tag not in INLINE
        if block:
            flush()
        elif tag in ("br", "wbr", "img"):
            parts.append(" " if tag == "br" else "")
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if not block and stack[i][0] not in INLINE:
                    break
            continue
        if tag in ENDS_P:
            pop_to(CLOSES["p"])
        if tag in CLOSES and tag != "p":
            pop_to(CLOSES[tag])
        if tag in VOID or attrs.endswith("/") and tag not in SCOPES:
            continue
        n += 1
        if block:
            tags[n] = tag
        hidden = bool(stack and stack[-1][2]) or other(tag, attrs, any(x[0] in ("article", "main") for x in stack))
        if hidden and not (stack and stack[-1][2]) and not block:
            flush()
        stack.append((tag, n, hidden))
    if at < len(page):
        parts.append(page[at:].split("<", 1)[0] if re.match(r"[^<]*<[a-zA-Z/!]", page[at:]) else page[at:])
    flush()
    return out, tags


def smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - REACH), min(len(values), i + REACH + 1)
        weights = KERNEL[lo - i + REACH : hi - i + REACH]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def content_paths(blocks: list[Block], share: float) -> set[str]:
    """Paths whose fused ratio reaches ``share`` of the spread over the page's blocks."""
    length: dict[str, float] = {}
    marks: dict[str, float] = {}
    count: dict[str, int] = {}
    for b in blocks:
        length[b.path] = length.get(b.path, 0) + max(0, len(b.text) - b.linked)
        marks[b.path] = marks.get(b.path, 0) + len(PUNCTUATION.findall(b.text))
        count[b.path] = count.get(b.path, 0) + 1
    lengths = smoothed([length[b.path] / count[b.path] for b in blocks])
    points = smoothed([1 + marks[b.path] / count[b.path] for b in blocks])
    total: dict[str, float] = {}
    for b, x, y in zip(blocks, lengths, points):
        b.fused = x * y
        total[b.path] = total.get(b.path, 0) + b.fused
    mean = sum(b.fused for b in blocks) / len(blocks)
    spread = sqrt(sum((b.fused - mean) ** 2 for b in blocks) / len(blocks))
    least = share * min(spread, mean)
    return {p for p in total if length[p] and total[p] / count[p] >= least}


def named_roots(named: set[int], content: list[Block]) -> set[int]:
    """The named elements that hold content; an outer one only if it has content outside the inner ones."""
    return {[n for n in b.nodes if n in named][-1] for b in content if not named.isdisjoint(b.nodes)}


def branches(content: list[Block], tags: dict[int, str]) -> set[int]:
    """The lowest element that covers all content, or those of its children that hold some; none for the whole page."""
    deep = 0
    while all(len(b.nodes) > deep and b.nodes[deep] == content[0].nodes[deep] for b in content):
        deep += 1
    text = ("p", "li", "td", "tr", "pre", *HEADINGS)
    while deep and tags.get(content[0].nodes[deep - 1]) in text:
        deep -= 1
    below = {b.nodes[deep] if len(b.nodes) > deep else None for b in content}
    if all(n is not None and tags.get(n) not in text for n in below):
        return below
    return {content[0].nodes[deep - 1]} if deep else set()


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by line ends."""
    if not page:
        return ""
    blocks, tags = blocks_of(page)
    if not blocks:
        return ""
    named = {n for n, tag in tags.items() if tag in ("article", "main")}
    paths = content_paths(blocks, NAMED_SHARE if named else SHARE)
    content = [b for b in blocks if b.path in paths and not b.heading] or blocks
    roots = named_roots(named, content) or named_roots(named, blocks) if named else branches(content, tags)
    inside = [not roots or not roots.isdisjoint(b.nodes) for b in blocks]
    if roots and named:
        return "\n".join(b.text for b, x in zip(blocks, inside) if x and (b.path in paths or b.heading or b.linked <= 0.5 * len(b.text)))
    # the title may stand just before the element that holds the text
    first = inside.index(True)
    lead = range(max(0, first - LEAD), first)
    return "\n".join(b.text for b in chosen([b for i, (b, x) in enumerate(zip(blocks, inside)) if x or b.heading and i in lead], paths))


def chosen(blocks: list[Block], paths: set[str]) -> list[Block]:
    """Content blocks, what stands between them but for links, and headings that content follows."""
    content = [i for i, b in enumerate(blocks) if b.path in paths and not b.heading]
    if not content:
        return [b for b in blocks if b.path in paths or b.heading or b.linked <= 0.5 * len(b.text)]
    first, last = content[0], content[-1]
    out, ahead = [], set()  # paths of headings since the last content block, from the end on
    followed = False
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.heading:
            if followed and b.path not in ahead:
                out.append(b)
                ahead.add(b.path)
            continue
        if b.path in paths or first < i < last and b.linked <= 0.5 * len(b.text):
            out.append(b)
            followed = True
            ahead.clear()
    return out[::-1]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` long, url string, text string, n_chars long")
