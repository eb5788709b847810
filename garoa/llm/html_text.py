"""Main text of web pages by tag-path ratios.

Text length and punctuation are summed per path of tags from the root to a text.
A path's ratios, per text on it, are fused with how unlike boilerplate its
elements are named, smoothed over the order of the page, and compared with their
spread. The element that holds the texts of the paths above it is the article;
all its blocks are its text, but for parts that are menus, adverts, forms,
comments and the like by their tag, role, class or id.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from garoa.llm.shared import arrow_batch, by_bytes

SMOOTH = (0.25, 0.5, 0.25)
SPREAD = 0.5
LINKS = 0.8
#: A side part that holds so much of the page's prose is a wrapper; texts of so many characters outside links are prose.
WRAPPER, PROSE = 0.6, 60
#: Share of links in a part with a weak name, above which it is a side part.
WEAK_LINKS = 0.3

# HTML's void, raw-text and block elements, and what closes an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html legend option tbody td tfoot th thead tr".split())
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
# Names of what is not the article.
SIDE_TAGS = frozenset("nav footer aside form button dialog head menu input object".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
SIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar "
    "share sharing social comment comments commentlist disqus reply replies respond "
    "widget widgets pager pagination login skip copyright disclaimer".split()
)
#: Names that articles use as well: such a part is one by its links and short texts, not by its name.
WEAK_NAMES = frozenset("related recommended recommendations discussion search".split())
#: Names that no wrapper of an article has, however much text it holds.
NO_WRAPPER = frozenset(
    "comment comments commentlist disqus reply replies respond nav navbar navigation menu menus breadcrumb breadcrumbs "
    "cookie cookies consent gdpr popup modal overlay".split()
)
HEADER_NAMES = frozenset("header pageheader siteheader topheader".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]*(?:\"[^\"]*\"|'[^']*'))*[^\"'>]*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¡¿\"“”«»()]")
_SPACE = re.compile(r"\s+")


class Element:
    """An element: its tag, parent and path, what it is named, and what lies in and above it.

    All but the sums below it is known from its parent; ``_settle`` adds those.
    """

    __slots__ = (
        "tag", "parent", "path", "side", "weak", "fixed", "top", "landmark", "holds", "depth", "index", "last",
        "linked", "framed", "outer", "nearest", "chars", "links", "prose", "sider",
    )

    def __init__(self, tag: str, parent: Element | None, attributes: str, index: int, paths: dict):
        self.tag, self.parent, self.index, self.last = tag, parent, index, index
        self.depth = parent.depth + 1 if parent else 0
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.framed = bool(parent and (parent.framed or parent.tag in ("article", "main")))
        self.side = tag in SIDE_TAGS or tag in RAW
        self.weak = self.fixed = self.top = False
        self.landmark = tag in ("article", "main")
        self.chars = self.links = self.prose = 0
        self.sider: Element | None = None
        label = tag
        if attributes.strip():
            label += self._read(attributes)
        if tag == "header" and not self.framed:
            self.top = True
        self.path = paths.setdefault((parent.path if parent else -1, label), len(paths))
        self.holds = 2 if self.landmark else int(tag == "h1")
        self.outer = (parent.outer if parent else None) or (self if self.landmark and tag != "main" else None)
        self.nearest = self if self.landmark else parent.nearest if parent else None

    def _read(self, attributes: str) -> str:
        found = {}
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), html.unescape(a or b or c))
        names = found.get("class", "") + " " + found.get("id", "")
        words = set(_WORD.findall(_CAMEL.sub(" ", names).lower()))
        role = found.get("role", "").lower()
        self.landmark |= role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
        if self.tag not in ("html", "body", "main", "article"):
            self.side |= bool(words & SIDE_NAMES) or role in SIDE_ROLES
            self.weak = bool(words & WEAK_NAMES) and self.tag in BLOCK
            self.top |= bool(words & HEADER_NAMES) and not self.framed
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        hidden |= "display:none" in found.get("style", "").replace(" ", "").lower()
        self.side |= hidden
        self.fixed = hidden or bool(words & NO_WRAPPER) or self.tag in ("nav", "dialog", "head", "menu", "button")
        return "." + ".".join(sorted(words)) if words else ""

    def is_side(self, page: Element) -> bool:
        """Whether it is a part beside the article, by itself; ``page`` is the root.

        A part that is one by its name alone is none if it holds the article or
        its title; a page header is none only if it holds the article. One that
        holds most of the page's prose, and its article or title if it has one, is a
        wrapper. A weak name counts only with
        many links or without prose.
        """
        most = page.prose > 0 and self.prose >= WRAPPER * page.prose and self.holds >= page.holds
        if most and not self.fixed and self.tag not in RAW:
            return False
        if self.weak and (self.prose == 0 or self.links > WEAK_LINKS * self.chars) and not self.holds:
            return True
        named = self.side and not (self.holds and self.tag not in RAW and self.tag not in SIDE_TAGS)
        return named or self.top and self.holds < 2

    def aside(self, below: Element | None = None) -> bool:
        """Whether it lies in a side part, under ``below`` if given."""
        return self.sider is not None and (below is None or self.sider.depth > below.depth)

    def under(self, other: Element) -> bool:
        return other.index <= self.index <= other.last


def _settle(elements: list[Element], nodes: list[tuple[Element, str, int]]) -> None:
    """Sums of what each element holds, from the last to the first; then, from the first, the side part it lies in."""
    for element, text, _ in nodes:
        size = len(text.strip())
        element.chars += size
        if element.linked:
            element.links += size
        elif size >= PROSE:
            element.prose += size
    for element in reversed(elements):
        up = element.parent
        if up is not None:
            up.last = max(up.last, element.last)
            up.chars += element.chars
            up.links += element.links
            up.prose += element.prose
            up.holds = max(up.holds, element.holds)
    for element in elements:
        own = element.is_side(elements[0])
        element.sider = element if own else element.parent.sider if element.parent else None


def texts(page: str) -> list[tuple[Element, str, int]]:
    """Every text of a page in order: its element, decoded, and the number of its block."""
    paths: dict[tuple[int, str], int] = {}
    at = Element("", None, "", 0, paths)
    elements, number = [at], Counter()
    out: list[tuple[Element, str, int]] = []
    block, begin = 0, 0

    def add(text: str) -> None:
        if text:
            out.append((at, html.unescape(text), block))

    def leave(to: Element) -> Element:
        up = at
        while up is not to:
            number[up.tag] -= 1
            up = up.parent
        return to

    match = _TAG.search(page)
    while match:
        add(page[begin : match.start()])
        begin = match.end()
        tag = (match[2] or match[5] or "").lower()
        closing = bool(match[1] or match[4])
        if tag:
            if tag in BLOCK:
                block += 1
            if tag == "br" and not closing:
                out.append((at, " ", block))
            if closing:
                if number[tag]:
                    open_ = at
                    while open_.tag != tag:
                        open_ = open_.parent
                    at = leave(open_.parent)
            else:
                at = leave(_closed_by(tag, at, number))
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, begin)
                    begin = end.end() if end else len(page)
                elif tag not in VOID:
                    at = Element(tag, at, match[3] or match[6] or "", len(elements), paths)
                    elements.append(at)
                    number[tag] += 1
        match = _TAG.search(page, begin)
    add(page[begin:])
    _settle(elements, out)
    return out


def _closed_by(tag: str, at: Element, number: Counter) -> Element:
    """Where a new element goes: open elements that it ends are left. ``number`` counts the open ones of each tag."""
    ends, stops = ({"p"}, {"button", "table", "td", "th"}) if tag in CLOSES_P else (set(), set())
    more, more_stops = SIBLINGS.get(tag, (set(), set()))
    for names, limits in ((ends, stops), (more, more_stops)):
        up, last = at, None
        if not any(number[n] for n in names):
            continue
        while up.parent and up.tag not in limits:
            if up.tag in names:
                last = up
            up = up.parent
        if last:
            at = last.parent
    return at


def content_paths(nodes: list[tuple[Element, str, int]]) -> set[int]:
    """Paths whose fused and smoothed ratios stand out of the page's spread."""
    length, marks, number = defaultdict(int), defaultdict(int), defaultdict(int)
    for element, text, _ in nodes:
        length[element.path] += len(_SPACE.sub(" ", text).strip())
        marks[element.path] += len(_PUNCTUATION.findall(text))
        number[element.path] += 1
    score = {p: length[p] / number[p] * math.log1p(1 + marks[p] / number[p]) for p in number}
    row = [0.0 if e.aside() or e.tag == "a" else score[e.path] for e, _, _ in nodes]
    if not any(row):
        return set()
    edge = [row[0], *row, row[-1]]
    smooth = [sum(w * edge[i + j] for j, w in enumerate(SMOOTH)) if row[i] else 0.0 for i in range(len(row))]
    mean = sum(smooth) / len(smooth)
    limit = SPREAD * math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    by_path: dict[int, list[float]] = defaultdict(list)
    for (element, _, _), s in zip(nodes, smooth, strict=True):
        by_path[element.path].append(s)
    return {p for p, s in by_path.items() if sum(s) / len(s) >= limit and any(s)}


def container(nodes: list[tuple[Element, str, int]]) -> Element | None:
    """The element that holds the article: the landmark with most text on content paths, else their common ancestor."""
    paths = content_paths(nodes)
    chosen = [(e, t) for e, t, _ in nodes if e.path in paths and t.strip() and not e.aside()]
    if not chosen:
        return None
    weight: dict[Element, int] = defaultdict(int)
    for element, text in chosen:
        mark = element.outer or element.nearest
        if mark:
            weight[mark] += len(text)
    if weight:
        best = max(weight.values())
        return next(e for e, n in weight.items() if n == best)
    common = chosen[0][0]
    for element, _ in chosen[1:]:
        while not element.under(common):
            common = common.parent
    while common.parent and common.tag not in BLOCK:
        common = common.parent
    return common


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by an empty line."""
    nodes = texts(page or "")
    home = container(nodes)
    if home is None:
        return ""
    loose = home.tag in ("", "html", "body")
    blocks: dict[int, list[str]] = defaultdict(list)
    linked: dict[int, int] = defaultdict(int)
    for element, text, block in nodes:
        if element.under(home) and not element.aside(home):
            blocks[block].append(text)
            if loose and element.linked:
                linked[block] += len(text.strip())
    out = []
    for block, parts in blocks.items():
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text and not linked[block] > LINKS * len(text):
            out.append(text)
    return "\n\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "html"):
        found = [main_text(page) for page in batch.column("html").to_pylist()]
        yield arrow_batch(
            {
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(found, pa.string()),
                "n_chars": pa.array([len(t) for t in found], pa.int64()),
            }
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html, ...)``.

    The text is that of the article without side parts: menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and reader comments, unless
    such a part holds the article itself. Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by an empty line; nothing is cut. A null
    or textless page has empty text. Repeated rows are extracted each; other
    columns are ignored; an empty table gives an empty result.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
