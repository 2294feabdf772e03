"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text. A line weighs as many characters as it has outside
links; lines of menus, headers, footers, sidebars, notices, adverts, forms and reader comments weigh nothing and
stand as ``WINDOW`` empty lines, so the distribution falls to zero there. Where a page marks its article, lines
outside it weigh nothing and each line inside weighs at least ``SURGE``. The sums over sliding windows of
``WINDOW`` lines rise above the threshold at a surge point and fall below it at a dive point; the text between is
kept, with the lines next to it that belong to the same element.

Every page is handled on its own in one pass over its characters: there is no shuffle and no page is cut.
"""
from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import tidy

#: Lines that are summed, the sum at which text surges, and the sum below which it dives.
WINDOW = 3
SURGE = 80
DIVE = 20

# Elements of HTML by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SIDE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "svg", "object", "audio", "video",
        "canvas", "map", "fieldset", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT_BLOCKS = {"p", *HEADINGS, "li", "dt", "dd", "td", "th", "pre", "caption", "figcaption", "summary", "address"}
BLOCKS = TEXT_BLOCKS | SIDE | {
    "html", "body", "div", "section", "article", "main", "header", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr",
    "blockquote", "figure", "details", "center", "hgroup", "search", "hr"}
#: An opening tag closes the first of these that is open, up to the listed borders.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
              "menubar", "toolbar"}
SIDE_NAMES = {
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar",
    "header", "masthead", "banner", "footer", "colophon", "copyright", "sidebar", "aside", "rail", "widget", "widgets", "ad", "ads",
    "advert", "adverts", "advertisement", "advertising", "adsense", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion",
    "notice", "notices", "alert", "cookie", "cookies", "consent", "gdpr", "disclaimer", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "search", "form", "share", "sharing", "social", "related", "recommended",
    "comment", "comments", "respond", "replies", "disqus"}
#: Names that take the sense from a side name in the same word of a class: has-sidebar, no-comments, comment-free.
NEUTRAL_NAMES = {"has", "no", "with", "without", "free", "layout"}
MAIN_NAMES = {"articlebody", "mainentity"}
#: Paragraphs and parts of lists, tables and quotes: their lines belong to the element around the whole.
PARTS = TEXT_BLOCKS | {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "blockquote", "figure", "hgroup"}
#: Elements nested deeper are taken as children of the element at this depth, as browsers do; their text stays.
MAX_DEPTH = 512

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_ATTRIBUTES_END = re.compile(r"[\s/]*>")
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class _Element:
    __slots__ = ("name", "parent", "side", "named", "main", "holds_main", "article", "depth", "home")

    def __init__(self, name, parent, side=False, named=False, main=False):
        self.name, self.parent, self.side, self.named, self.main = name, parent, side, named, main
        self.holds_main = False
        self.article = parent is not None and (parent.article or parent.main)
        self.depth = 0 if parent is None else parent.depth + 1
        self.home = parent.home if name in PARTS and parent is not None else self


class _Line:
    __slots__ = ("parts", "plain", "element", "kind", "text", "weight")

    def __init__(self, element, kind):
        self.parts, self.plain, self.element, self.kind = [], [], element, kind


def _attributes(page: str, at: int) -> tuple[dict, int]:
    """Attributes of a tag from ``at`` on, and the place after the tag. A quote that never closes ends at the next '>'."""
    found: dict[str, str] = {}
    while True:
        end = _ATTRIBUTES_END.match(page, at)
        if end:
            return found, end.end()
        m = _ATTRIBUTE.match(page, at)
        if m is None or m.end() == at:
            close = page.find(">", at)
            return found, len(page) if close < 0 else close + 1
        found.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
        at = m.end()


def _is_side_name(words: str) -> bool:
    for word in words.split():
        names = {n.lower() for n in _NAME.findall(word)}
        if names & SIDE_NAMES and not names & NEUTRAL_NAMES:
            return True
    return False


def _element(name: str, attributes: dict, parent: _Element | None) -> _Element:
    role = attributes.get("role", "").strip().lower()
    inside = parent is not None and (parent.article or parent.main)
    main = name in ("article", "main") or role in ("article", "main") or attributes.get("itemprop", "").lower() in MAIN_NAMES
    style = attributes.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    side = name in SIDE or role in SIDE_ROLES or hidden or (name == "header" and not inside)
    # an article within an article is a reader's comment on it
    side = side or (inside and name == "article" and _within(parent, "article"))
    named = name not in ("html", "body", "main", "article") and not main and _is_side_name(
        attributes.get("class", "") + " " + attributes.get("id", ""))
    return _Element(name, parent, side, named, main and not side)


def _within(element: _Element | None, name: str) -> bool:
    while element is not None:
        if element.name == name:
            return True
        element = element.parent
    return False


def _lines(page: str) -> list[_Line]:
    """The blocks of text of a page, each with the element it stands in."""
    lines: list[_Line] = []
    top = _Element("", None)
    line = None
    links = at = 0
    no_comment_end = False

    def say(text):
        nonlocal line
        if line is None:
            line = _Line(top, top.name)
            lines.append(line)
        line.parts.append(text)
        if not links:
            line.plain.append(text)

    while at < len(page):
        lt = page.find("<", at)
        if lt != at:
            text = page[at:lt if lt >= 0 else len(page)]
            if line is not None or not text.isspace():
                say(html.unescape(text) if "&" in text else text)
            if lt < 0:
                break
        if page.startswith("<!--", lt):
            end = -1 if no_comment_end else page.find("-->", lt + 4)
            if end < 0:  # never closed: only its opening mark is markup
                no_comment_end = True
                end = page.find(">", lt)
                at = len(page) if end < 0 else end + 1
            else:
                at = end + 3
            continue
        if page.startswith(("<!", "<?"), lt) or page.startswith("</", lt) and not page[lt + 2:lt + 3].isalpha():
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            say("<")
            at = lt + 1
            continue
        name = m[2].lower()
        attributes, at = _attributes(page, m.end())
        if m[1]:
            if name == "a":
                links = 0
            elif name in BLOCKS:
                line = None
                e = top
                while e.parent is not None and e.name != name:
                    e = e.parent
                if e.parent is not None:  # a tag that closes nothing is passed over
                    top = e.parent
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        if name == "br":
            if line is not None:
                say("\n")
            continue
        if name == "a":
            links = 1
        if name not in BLOCKS:
            continue
        line, links = None, 0
        if name in VOID:
            continue
        if name in CLOSES:
            ends, borders = CLOSES[name]
            e = top
            while e.parent is not None and e.name not in ends and e.name not in borders:
                e = e.parent
            if e.name in ends:
                top = e.parent
        e = top  # a paragraph ends where any block begins
        while e.name == "p" or e.name in HEADINGS:
            e = e.parent
        while e.depth >= MAX_DEPTH:
            e = e.parent
        top = _element(name, attributes, e)
        if top.main:
            while e is not None and not e.holds_main:
                e.holds_main = True
                e = e.parent
    return lines


def _weigh(lines: list[_Line]) -> list[_Line]:
    """Lines with text, weighed; a run of lines that weigh nothing by markup leaves ``WINDOW`` empty lines."""
    kept = []
    for line in lines:
        line.text = " ".join("".join(line.parts).split())
        if line.text:
            kept.append(line)
    sides: dict[int, bool] = {}

    def side(e: _Element | None) -> bool:
        path = []
        while e is not None and id(e) not in sides:
            path.append(e)
            e = e.parent
        known = sides[id(e)] if e is not None else False
        for x in reversed(path):
            known = sides[id(x)] = known or x.side or (x.named and not x.holds_main)
        return known

    marked = any((x.element.main or x.element.article) and not side(x.element) for x in kept)
    gap = _Line(None, "")
    gap.text, gap.weight = "", 0
    out: list[_Line] = []
    for line in kept:
        e = line.element
        if side(e):
            # the headline may stand in the header of the article itself
            if not (line.kind in HEADINGS and e.article and _only_header(e)):
                line = None
        elif marked and not (e.main or e.article):
            line = None
        if line is None:
            if out and out[-1] is not gap:
                out += [gap] * WINDOW
            continue
        line.weight = len("".join("".join(line.plain).split()))
        if marked:
            line.weight = max(line.weight, SURGE)
        out.append(line)
    return out


def _only_header(e: _Element) -> bool:
    """Whether nothing but names like 'header' makes the element a side part of its article."""
    while e is not None and not e.main:
        if e.side or e.named and e.name != "header":
            return False
        e = e.parent
    return e is not None


def _blocks(lines: list[_Line]) -> list[bool]:
    """Which lines lie between a surge and a dive of the window sums, or beside them in the same element."""
    n = len(lines)
    weight = [x.weight for x in lines]
    sums = [sum(weight[i:i + WINDOW]) for i in range(n)]
    top = max(sums, default=0)
    surge = min(SURGE, top / 2)
    dive = min(DIVE, surge)
    keep = [False] * n
    at = 0
    while at < n:
        if not (weight[at] and sums[at] >= surge and sums[at] > 0):
            at += 1
            continue
        end = at
        while end < n and lines[end].element is not None and sums[end] >= dive:
            end += 1
        first, last = at, end - 1
        while first > 0 and _joins(lines, first - 1, first):
            first -= 1
        while last + 1 < n and _joins(lines, last + 1, last):
            last += 1
        keep[first:last + 1] = [True] * (last + 1 - first)
        at = max(end, last + 1)
    return keep


def _joins(lines: list[_Line], i: int, j: int) -> bool:
    """Whether the light line i goes with its kept neighbour j: the same element, or the heading above it."""
    a, b = lines[i], lines[j]
    if a.element is None or b.element is None or not a.weight and a.kind not in HEADINGS:
        return False
    if a.element.home is b.element.home:
        return True
    if a.kind not in HEADINGS or i > j:
        return False
    e = b.element
    while e is not None and e is not a.element.home:
        e = e.parent
    return e is not None


def main_text(page: str) -> str:
    """The main text of one page: its blocks in page order, two new lines between them. Empty if there is none."""
    lines = _weigh(_lines(page))
    return "\n\n".join(x.text for x, keep in zip(lines, _blocks(lines), strict=True) if keep and x.text)


def _run(batches):
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null or empty html, and a page without main text, give an empty text. Null and repeated ids and urls are
    passed on row by row; other columns are ignored. A reference that no table knows stays as it is written.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidy(_run), "page_id long, url string, text string, n_chars long")
