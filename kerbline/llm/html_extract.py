"""Main text of HTML pages by tree scoring.

A page becomes a tree of elements and, in page order, its blocks of text. Furniture (scripts, menus, notices, ...)
is known by tag, role or name and gives no blocks. A name that is more than the furniture's own (``film-review``,
``right-sidebar``), and a form, are evidence only: taken back where most of the page's text is in there. Each paragraph earns points for its length and
its commas and passes them to its ancestors, less with every level; an element's score is discounted by its link
density. The best container is kept with those siblings that are text like it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of HTML: elements that hold no content of their own, and elements that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
FURNITURE = frozenset("head script style noscript template svg math canvas iframe object embed audio video map nav footer aside button select option textarea input dialog menu menuitem".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|\s|(?<!\bhas)(?<!\bwith)(?<!\bno)[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|footer|masthead|site-?header|page-?header|header|topbar|"
    r"comments?|comment-?list|disqus|respond|replies|reviews?|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|"
    r"related|recommended|recommendations|pagination|pager|toolbar|widget|skip|search|form)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: What may stand around a furniture word in a name that means the furniture itself.
_GENERIC = r"(?:list|section|area|box|thread|container|wrapper|wrap|block|content|body|inner|item|items|bar|unit|slot|text|links?|buttons?|banner|menu|nav|widget|top|bottom|\d+)"
_OWN = re.compile(
    r"(?:site|page|main|global|top|bottom|user|reader|blog|post|article|cookie|social|share|related|sticky|google|nav)?[-_]?"
    r"(?:ads?|advert|advertisement|adsense|sponsor(?:ed)?|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|footer|masthead|header|topbar|comments?|disqus|respond|replies|reviews|"
    r"cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|related|recommended|recommendations|pagination|pager|toolbar|widget|search)"
    rf"(?:[-_]?{_GENERIC})*",
    re.IGNORECASE,
)
#: Heads of an article by name: their headings are text, their bylines are not.
_HEAD = re.compile(r"(?:entry|post|article|content|story|title|chapter|section)[-_]?header", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Elements that the main text is marked with, and those that head a part of it.
MARKED = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Start tags that end an open paragraph, and items that end their like.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "body", "td", "th", "tbody", "thead"))
#: Points: a paragraph, each comma, each so many characters up to a most; and what a sibling needs of the best.
BASE, COMMA, PER_CHARS, MOST_LENGTH, SIBLING = 1.0, 1.0, 100, 3.0, 0.2
#: Of its points an element passes so much to its parent, and of what came from below so much further up.
FIRST_UP, FURTHER_UP = 0.5, 0.66
#: Characters that an element with furniture's name needs to be taken for the main text.
LEAST_REPRIEVED = 250
LISTS = frozenset(("ul", "ol", "dl"))


class Node:
    """``drop``: 1 where only headings count (an article's own header), 2 for furniture by tag or role.
    ``named``: furniture by its name, unless a marked element turns up in it; ``maybe``: the name is evidence only."""

    __slots__ = ("tag", "parent", "drop", "named", "maybe", "marks", "own", "carry", "chars", "linked", "items", "whole", "marked", "kept", "gone")

    def __init__(self, tag: str, parent: Node | None, drop: int = 0, named: bool = False, maybe: bool = False):
        self.tag, self.parent, self.drop, self.named, self.maybe = tag, parent, drop, named, maybe
        self.own, self.carry, self.chars, self.linked, self.items = 0.0, 0.0, 0, 0, 0
        self.whole, self.marked, self.marks = 0.0, 0, False  # points and marked blocks within; holds a marked element
        self.kept = self.gone = False

    def density(self) -> float:
        return self.linked / max(self.chars, 1)

    def score(self) -> float:
        return (self.own + self.carry) * (1 - self.density()) * (1.5 if self.tag in MARKED else 1.0)


def _furniture(tag: str, attrs: dict[str, str | None]) -> bool:
    return tag in FURNITURE or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or HIDDEN.search(attrs.get("style") or "") is not None or (attrs.get("role") or "").lower() in ROLES


def _named(tag: str, attrs: dict[str, str | None]) -> tuple[bool, bool]:
    """Whether the element's name is furniture's, and whether that is no more than evidence."""
    if tag == "main":
        return False, False
    found = [x for k in ("class", "id") for x in (attrs.get(k) or "").split() if NAMES.search(x) and not _HEAD.fullmatch(x)]
    named = bool(found) or tag in ("form", "fieldset") or (attrs.get("role") or "").lower() == "form"
    return named, named and not any(_OWN.fullmatch(x) for x in found)


class Tree(HTMLParser):
    """Elements and blocks of one page; closes what the page forgot to close, and survives stray end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.nodes = [self.root]  # parents before their children
        self.count: Counter[str] = Counter()  # open elements by tag
        self.blocks: list[tuple[Node, str, int]] = []  # element, text, characters in links
        self.open: list[str] = []  # inline elements
        self.parts: list[str] = []
        self.linked = 0

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and (not self.at.drop or self.at.drop == 1 and self.at.tag in HEADINGS):
            self.blocks.append((self.at, text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def leave(self, node: Node) -> None:
        """Close the element and all within it."""
        self.end_block()
        while self.at is not node:
            self.count[self.at.tag] -= 1
            self.at = self.at.parent
        self.count[node.tag] -= 1
        self.at = node.parent
        self.open.clear()

    def within(self, tags: tuple[str, ...], stop: frozenset[str]) -> Node | None:
        n = self.at
        while n is not self.root and n.tag not in tags:
            if n.tag in stop:
                return None
            n = n.parent
        return n if n.tag in tags and n is not self.root else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = dict(attrs)
        if tag in ("body", "html"):
            return
        if tag in INLINE and (tag == "br" or not _furniture(tag, known)):
            if tag == "br":
                self.parts.append(" ")
            elif tag not in VOID:
                self.open.append(tag)
            return
        if tag in VOID and tag != "hr":
            return
        if tag in ENDS_P and self.count["p"] > 0 and (p := self.within(("p",), SCOPE)):
            self.leave(p)
        if tag in ENDS_LIKE and any(self.count[t] > 0 for t in ENDS_LIKE[tag]) and (n := self.within(ENDS_LIKE[tag], SCOPE - set(ENDS_LIKE[tag]))):
            self.leave(n)
        self.end_block()
        if tag == "hr":
            return
        if self.at.tag == "head" and tag not in ("script", "style", "title", "noscript", "template"):  # a head left open
            self.leave(self.at)
        drop = 2 if _furniture(tag, known) else 0 if tag != "header" else 1 if self.count["article"] or self.count["main"] else 2
        if any(_HEAD.fullmatch(x) for k in ("class", "id") for x in (known.get(k) or "").split()):
            drop = 1 if tag == "header" else max(drop, 1)
        self.at = Node(tag, self.at, max(drop, self.at.drop), *_named(tag, known))
        self.nodes.append(self.at)
        self.count[tag] += 1
        if tag in MARKED and not self.at.named:
            n = self.at.parent
            while n is not None and not n.marks:  # those further up are done already
                n.named, n.marks = False, True
                n = n.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and self.at.tag == tag and tag in ("svg", "path", "object"):
            self.leave(self.at)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            if tag in self.open:
                while self.open.pop() != tag:
                    pass
                return
            if self.at.tag != tag:
                return
        if self.count[tag] > 0:
            n = self.at
            while n.tag != tag:
                n = n.parent
            self.leave(n)

    def handle_data(self, data: str) -> None:
        if self.at.drop < 2:
            self.parts.append(data)
            if "a" in self.open:
                self.linked += len("".join(data.split()))


def _points(text: str) -> float:
    return BASE + COMMA * text.count(",") + min(len(text) / PER_CHARS, MOST_LENGTH)


def _reprieve(tree: Tree) -> None:
    """Take back what a name suggests about an element with most of the page's paragraph points, several hundred
    characters of text among few links, if no element that marks the main text lies outside it."""
    total, marked = 0.0, 0
    for n in tree.nodes[1:]:  # within furniture by its own name, or within a marked element
        n.gone = n.parent.gone or n.named and not n.maybe
        n.kept = n.parent.kept or n.tag in MARKED and not n.named
    for node, text, linked in tree.blocks:
        if not node.gone:
            p = _points(text) if linked * 2 < len(text) else 0.0
            node.whole, node.chars, node.marked = node.whole + p, node.chars + len(text) * (p > 0), node.marked + node.kept
            total, marked = total + p, marked + node.kept
    for n in reversed(tree.nodes[1:]):
        n.parent.whole, n.parent.chars, n.parent.marked = n.parent.whole + n.whole, n.parent.chars + n.chars, n.parent.marked + n.marked
    for n in tree.nodes:
        if n.maybe and n.named and 2 * n.whole > total and n.chars >= LEAST_REPRIEVED and n.marked == marked:
            n.named = False
        n.gone = n.kept = False
        n.chars = 0


def main_text(html: str | None) -> str:
    """The page's main text: its blocks joined by an empty line; empty where there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.end_block()
    nodes = tree.nodes
    _reprieve(tree)
    for n in nodes[1:]:
        n.gone = n.named or n.parent.gone
    blocks = [x for x in tree.blocks if not x[0].gone]
    if not blocks:
        return ""
    for node, text, linked in blocks:
        first = node if node.tag in SCOPE or node.parent is None else node.parent
        first.own += _points(text)
        node.chars += len(text)
        node.linked += linked
        node.items += 1
    for n in reversed(nodes[1:]):
        up = n.parent
        up.carry += FIRST_UP * n.own + FURTHER_UP * n.carry
        up.chars += n.chars
        up.linked += n.linked
        up.items += n.items
    best = max((n for n in nodes if n.items), key=Node.score)
    n = best
    while n is not None:  # the whole article, if the best container is within one
        best = n if n.tag in MARKED else best
        n = n.parent
    least = SIBLING * best.score()
    for n in nodes:
        n.kept = n is best or (n.parent is not None and n.parent is best.parent and n.items > 0 and n.density() < 0.5 and (n.score() >= least or n.tag in MARKED or n.drop == 1 or n.tag == "p" and n.density() < 0.25))
        n.gone = n.tag in LISTS and n.items >= 3 and n.density() >= 0.8  # a menu without a name
    for n in nodes[1:]:
        n.kept, n.gone = n.kept or n.parent.kept, n.gone or n.parent.gone
    return "\n\n".join(text for node, text, _ in blocks if node.kept and not node.gone)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page (page_id, url, html), whole and in place: no shuffle.

    Null or empty html, and html without text, give an empty text. Null ids and urls stay null; repeated rows
    are extracted each; other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [main_text(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
