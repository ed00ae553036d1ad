"""Main text of HTML pages by tree scoring.

A page is cut into tags and text without building objects for what cannot matter (scripts,
styles, comments). Every paragraph of some length gives points for itself, its commas and its
length to its parent and half of them to its grandparent; containers start with points for their
element and lose them for names that speak of boilerplate; what a container has is discounted by
the share of its text that stands in links. The best container is kept, with all of its siblings
that are not boilerplate or mostly links, whatever their element and length; menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are never part of it. Names alone do not decide what those are: an element around the
article stays whatever its name, be it a form, and one whose name says something else too (market-share) goes only if
it holds links or no prose; has-, no- and with- begin names of layouts.

Every pass over the tree takes time in proportion to the page, however deep its elements nest.

Defined cases: a null or blank page, and one without text outside boilerplate, gives the empty
text; a page that is one form, or one wrapper with a name of boilerplate, is read like any other; an unclosed element ends with its parent, and a paragraph with the next block; a cut-off
tag at the end is dropped; equal pages give equal texts; on equal scores the first container
wins; rows that repeat a page_id, and null ids and urls, come back as they are; very long pages are
parsed whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from hustings.llm.common import prepare, steps, texts

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)(/?)(?:>|\Z)|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^<]*\Z)""", re.DOTALL)
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea xmp noembed noframes".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article's text.
BOILERPLATE = frozenset("nav header footer aside button select menu dialog head label input option".split())
#: Elements that are boilerplate unless the page's article stands in them.
WRAPPERS = frozenset(("form", "fieldset"))
#: Elements that hold paragraphs, with the points they start with.
CONTAINERS = {"article": 25, "main": 20, "section": 5, "div": 5, "td": 3, "blockquote": 3, "body": 0}
#: Words in class and id that speak of boilerplate, of reader comments, and of nothing but place and shape.
NEGATIVE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline cookie cookies consent footer header login masthead menu modal nav navbar navigation newsletter notice outbrain pager pagination "
    "popup promo promoted related share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe taboola teaser toolbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
SHAPES = frozenset(
    "active area articles bar block bottom box buttons card center col column container content cta desktop element fixed float form global group icons inline inner item items left link links list main mobile more outer "
    "page panel policy popular posts primary reader readers region right row secondary section site slot stories sub tag text thread top unit up user widgets wrap wrapper zone".split()
)
#: Words after which a name says how a page is laid out, not what the element is.
LAYOUT = frozenset("has no with without".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
POSITIVE = re.compile(r"article|body|content|entry|main|page|post|story|text", re.IGNORECASE)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: What a start tag closes if it is open in the same block.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_PARAGRAPH = BLOCK - {"br", "option", "legend"}
#: Where the content of each raw element ends.
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}
#: A paragraph gives points from this length; a sibling stays below this share of links.
LEAST_POINTS, MOST_LINKS = 25, 0.25


class Node:
    __slots__ = ("tag", "parent", "children", "score", "negative", "doubt", "order", "chars", "link_chars", "commas", "prose", "sure", "framed", "holder", "article")

    def __init__(self, tag: str, parent: Node | None, order: int, score: float = 0.0, negative: bool = False, doubt: int = 0) -> None:
        self.tag, self.parent, self.order, self.score, self.negative, self.doubt = tag, parent, order, score, negative, doubt
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.commas = self.prose = self.sure = 0
        self.framed = False
        up = parent
        # nearest container at or above this element, and outermost article or main above it
        self.holder: Node | None = self if tag in CONTAINERS or tag in ("#root", "html") else up.holder if up else None
        self.article: Node | None = None if up is None or up.tag in ("#root", "html", "body") else up.article or (up if up.tag in ("article", "main") else None)


#: What the name of an element leaves open: nothing, whether it is boilerplate, hardly that, hardly that it is comments.
CLEAR, MAYBE, LIKELY, COMMENTARY = range(4)


@lru_cache(maxsize=4096)
def _doubt(value: str) -> int:
    """What a class or id value says: each name in it is split into words, also where capitals start."""
    out = CLEAR
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name)]
        at = next((k for k, w in enumerate(words) if w in LAYOUT), len(words))
        words = words[:at]
        if COMMENTS.intersection(words):
            out = max(out, COMMENTARY if all(w in NEGATIVE or w in COMMENTS or w in SHAPES for w in words) else MAYBE)
        elif NEGATIVE.intersection(words):
            out = max(out, LIKELY if all(w in NEGATIVE or w in SHAPES for w in words) else MAYBE)
    return out


def _named(tag: str, attributes: str) -> tuple[float, bool, int]:
    """Points an element starts with, whether it is hidden or has a role of boilerplate, and what its names leave open."""
    score, negative, doubt = float(CONTAINERS.get(tag, 0)), False, CLEAR
    if attributes:
        for m in NAMES.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                negative = True
            elif name == "style":
                negative |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
            elif name == "role":
                negative |= value.lower() in {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert"}
            elif tag not in ("body", "html", "article", "main") and (said := _doubt(value)):
                doubt = max(doubt, said)
            elif POSITIVE.search(value):
                score += 10
    return score, negative, doubt


#: End tags do not reach out of these, but for end tags of the page's own frame.
WALLS, THROUGH = frozenset(("article", "main", "body", "td")), frozenset(("body", "html", "article", "main", "table"))


class _Open:
    """The open elements of a page, innermost last, with the places of each tag, of walls and of blocks among them."""

    def __init__(self, root: Node) -> None:
        self.path = [root]
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.blocks: list[int] = []
        self.ends: list[int] = []  # elements that end a paragraph

    def push(self, node: Node) -> None:
        at = len(self.path)
        self.path.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in WALLS:
            self.walls.append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)
        if node.tag in ENDS_PARAGRAPH:
            self.ends.append(at)

    def cut(self, at: int) -> None:
        """Close the element at this place and all within; each element is closed once."""
        while len(self.path) > at:
            tag = self.path.pop().tag
            self.places[tag].pop()
            for kept in (self.walls, self.blocks, self.ends):
                if kept and kept[-1] >= len(self.path):
                    kept.pop()

    def close(self, tag: str) -> bool:
        """Whether an end tag finds an element that it may close."""
        at = self.places.get(tag)
        if not at:
            return False
        if tag not in THROUGH and self.walls and self.walls[-1] > at[-1]:
            return False
        self.cut(at[-1])
        return True


def parse(html: str) -> Node:
    """The page as a tree of elements; text of raw elements and comments is left out."""
    root = Node("#root", None, 0)
    open_ = _Open(root)
    order, at, end = 0, 0, len(html)
    while at < end:
        node = open_.path[-1]
        m = TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            node.children.append(html[at:stop])
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if not open_.close(tag) and tag == "p":
                node.children.append(Node("br", node, order))
            continue
        if tag in RAW:
            close = RAW_ENDS[tag].search(html, at)
            at = close.end() if close else end
            continue
        if tag in ENDS_PARAGRAPH and open_.ends and open_.path[open_.ends[-1]].tag == "p":
            open_.cut(open_.ends[-1])
        if tag in CLOSES:
            while open_.blocks and open_.path[open_.blocks[-1]].tag in CLOSES[tag]:
                open_.cut(open_.blocks[-1])
        order += 1
        score, negative, doubt = _named(tag, m[3])
        node = open_.path[-1]
        child = Node(tag, node, order, score, negative or tag in BOILERPLATE, max(doubt, LIKELY) if tag in WRAPPERS else doubt)
        node.children.append(child)
        if tag not in VOID and not m[3].endswith("/") and not m[4]:
            open_.push(child)
    return root


def _settle(root: Node) -> None:
    """Decide on elements whose names leave it open whether they are boilerplate.

    An element stays if the page's article stands in it: an article, a main element or a first heading, and most of the
    page's prose that stands in no element with a name of boilerplate; or three quarters of it on a page that has none of these (comments never for that). Of the rest, names that say nothing but boilerplate
    go, and others go if the tree agrees: mostly links, or no prose. What stays with a doubtful name loses points.
    """
    stack: list[tuple[Node, bool]] = [(root, False)]
    doubtful = []
    while stack:
        node, done = stack.pop()
        if not done:
            if node.doubt and not node.negative:
                doubtful.append(node)
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if not isinstance(c, str) and not c.negative)
            continue
        own = 0
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
            elif not c.negative:
                node.prose += c.prose
                node.sure += c.sure if c.framed or c.doubt < LIKELY else 0
                node.framed |= c.framed
                node.chars += c.chars
                node.link_chars += c.link_chars
                own += c.chars if c.tag not in BLOCK and c.tag != "a" and not c.prose else 0
        node.framed |= node.tag in ("article", "main", "h1")
        node.chars += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars = node.chars
        elif own >= LEAST_POINTS and (node.tag in BLOCK or node is root):
            node.prose += own
            node.sure += own
    for node in doubtful:
        most = node.sure >= 0.5 * root.sure > 0 and node.framed or not root.framed and node.doubt != COMMENTARY and node.prose >= 0.75 * root.prose > 0
        agrees = node.doubt != MAYBE or not node.prose or _density(node) >= MOST_LINKS
        node.negative = not most and agrees
        if not node.negative and node.tag not in WRAPPERS:
            node.score -= 10


def _measure(root: Node) -> list[Node]:
    """Lengths of text and link text, and commas, of every element outside boilerplate; elements in page order."""
    out: list[Node] = []
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        node, linked, done = stack.pop()
        if done:
            node.chars = node.link_chars = 0
            for c in node.children:
                if isinstance(c, str):
                    n = len(" ".join(unescape(c).split()))
                    node.chars += n
                    node.link_chars += n if linked else 0
                    node.commas += c.count(",")
                elif not c.negative:
                    node.chars += c.chars
                    node.link_chars += c.link_chars
                    node.commas += c.commas
            continue
        out.append(node)
        linked = linked or node.tag == "a"
        stack.append((node, linked, True))
        stack.extend((c, linked, False) for c in reversed(node.children) if not isinstance(c, str) and not c.negative)
    return out


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def best_container(nodes: list[Node]) -> Node | None:
    """Paragraphs pass points to parent and grandparent; containers are compared after the discount for links."""
    candidates: dict[int, Node] = {}
    for node in nodes:
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        paragraph = node.tag in ("p", "pre", "td", "blockquote", "li") or node.tag in CONTAINERS and own >= LEAST_POINTS
        if not paragraph or node.chars < LEAST_POINTS:
            continue
        points = 1 + node.commas + min(node.chars // 100, 3)
        targets = [node, node.parent] if node.tag in CONTAINERS and own >= LEAST_POINTS else [node.parent, node.parent.parent if node.parent else None]
        for target, share in zip(targets, (1.0, 0.5)):
            target = target and target.holder
            if target is not None:
                target.score += points * share
                candidates[id(target)] = target
    if not candidates:
        return None
    return max(sorted(candidates.values(), key=lambda n: n.order), key=lambda n: n.score * (1 - _density(n)))


def blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts of blocks in page order, white space made single; text is cut where a block starts or ends."""
    held: list[str] = []

    def flush() -> str:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        return text

    stack: list[tuple[Node | str, bool]] = [(n, False) for n in reversed(nodes)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            held.append(node)
            continue
        if node.negative:
            if node.tag in BLOCK and (text := flush()):
                yield text
            continue
        if node.tag in BLOCK and (text := flush()):
            yield text
        if not done:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    if text := flush():
        yield text


def extract(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    root = parse(html)
    _settle(root)
    nodes = _measure(root)
    best = best_container(nodes)
    if best is None:  # no paragraph of any length: whatever an article or the page holds
        named = [n for n in nodes if n.tag in ("article", "main", "body")]
        return " ".join(blocks([named[-1] if named and named[-1].chars else root]))
    best = best.article or best  # an article around the best container is taken whole
    keep = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        keep = [c for c in best.parent.children if c is best or isinstance(c, str) or not c.negative and _density(c) < MOST_LINKS]
    elif best.tag == "article" and best.parent is not None:  # an article in parts
        keep = [c for c in best.parent.children if c is best or not isinstance(c, str) and c.tag == "article" and not c.negative and c.score * (1 - _density(c)) >= 0.5 * best.score]
    return " ".join(blocks(keep))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                found = [extract(h) for h in texts(part.column("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
