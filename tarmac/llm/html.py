"""Main text of web pages by tag-path ratios.

A page is read once, in linear time, into text nodes, each with its root-to-leaf tag path (block tags with their class
names; elements deeper than 512 stand beside one another, as browsers have it).  Every path gets two
ratios over the page: text length for each node, and punctuation for each node.  Each ratio, laid out in page order
over the nodes, is smoothed by a short kernel; both are scaled to the page's highest and fused by a product with link
density; paths whose mean fused value passes a share of the page's mean are content.  Headings of a content container,
and further blocks under the same parent path as content at any depth (list items, table cells, captions), are content
with it, if links are less than half of them; of the body itself only what text elements alone lead to.

What a page says of itself comes first: text under navigation, header, footer, aside, form, script, style and the
like, is never content, nor is text under an element that a class or its id names as menu, sidebar, advert, notice or
comments.  A name counts whole: all its words must be such words or say nothing of the content (``comment-list`` and
``ad-slot-2`` count, ``share-price`` and ``form-of-government`` do not).  If an ``article`` or ``main`` element holds most
of the remaining text, only that is scored.

A tag ends at the first ``>`` outside quotes.  If the page ends before that, quotes are left unclosed, and from there on
tags end at the next ``>``; a tag without any is dropped with what follows.

Character references are decoded, white space in a block becomes one space, blocks are trimmed, and those with text are
joined by newlines in page order.  Null and empty pages, and pages without content, give the empty text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.frames import add_columns

# Elements of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select option button canvas object audio video map datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUTSIDE = frozenset("nav header footer aside form menu dialog search head fieldset legend".split())
_CLOSES_P = _BLOCK - {"body", "head", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "legend", "summary"} | {"li", "dd", "dt", "td", "th", "tr"}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "td": ("table",), "th": ("table",), "tr": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
_SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
# Words in class, id and role that name what is not the article.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner promo promoted promotion sponsor sponsored sponsors nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "pagination pager sidebar aside rail widget widgets footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus discussion replies reply respond form search "
    "copyright disclaimer skip hidden toc".split()
)
# Words that may stand beside those and say nothing of what an element holds.
_NEUTRAL = frozenset(
    "site page main top bottom left right upper lower inner outer box block wrap wrapper container content list item items section area bar links link icons icon buttons button media primary secondary "
    "global post posts article articles entry slot unit zone holder panel group first last mobile desktop sticky fixed header footer the a is has js sky leader leaderboard trail text block news message".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NUMBER = re.compile(r"\d+(?:x\d+)?\Z")
#: Deepest element, as browsers have it.
_DEPTH = 512
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# Elements that structure text; a path through these alone leads from a body's text to more of it.
_FLOW = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul".split())
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：¿¡]")
_SPACE = re.compile(r"\s+")


class Block:
    """A run of text between block boundaries: its tag path, text, and letters inside links."""

    __slots__ = ("heading", "inside", "linked", "outside", "parts", "path", "text")

    def __init__(self, path: tuple[str, ...], heading: bool, inside: int, outside: bool) -> None:
        self.path, self.heading, self.inside, self.outside = path, heading, inside, outside
        self.parts: list[str] = []
        self.linked = 0
        self.text = ""


def _outside(name: str, attributes: str, in_article: bool) -> bool:
    if name in _OUTSIDE and not (name == "header" and in_article):
        return True
    if not attributes:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role", "").lower() in _ROLES:
        return True
    if name in ("body", "html", "article", "main"):
        return False
    return any(_named(token, in_article) for key in ("class", "id") for token in found.get(key, "").split())


@lru_cache(20_000)
def _named(token: str, in_article: bool) -> bool:
    """Whether a class or id names what is not the article: all its words are such words, or say nothing, and one is."""
    words = [w.lower() for w in _SPLIT.split(token) if w]
    names = _NAMES - {"header"} if in_article else _NAMES
    return any(w in names for w in words) and all(w in _NAMES or w in _NEUTRAL or _NUMBER.match(w) for w in words)


def tags_of(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, slash, name, attributes)`` of a page's tags in order; of comments and declarations the name is empty."""
    at, lenient = html.find("<"), False
    while at >= 0:
        end = -1
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end, found = (end + 3 if end >= 0 else len(html)), ("", "", "")
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            end, found = (end + 3 if end >= 0 else len(html)), ("", "", "")
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            end, found = (end + 1 if end >= 0 else len(html)), ("", "", "")
        elif match := _TAG.match(html, at):
            stop = match.end()
            while not lenient:
                mark = _STOP.search(html, stop)
                if mark is None:
                    lenient = True
                elif mark[0] == ">":
                    end = mark.end()
                    break
                else:
                    stop = html.find(mark[0], mark.end()) + 1
                    lenient = stop == 0
            if lenient:  # each tag is looked at once more only after the page's last quote was found open
                end = html.find(">", match.end()) + 1 or len(html)
            found = match[1], match[2].lower(), html[match.end() : end - 1] if html[end - 1] == ">" else ""
            if html[end - 1] != ">":
                found = ("", "", "")
        if end < 0:  # a bare "<"
            at = html.find("<", at + 1)
            continue
        skip = yield at, end, *found
        at = html.find("<", max(end, skip or 0))


class Element:
    """An open element, with what holds for all inside it."""

    __slots__ = ("article", "inside", "links", "name", "outside", "path")

    def __init__(self, name: str, path: tuple[str, ...], outside: bool, article: bool, inside: int, links: int) -> None:
        self.name, self.path, self.outside, self.article, self.inside, self.links = name, path, outside, article, inside, links


def blocks_of(html: str) -> list[Block]:
    """The blocks with text of a page, in order."""
    root = Element("", (), False, False, 0, 0)
    stack: list[Element] = [root]
    held: Counter[str] = Counter()  # open elements by name
    out: list[Block] = []
    current: Block | None = None
    endless: set[str] = set()  # raw elements of which no end is left
    made: dict[tuple[int, str], tuple[str, ...]] = {}  # equal paths are one object
    at = 0

    def add(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if current is None:
            if not text.strip():
                return
            block = top.path[-1].partition(".")[0] if top.path else ""
            current = Block(top.path, block in _HEADINGS, top.inside, top.outside)
            out.append(current)
        current.parts.append(text)
        if top.links:
            current.linked += len(text.strip())

    def drop(i: int) -> None:
        """Takes an inline element out; what is inside it stays open."""
        gone = stack.pop(i)
        held[gone.name] -= 1
        if gone.name == "a":
            for inner in stack[i:]:
                inner.links -= 1

    def close(name: str) -> None:
        nonlocal current
        while len(stack) > 1:
            top = stack.pop()
            held[top.name] -= 1
            if top.name in _BLOCK:
                current = None
            if top.name == name:
                return

    tags = tags_of(html)
    token = next(tags, None)
    while token is not None:
        start, end, slash, name, attributes = token
        if start > at:
            add(unescape(html[at:start]))
        at = end
        jump = None
        if name and slash:
            if name == "br" or name == "p" and not held["p"]:
                add(" ") if current else None
            elif held[name]:
                if name in _BLOCK:
                    close(name)
                else:  # an inline end tag does not end the blocks around it
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].name == name:
                            drop(i)
                            break
                        if stack[i].name in _BLOCK:
                            break
        elif name in _RAW:
            close_tag = None if name in endless else _end_of(name).search(html, at)
            if close_tag:
                at = close_tag.end()
            else:
                endless.add(name)
                at = len(html) if name in ("script", "style", "title", "textarea") else at
            jump = at
        elif name == "br":
            add(" ") if current else None
        elif name in _VOID:
            current = None if name == "hr" else current
        elif name:
            if held["p"] and name in _CLOSES_P:
                close("p")
            if name in _SIBLINGS and any(held[n] for n in _SIBLINGS[name]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in _SIBLINGS[name]:
                        close(stack[i].name)
                        break
                    if stack[i].name in _SCOPE[name]:
                        break
            if name in _HEADINGS and stack[-1].name in _HEADINGS:
                close(stack[-1].name)
            if len(stack) > _DEPTH:
                close(stack[-1].name)
            block = name in _BLOCK
            if block:
                current = None
            if not (attributes.endswith("/") and not block):
                top, own = stack[-1], attributes.rstrip("/")
                article = name in ("article", "main")
                classes = _CLASS.search(own) if block and own else None
                path_name = ".".join([name, *sorted((classes[1] or classes[2] or classes[3] or "").split())]) if classes else name
                inside = top.inside or (len(stack) if article else 0)
                path, key = top.path, (id(top.path), path_name)
                if block:
                    path = made.get(key) or made.setdefault(key, (*path, path_name))
                stack.append(Element(name, path, top.outside or _outside(name, own, top.article), top.article or article, inside, top.links + (name == "a")))
                held[name] += 1
        try:
            token = tags.send(jump)
        except StopIteration:
            token = None
    if at < len(html):
        add(unescape(html[at:]))
    for block in out:
        block.text = _SPACE.sub(" ", "".join(block.parts)).strip()
    return [b for b in out if b.text]


@lru_cache(100)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def _smooth(values: np.ndarray) -> np.ndarray:
    kernel = np.array([1.0, 2.0, 1.0])
    return np.convolve(np.pad(values, 1, "edge"), kernel / kernel.sum(), "valid")


def select(blocks: list[Block], threshold: float) -> list[Block]:
    """Blocks of the paths whose smoothed and fused ratios pass ``threshold`` times the page's mean."""
    rest = [b for b in blocks if not b.outside]
    inside = [b for b in rest if b.inside]
    if sum(len(b.text) for b in inside) >= 0.5 * sum(len(b.text) for b in rest):
        rest = inside
    if not rest:
        return []
    objects = {id(b.path): b.path for b in rest}  # few, where blocks share their paths
    paths = {p: i for i, p in enumerate(dict.fromkeys(objects.values()))}
    numbers = {k: paths[p] for k, p in objects.items()}
    which = np.array([numbers[id(b.path)] for b in rest])
    length = np.array([len(b.text) for b in rest], float)
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in rest], float)
    linked = np.array([min(b.linked, len(b.text)) for b in rest], float)
    nodes = np.bincount(which)
    over = lambda v: (np.bincount(which, v) / nodes)[which]
    plain = 1 - over(linked) / over(length)
    text, punctuation = _smooth(over(length)), _smooth(over(marks))
    fused = (text / text.max() + (punctuation / punctuation.max() if punctuation.max() else 0)) * plain
    by_path = np.bincount(which, fused) / nodes
    weight = np.bincount(which, length)
    sparse = np.bincount(which, linked) <= 0.5 * weight
    content = (by_path >= threshold * (by_path * weight).sum() / weight.sum()) & (by_path > 0)
    chosen = [p for p, i in paths.items() if content[i]]
    parents = {p[:-1] for p in chosen}
    starts = {p[:n] for p in chosen for n in range(len(p) + 1)}

    def beside(path: tuple[str, ...], inside: bool) -> bool:
        for n in range(len(path)):
            if path[:n] in parents:
                top = path[n - 1].partition(".")[0] if n else "body"
                if n == len(path) - 1 or inside or top not in ("html", "body") or all(x.partition(".")[0] in _FLOW for x in path[n:]):
                    return True
        return False

    kin: dict[tuple[int, bool], bool] = {}  # by path, as many blocks share one
    out = []
    for block, i in zip(rest, which.tolist(), strict=True):
        if not content[i]:
            if not sparse[i] and 2 * block.linked > len(block.text):
                continue
            key = i, bool(block.inside)
            if key not in kin:
                kin[key] = beside(block.path, key[1])
            if not kin[key] and not (block.heading and block.path[:-1] in starts):
                continue
        out.append(block)
    return out


def main_text(html: str | None, threshold: float = 0.5) -> str:
    return "\n".join(b.text for b in select(blocks_of(html), threshold)) if html else ""


def extract(pages: DataFrame, html: str = "html", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text``, its main text, and ``n_chars``, the text's code points."""

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"text": pa.array([main_text(h, threshold) for h in part.column("_text").to_pylist()], pa.string())}

    out = add_columns(pages, run, {"text": T.StringType()}, html, [c for c in (pages.columns if keep is None else keep) if c.lower() != "n_chars"])
    return out.withColumn("n_chars", F.length("text").cast("long"))
