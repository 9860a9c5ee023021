"""Operator 4: main text of web pages by minimum-cut labelling.

A page is read into blocks, each with its path of open elements. A fixed linear
classifier gives every block log-odds of being content; they become the block's
terminal capacities. A form, or an element whose class or id names a part of a layout,
is evidence against its blocks that fades with its share of the page's text, as such names
are also given to wrappers; an article or main element inside that holds text lifts it. Names
of what readers, advertisers and the site's notices add (``STRICT``) are
evidence at every share, unless such an element holds the page's only article or first heading. Neighbouring blocks, and successive blocks of the same
parent, are joined by smoothness edges whose capacity falls with their distance
in the tree and across semantic containers. The minimum cut labels the blocks.
Blocks whose own evidence outweighs all their edges are settled first, which
doesn't change the cut, and maximum flow (shortest augmenting paths) decides
the rest.

Defined cases: null or empty html gives an empty text; unclosed, misnested and
stray tags are read as browsers mostly do; a page without markup is one block;
scripts, styles, comments and the head never become text; an element without text of
its own that is never closed (``<svg/>``, ``<object ... />``, a stray ``<button>``) hides nothing behind it;
very long pages, with any number of unclosed or stray tags, take time in proportion; repeated pages each
get their row; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|head|select|button|canvas|math)(?=[\s/>])[^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?][^>]*>", re.IGNORECASE | re.DOTALL)
_ATTR = re.compile(r"""([a-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

# element groups (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var br img wbr input picture source".split())
NEVER = frozenset("nav footer aside menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
WORDS_AGAINST = frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
                          "consent gdpr notice popup modal overlay menu nav navbar navigation sidebar aside widget footer "
                          "masthead breadcrumb breadcrumbs pagination pager comment comments disqus reply replies "
                          "respond share sharing social related recommended subscribe newsletter signup login search "
                          "toolbar copyright legal disclaimer".split())
#: of these, what is never the text, however much there is of it
STRICT = frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice "
                   "popup modal overlay comment comments disqus reply replies respond subscribe newsletter signup login".split())
WORDS_FOR = frozenset("article content post entry story body main text".split())
ROLES_AGAINST = frozenset("navigation banner contentinfo complementary dialog alertdialog search menu menubar".split())
_LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)[-_]\S+")  # a class that tells what else is on the page
_TO_THE_END = frozenset("script style textarea iframe noscript template".split())  # unclosed, they hide the rest
_NOT_NESTED = frozenset("button select".split())
_CLOSES_P = frozenset("p div article section ul ol li dl dt dd table h1 h2 h3 h4 h5 h6 header footer nav aside form "
                      "blockquote pre hr main figure figcaption address details".split())
_CLOSED_BY_SAME = {"li": "ul ol menu".split(), "dt": ["dl"], "dd": ["dl"], "tr": ["table"], "td": ["tr", "table"],
                   "th": ["tr", "table"], "option": ["select"]}


#: shares of the page's text from which a mark fades, and with which it is gone
FADES, GONE = 0.2, 0.6
#: the same for the lift by an article inside
LIFTS, LIFTED = 0.05, 0.2


@dataclass(eq=False)
class Mark:
    """An element that speaks against its blocks, or an article or main inside such a one."""

    outer: Mark | None
    depth: int
    lifts: str  # element name, or "" for evidence against
    strict: bool = False  # evidence against at every share
    within: bool = False  # inside a strict one, or one itself
    holds: bool = False  # an article or first heading with text
    chars: int = 0
    weight: float = 1.0  # of the blocks' own evidence; the rest is evidence against them


@dataclass
class Element:
    name: str
    parent: Element | None
    depth: int
    against: bool  # a container that holds no main text
    article: bool
    favoured: bool
    mark: Mark | None = None

    @property
    def apart(self) -> bool:
        return self.against or self.mark is not None and self.mark.weight < 0.5


@dataclass
class Block:
    text: str
    element: Element  # the nearest block-level element
    linked: int  # characters inside links


def _element(name: str, attrs: str, parent: Element) -> Element:
    words: set[str] = set()
    hidden, form = False, name == "form"
    if attrs and not attrs.isspace():
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                words.update(w for w in re.split(r"[^a-z]+", _LAYOUT.sub("", value)) if w)
            elif key == "role":
                hidden = hidden or value in ROLES_AGAINST
                form = form or value == "form"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(
                    r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    named = bool(words & WORDS_AGAINST) and name not in ("body", "html", "article", "main", "h1")
    page_header = name == "header" and not parent.article
    against = parent.against or hidden or name in NEVER or page_header
    article = parent.article or name in ARTICLE
    mark = parent.mark
    inside = mark is not None and mark.within
    if named or form:
        strict = named and bool(words & STRICT)
        mark = Mark(mark, parent.depth + 1, "", strict, strict or inside)
    elif mark is not None and name in ARTICLE and not words & WORDS_AGAINST:
        mark = Mark(mark, parent.depth + 1, name, False, inside)
    return Element(name, parent, parent.depth + 1, against, article, parent.favoured or bool(words & WORDS_FOR), mark)


def weigh_marks(blocks: list[Block]) -> None:
    """Set the marks' weights from what they hold and their shares of the page's text."""
    marks: dict[int, Mark] = {}
    total = 0
    elsewhere = False   # is there an article, main or first heading outside the strict marks?
    for b in blocks:
        if b.element.against:
            continue
        total += len(b.text)
        m = b.element.mark
        head = b.element.name == "h1"
        if m is None or not m.within:
            elsewhere = elsewhere or head or b.element.article
        elif head or m.lifts:
            m.holds = True
        if m is not None:
            m.chars += len(b.text)
        while m is not None and id(m) not in marks:
            marks[id(m)] = m
            m = m.outer
    inner_last = sorted(marks.values(), key=lambda m: m.depth)
    for m in reversed(inner_last):
        if m.outer is not None:
            m.outer.chars += m.chars
            m.outer.holds = m.outer.holds or m.holds
    for m in inner_last:
        if m.strict or m.lifts == "article" and m.within:   # no share decides here
            before = m.outer.weight if m.outer is not None else 1.0
            m.weight = before if m.holds and not elsewhere else 0.0
            if m.lifts and m.holds and not elsewhere:
                m.weight = 1.0
            continue
        low, high = (LIFTS, LIFTED) if m.lifts else (FADES, GONE)
        own = min(max((m.chars / total - low) / (high - low), 0.0), 1.0)
        before = m.outer.weight if m.outer is not None else 1.0
        m.weight = 1.0 if m.lifts == "main" else max(before, own) if m.lifts else min(before, own)


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order; white space and references are resolved."""
    root = Element("#root", None, 0, False, False, False)
    here, links = root, 0
    parts: list[str] = []
    linked = 0
    out: list[Block] = []
    opened: dict[str, int] = {}     # open elements by name
    unclosed: dict[str, int] = {}

    def leave(e: Element) -> None:
        """Close everything up to and including an open element."""
        nonlocal here, links
        while True:
            links -= here.name == "a"
            opened[here.name] -= 1
            here = here.parent
            if here is e.parent:
                return

    def block_element(e: Element) -> Element:
        while e.name in INLINE and e.parent is not None:
            e = e.parent
        return e

    def flush(e: Element) -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, block_element(e), min(linked, len(text))))
            parts, linked = [], 0

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        raw = m["raw"]
        if raw:
            raw = raw.lower()
            at = _behind(page, raw, at, m.group().endswith("/>"), unclosed)
            if raw not in ("svg", "math", "button", "canvas"):
                flush(here)
            continue
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["close"]:
            if not opened.get(name):   # nothing to close
                if name not in INLINE:
                    flush(here)
                continue
            e = here
            while e is not root and e.name != name:
                # a closing tag of an inline element doesn't reach beyond its block
                if name in INLINE and e.name not in INLINE:
                    e = root
                    break
                e = e.parent
            if name not in INLINE:
                flush(here)
            if e is not root:
                leave(e)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush(here)
            continue
        if name not in INLINE:
            flush(here)
            if name in _CLOSES_P:
                e = here
                while e.name in INLINE:
                    e = e.parent
                if e.name == "p":
                    leave(e)
            if name in _CLOSED_BY_SAME:
                e = here
                while e is not root and e.name != name and e.name not in _CLOSED_BY_SAME[name]:
                    e = e.parent
                if e.name == name:
                    leave(e)
        here = _element(name, m["attrs"], here)
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
    flush(here)
    return out


def _behind(page: str, raw: str, at: int, empty: bool, unclosed: dict[str, int]) -> int:
    """Where reading goes on behind an opening tag (ending at ``at``) whose content is no text.

    ``unclosed`` remembers names of which no closing tag follows, so that the page is searched once for each.
    """
    if empty and raw not in _TO_THE_END:
        return at
    if raw not in unclosed:
        again = rf"|<(?={raw}[\s/>])" if raw in _NOT_NESTED else ""
        end = re.compile(rf"</{raw}\s*>{again}", re.IGNORECASE).search(page, at)
        if end and end.group() != "<":
            return end.end()
        if end:
            return at      # another one opens before this is closed
        unclosed[raw] = len(page) if raw in _TO_THE_END else 0
        if raw == "head":
            body = re.compile(r"<body\b", re.IGNORECASE).search(page, at)
            unclosed[raw] = body.start() if body else 0
    return max(at, unclosed[raw])


def log_odds(b: Block, has_article: bool) -> float:
    """Evidence that a block is content (positive) or not."""
    e = b.element
    if e.against:
        return -8.0
    own = e.mark.weight if e.mark is not None else 1.0
    return own * _own_odds(b, has_article) - 8.0 * (1.0 - own)


def _own_odds(b: Block, has_article: bool) -> float:
    e = b.element
    share = b.linked / max(len(b.text), 1)
    score = -0.2
    if has_article:
        score += 6.0 if e.article else -5.0
    elif e.favoured:
        score += 3.0
    if e.name in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "td", "figcaption"):
        score += 1.0
    words = b.text.count(" ") + 1
    score += min(words, 40) / 20 - 0.5
    score += 0.5 if b.text[-1] in ".!?:;\"')" else 0.0
    if not e.article:
        score -= 5.0 * share
    if b.text[:1] == "©":
        score -= 4.0
    return score


SMOOTHNESS = 1.0


def _proximity(a: Element, b: Element) -> float:
    """Edge capacity: halves with every element between the blocks, a tenth across containers of other kind."""
    weight = SMOOTHNESS * (1.0 if (a.apart, a.article) == (b.apart, b.article) else 0.1)
    steps = 0
    while a is not b and steps < 12:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return weight * 0.5 ** max(0, steps - 2) if steps < 12 else 0.0


def label(unary: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Minimum-cut labels: True where a block falls to the source (content) side."""
    n = len(unary)
    unary = list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        if w > 0 and i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    out: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # settle what its own evidence decides, and let that weigh on the neighbours
        i = todo.popleft()
        if out[i] is not None or abs(unary[i]) < sum(near[i].values()) or unary[i] == 0 and near[i]:
            continue
        out[i] = unary[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            unary[j] += w if out[i] else -w
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if out[i] is None]
    if rest:
        for i in _source_side(rest, unary, near):
            out[i] = True
    return [bool(x) for x in out]


def _source_side(nodes: list[int], unary: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source side of a minimum cut, by shortest augmenting paths."""
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    source, sink = -1, -2
    cap[source], cap[sink] = {}, {}
    for i in nodes:
        if unary[i] > 0:
            cap[source][i] = unary[i]
            cap[i][source] = 0.0
        else:
            cap[i][sink] = -unary[i]
            cap[sink][i] = 0.0
    while True:
        before = {source: source}
        queue = deque([source])
        while queue and sink not in before:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-12 and v not in before:
                    before[v] = u
                    queue.append(v)
        if sink not in before:
            return {i for i in before if i >= 0}
        path, v = [], sink
        while v != source:
            path.append((before[v], v))
            v = before[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] = cap[v].get(u, 0.0) + flow


def main_text(page: str | None) -> str:
    """The main text: content blocks joined by newlines."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    weigh_marks(blocks)
    has_article = any(b.element.article and not b.element.apart for b in blocks)
    unary = [log_odds(b, has_article) for b in blocks]
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = _proximity(blocks[i - 1].element, b.element)
        parent = id(b.element.parent or b.element)
        j = last_of.get(parent)
        if j is not None and j < i - 1:
            edges[j, i] = 0.5 * _proximity(blocks[j].element, b.element)
        last_of[parent] = i
    return "\n".join(b.text for b, keep in zip(blocks, label(unary, edges), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(p.as_py()) for p in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, text, n_chars``."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
