"""Main text of web pages: a minimum cut separates the blocks of content from boilerplate.

A page is read into blocks: runs of text between the borders of block elements, each with the elements around it. A linear classifier gives
every block the odds of being content, from its words, links and stops and from the names of the elements that hold it. The negative
logarithms of either probability are the block's terminal capacities. Smoothness edges tie neighbouring blocks (the weaker, the more element
borders lie between them; a heading most to what follows it) and, through a node per element, blocks that stand together in the document
tree. A maximum flow between the terminals finds the cut of least cost, and the blocks on the source's side are the text; of several such
cuts the one with the fewest blocks counts.

Capacities are whole thousandths, so results are exact. A node whose own evidence outweighs all its edges has its label in every such cut:
those are settled first, and what is left falls into small graphs, each given to Dinic's algorithm.

The classifier's weights are set by hand (WEIGHTS, REGIONS and the name lists), as no labelled pages exist to fit them on.

Pages are independent: there is no shuffle, and a task holds one batch of them. Reading is linear in a page's length.

Defined cases: null or empty html and pages without content give an empty text; repeated rows give equal texts; unclosed and misnested
elements end where the rules of HTML end them; an unclosed comment, script or tag takes the rest of the page; `<` before anything but a
name, `!`, `?` or `/` is text; br is white space; white space is what Unicode counts as such; columns named text or n_chars are replaced,
others stay; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag; none of it is text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("base head link meta noscript script style template title".split())
#: Elements that an end tag inside them can't close what stands outside of.
SCOPES = frozenset("html table caption td th object button".split())
#: Which open elements a start tag ends.
ENDS = {
    "li": ("li",),
    "dd": ("dd", "dt"),
    "dt": ("dd", "dt"),
    "option": ("option",),
    "tr": ("tr",),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("tr", "thead", "tbody", "tfoot"),
    "tfoot": ("tr", "thead", "tbody"),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Log odds of content that an element gives to all it holds.
REGIONS = {
    "article": 3.0, "main": 2.5, "nav": -8.0, "footer": -6.0, "header": -5.0, "aside": -6.0, "menu": -6.0, "dialog": -6.0, "form": -5.0, "search": -6.0,
    "button": -5.0, "noscript": -5.0, "head": -12.0, "fieldset": -4.0, "option": -6.0,
}
ROLES = {"main": 2.5, "article": 3.0, "navigation": -8.0, "banner": -5.0, "contentinfo": -6.0, "complementary": -6.0, "search": -6.0, "dialog": -6.0, "alert": -5.0, "menu": -6.0, "menubar": -6.0, "toolbar": -5.0}
#: Words in the class or id of an element that speak against or for content, and the log odds of each list.
AGAINST = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner menu menus nav navbar navi navigation
    breadcrumb breadcrumbs sidebar side rail aside footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay
    comment comments commentlist disqus respond reply replies discussion feedback share sharing social follow related recommended recommendations recommendation
    popular trending widget widgets newsletter subscribe subscription signup login signin register search pager pagination tags tagcloud copyright legal disclaimer
    outbrain taboola skip hidden header site-header paywall download""".split()
)
FOR = frozenset("article content entry post story main body text prose".split())
NAMED_AGAINST, NAMED_FOR, UNSEEN = -8.0, 1.5, -12.0
#: Bounds of the sums over all elements that hold a block.
MOST_FOR, MOST_AGAINST = 4.0, -14.0
#: Log odds of a block: as such, per logarithm of its words, for full link text, for ending in a stop, per stop inside, for a heading, for a list item or table cell.
WEIGHTS = {"block": -2.2, "words": 0.75, "links": -4.5, "ends": 1.0, "stops": 0.6, "heading": 0.5, "item": -0.4}
#: Capacity between neighbours, less with every border between them; to the element that holds a block; from element to element.
NEXT, HEADS, HOLDS, NESTS = 1.2, 2.0, 0.4, 0.2
SCALE = 1000

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
STOPS = re.compile(r"[.!?…。！？](?=\s|$)")


@dataclass
class Element:
    name: str
    holder: int  # number of the block element at or above it
    support: float = 0.0  # sum of what speaks for content
    doubt: float = 0.0  # and against
    form: float = 0.0  # and against as part of a form
    in_text: bool = False  # inside an article or main element
    link: bool = False


@dataclass
class Block:
    text: str
    odds: float
    holder: int
    heading: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)  # of each block element: the one around it
    depths: list[int] = field(default_factory=list)


def attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag)}


def names_in(value: str) -> set[str]:
    return {w.lower() for w in WORDS.findall(value)}


def opened(name: str, tag: str, around: Element, holder: int) -> Element:
    """The element that a start tag opens, with what it says of its content."""
    e = Element(name, holder, around.support, around.doubt, around.form, around.in_text or name in ("article", "main"), around.link or name == "a")
    value = REGIONS.get(name, 0.0)
    if name == "header" and around.in_text:
        value = 0.0  # the article's own
    found = attributes(tag) if tag and not tag.isspace() else {}
    if found:
        role = ROLES.get(found.get("role", "").strip().lower())
        value = value if role is None else role
        if name not in ("html", "body"):
            names = names_in(unescape(f"{found.get('class', '')} {found.get('id', '')}"))
            against = names & AGAINST
            if around.in_text or names & FOR:
                against -= {"header"}
            if against:
                e.doubt += NAMED_AGAINST
            elif names & FOR:
                value += NAMED_FOR
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or UNSEEN_STYLE.search(found.get("style", "")):
            e.doubt += UNSEEN
    if name in ("article", "main"):
        e.form = 0.0  # a form around the whole page is no form of it
    if name == "form":
        e.form += value
    elif value < 0:
        e.doubt += value
    else:
        e.support += value
    return e


class Reader:
    """Builds a page's blocks from its tags in one pass; open elements are a stack, cut into the scopes that end tags stay in."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack = [Element("", self.hold(-1))]
        self.scopes: list[dict[str, int]] = [{}]  # open elements of each scope by name
        self.parts: list[tuple[str, bool]] = []

    def hold(self, parent: int) -> int:
        self.page.parents.append(parent)
        self.page.depths.append(self.page.depths[parent] + 1 if parent >= 0 else 0)
        return len(self.page.parents) - 1

    def flush(self) -> None:
        """Ends the block that the text so far makes."""
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        text = " ".join("".join(p for p, _ in parts).split())
        if not text:
            return
        e = self.stack[-1]
        size = sum(len(p) - p.count(" ") for p, _ in parts)
        linked = sum(len(p) - p.count(" ") for p, link in parts if link)
        w, heading = WEIGHTS, self.inside(HEADINGS)
        odds = w["block"] + w["words"] * math.log1p(text.count(" ") + 1) + w["links"] * linked / max(1, size)
        stops = len(STOPS.findall(text))
        odds += w["ends"] * (text.rstrip("\"')]»”’")[-1:] in ".!?…。！？:" and stops > 0) + w["stops"] * min(3, stops) + w["heading"] * heading + w["item"] * self.inside(("li", "td", "th", "dd", "dt"))
        odds += min(MOST_FOR, e.support) + max(MOST_AGAINST, e.doubt + e.form)
        self.page.blocks.append(Block(text, odds, e.holder, heading))

    def inside(self, names: Sequence[str]) -> bool:
        """Whether the innermost block element is one of these."""
        for e in reversed(self.stack):
            if e.name in BLOCK:
                return e.name in names
        return False

    def push(self, name: str, tag: str) -> None:
        around = self.stack[-1]
        holder = self.hold(around.holder) if name in BLOCK else around.holder
        self.stack.append(opened(name, tag, around, holder))
        if name in SCOPES:
            self.scopes.append({})
        self.scopes[-1][name] = self.scopes[-1].get(name, 0) + 1

    def pop(self) -> str:
        name = self.stack.pop().name
        self.scopes[-1][name] -= 1
        if name in SCOPES:
            self.scopes.pop()
        return name

    def close(self, names: Sequence[str]) -> None:
        """Ends the innermost open element of these names in the scope, with all inside it."""
        if any(self.scopes[-1].get(name) for name in names):
            while self.pop() not in names:
                pass

    def start(self, name: str, tag: str) -> None:
        if self.scopes[-1].get("head") and name not in HEAD:
            self.close(("head",))
        if name in BLOCK:
            self.flush()
            self.close(("p",))
        if name in ENDS:
            self.close(ENDS[name])
        if name == "body" and self.scopes[-1].get("body"):
            return
        if name == "br":
            self.parts.append((" ", False))
        if name not in VOID:
            self.push(name, tag)

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
            if name in ("body", "html"):
                return  # text may still follow
            if name in SCOPES and not self.scopes[-1].get(name):
                while len(self.scopes) > 1 and any(s.get(name) for s in self.scopes) and not self.scopes[-1].get(name):
                    self.pop()  # the end of a table ends its open cells
            self.close((name,))
        elif self.scopes[-1].get(name):
            at = len(self.stack) - 1
            while self.stack[at].name != name and self.stack[at].name not in BLOCK:
                at -= 1
            if self.stack[at].name == name:  # an inline element ends no block around what follows
                while self.pop() != name:
                    pass

    def text(self, part: str) -> None:
        if self.scopes[-1].get("head") and not part.isspace():
            self.close(("head",))
        self.parts.append((unescape(part) if "&" in part else part, self.stack[-1].link))


def read(html: str) -> Page:
    """The blocks of a page, in order."""
    reader, at, unclosed = Reader(), 0, set()
    low = None
    while at < len(html):
        i = html.find("<", at)
        if i < 0:
            break
        if i > at:
            reader.text(html[at:i])
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4 if not html.startswith("<!-->", i) else i + 2)
            at = len(html) if end < 0 else end + 3
            continue
        ending = html.startswith("/", i + 1)
        m = NAME.match(html, i + 1 + ending)
        if not m and not html.startswith(("!", "?", "/"), i + 1):
            reader.text("<")
            at = i + 1
            continue
        j = k = m.end() if m else i + 1
        while True:  # to the > outside of quotes
            stop = STOP.search(html, j)
            if not stop or stop[0] == ">":
                break
            quote = stop[1]
            j = -1 if quote in unclosed else html.find(quote, stop.end())
            if j < 0:
                unclosed.add(quote)
                j = stop.end()
            else:
                j += 1
        at = len(html) if not stop else stop.end()
        if not m or not stop:
            continue
        name = m[0].lower()
        if ending:
            reader.end(name)
            continue
        if name in RAW:
            if name in BLOCK:
                reader.flush()
            low = html.lower() if low is None else low
            end = low.find(f"</{name}", at) if len(low) == len(html) else next((x.start() for x in re.compile(f"</{name}", re.IGNORECASE).finditer(html, at)), -1)
            if html[stop.start() - 1] == "/" and name in ("svg", "math"):
                continue
            at = len(html) if end < 0 else end
            continue
        reader.start(name, html[k : stop.start()].rstrip("/"))
    if at < len(html):
        reader.text(html[at:])
    reader.flush()
    return reader.page


def capacity(x: float) -> int:
    return round(SCALE * x)


def graph_of(page: Page) -> tuple[list[int], list[tuple[int, int, int]]]:
    """What each node has from the source more than to the sink (blocks, then elements that hold any), and the edges (node, node, capacity)."""
    blocks, n = page.blocks, len(page.blocks)
    excess = []
    for b in blocks:
        lost = math.log1p(math.exp(-abs(b.odds)))  # cost of the likelier label; the other costs the odds more
        excess.append(capacity(lost + abs(b.odds)) - capacity(lost) if b.odds > 0 else capacity(lost) - capacity(lost - b.odds))
    used: dict[int, int] = {}
    edges = []

    def node(holder: int) -> int:
        """The node of an element; the way up to the page is made with it."""
        fresh = []
        while holder >= 0 and holder not in used:
            used[holder] = n + len(used)
            fresh.append(holder)
            holder = page.parents[holder]
        edges.extend((used[h], used[page.parents[h]], capacity(NESTS)) for h in fresh if page.parents[h] >= 0)
        return used[fresh[0]] if fresh else used[holder]

    for i, b in enumerate(blocks):
        edges.append((i, node(b.holder), capacity(HOLDS)))
        if i:
            before, borders = blocks[i - 1], distance(page, blocks[i - 1].holder, b.holder)
            edges.append((i - 1, i, capacity((HEADS if before.heading and not b.heading else NEXT) / (1 + borders / 2))))
    return excess + [0] * len(used), edges


def distance(page: Page, a: int, b: int, most: int = 20) -> int:
    """Borders between two block elements, no more than most."""
    steps = 0
    while a != b and steps < most:
        if page.depths[a] < page.depths[b]:
            a, b = b, a
        a, steps = page.parents[a], steps + 1
    return steps


def settled(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the source's side of the least cut with the fewest nodes there."""
    near: list[dict[int, int]] = [{} for _ in excess]
    for a, b, c in edges:
        if a != b and c:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    excess, tied = list(excess), [sum(x.values()) for x in near]
    side: list[bool | None] = [None] * len(excess)
    waiting = deque(range(len(excess)))
    while waiting:
        i = waiting.popleft()
        if side[i] is None and (excess[i] > tied[i] or -excess[i] >= tied[i]):
            side[i] = excess[i] > tied[i]
            for j, c in near[i].items():
                if side[j] is None:
                    excess[j] += c if side[i] else -c
                    tied[j] -= c
                    waiting.append(j)
    for i in range(len(excess)):
        if side[i] is None:
            own, k = [i], 0
            seen = {i: 0}
            while k < len(own):
                for j in near[own[k]]:
                    if side[j] is None and j not in seen:
                        seen[j] = len(own)
                        own.append(j)
                k += 1
            links = [(seen[a], seen[b], c) for a in own for b, c in near[a].items() if b in seen and seen[a] < seen[b]]
            for a, content in zip(own, minimum_cut([excess[a] for a in own], links), strict=True):
                side[a] = content
    return [bool(x) for x in side]


def minimum_cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Dinic's maximum flow, blocking flow by blocking flow along shortest ways; then what the source still reaches."""
    n = len(excess)
    source, sink = n, n + 1
    ends: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: int, back: int) -> None:
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends.extend((b, a))
        room.extend((c, back))

    for i, x in enumerate(excess):
        if x > 0:
            add(source, i, x, 0)
        elif x < 0:
            add(i, sink, -x, 0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        here = source
        while True:
            if here == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                here = ends[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[here] < len(out[here]):
                e = out[here][at[here]]
                if room[e] and level[ends[e]] == level[here] + 1:
                    break
                at[here] += 1
            else:
                if here == source:
                    break
                level[here] = -1
                here = ends[path.pop() ^ 1]
                continue
            path.append(e)
            here = ends[e]


def main_text(html: str | None) -> str:
    """The page's content, a line a block."""
    page = read(html or "")
    if not page.blocks:
        return ""
    return "\n".join(b.text for b, content in zip(page.blocks, settled(*graph_of(page)), strict=False) if content)


def html_of(pages: DataFrame) -> Column:
    return F.coalesce(pages["html"].cast("string"), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """pages without html, with text (the main text of html) and n_chars (its code points)."""

    @F.pandas_udf("string")
    def main_texts(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in html], dtype=object)

    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    return pages.select(*(pages[c] for c in kept), main_texts(html_of(pages)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
