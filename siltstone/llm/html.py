"""Main text of web pages by minimum-cut labelling.

A page becomes a graph of its text blocks and the elements around them. A linear classifier over a
block's text alone gives the costs of calling it content or boilerplate, as bounded capacities to the
two terminals. An element has such costs where its tag or name says something, for each block that it
governs. Smoothness edges join blocks to their element, elements to their parents, blocks that follow
one another, and blocks with one parent. The minimum cut, found by a maximum flow, is the labelling of
least total cost: long text in a sidebar goes with its sidebar, a short line in an article stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Element names by their part in HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
SILENT = {"head", "svg", "math", "select", "button", "object", "canvas", "video", "audio", "map", "datalist", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
AWAY = {"nav", "footer", "aside", "form", "menu", "header", "fieldset"}
TOWARDS = {"article", "main"}
# Parts of class and id names.
BAD_NAMES = re.compile(
    r"^(ads?|adverts?|advertisements?|advertising|adsense|sponsor(ed|s)?|promos?|promotions?|banners?|nav|navs|navbar|navigation|menus?|submenu|breadcrumbs?|sidebars?|rail|aside|footers?|foot|mastheads?|topbar|toolbar|"
    r"comments?|commentlist|disqus|replies|reply|respond|reviews?|discussion|cookies?|consent|gdpr|notices?|alerts?|notifications?|disclaimer|popups?|modals?|overlay|newsletters?|subscribe|subscription|signup|login|search|"
    r"share|sharing|social|related|recommended|recommendations|widgets?|pagination|pager|copyright|legal|skip|forms?|tags|tagcloud|bio|outbrain|taboola|paywall|complementary|contentinfo|dialog|hidden|popular|trending)$"
)
OWN_HEADER = {"article", "post", "entry", "story", "content"}
GOOD_NAMES = re.compile(r"^(article|articlebody|content|post|entry|story|main|maincontent|body|text|page)$")


@dataclass
class Block:
    text: str
    tag: str
    at: int  # the innermost element around it
    linked: int  # characters inside links


class Tree:
    """The elements of a page, numbered as they open; 0 is the page itself.

    ``says`` holds what an element's own tag and names say: -1 boilerplate, 1 a good name, 2 the
    page's main part (left out: nothing); ``side`` the innermost element that says something.
    """

    def __init__(self) -> None:
        self.parent, self.depth, self.side = [-1], [0], [0]
        self.says: dict[int, int] = {}

    def add(self, parent: int, own: int) -> int:
        new = len(self.parent)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.side.append(new if own else self.side[parent])
        if own:
            self.says[new] = own
        return new

    def shared(self, a: int, b: int) -> int:
        """How many elements stand around both."""
        parent, depth = self.parent, self.depth
        while a != b:
            if depth[a] >= depth[b]:
                a = parent[a]
            else:
                b = parent[b]
        return depth[a] + 1


@dataclass
class _Element:
    tag: str
    serial: int
    away: bool  # inside boilerplate
    main: bool  # inside a main part
    silent: bool


def _names(attrs: str) -> tuple[int, bool]:
    """What class, id and role say (-1, 0, 1), and whether the element is hidden."""
    named, hidden = 0, False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif key in ("class", "id", "role"):
            parts = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            if any(BAD_NAMES.match(p) for p in parts) or "header" in parts and not OWN_HEADER & set(parts):
                named = -1
            elif not named and any(GOOD_NAMES.match(p) for p in parts):
                named = 1
    return named, hidden


def blocks(page: str | None) -> tuple[list[Block], Tree]:
    """The text blocks of a page in order, and its elements; character references decoded, white space collapsed.

    Unclosed, misnested and truncated markup is read as far as it goes; scripts, styles, comments
    and form controls give no text.
    """
    page = page or ""
    found: list[Block] = []
    stack, tree = [_Element("", 0, False, False, False)], Tree()
    parts: list[str] = []
    state = {"linked": 0, "at": stack[0], "links": 0, "placed": False}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            at: _Element = state["at"]
            found.append(Block(text, at.tag, at.serial, state["linked"]))
        parts.clear()
        state["linked"], state["placed"] = 0, False

    def say(raw: str) -> None:
        if raw and not stack[-1].silent:
            text = html.unescape(raw)
            if not state["placed"]:
                holder = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag not in INLINE), 0)
                state["at"] = stack[-1] if stack[-1].away else stack[holder]
                state["placed"] = bool(text.strip())
            parts.append(text)
            if state["links"]:
                state["linked"] += len(text)

    def close(tag: str, barrier: set[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                state["links"] -= sum(e.tag == "a" for e in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    at = 0
    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:-3]))
            continue
        tag, end, attrs = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        inline = tag in INLINE
        if not inline:
            flush()
        elif tag == "br":
            parts.append(" ")
        if end:
            close(tag)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        for other in CLOSES.get(tag, ()):
            close(other, BARRIERS.get(tag, {"div", "article", "section", "body", "td", "li", "blockquote", "main"}))
        if tag in VOID or attrs.endswith("/") and inline:
            continue
        up = stack[-1]
        named, hidden = _names(attrs)
        inner_header = tag == "header" and up.main
        own = 0
        if not up.away:
            own = -1 if named < 0 and tag not in ("body", "html") or tag in AWAY and not inner_header else 2 if tag in TOWARDS else max(0, named) if tag not in ("body", "html") else 0
        stack.append(_Element(tag, tree.add(up.serial, own), up.away or own < 0, up.main or own == 2, up.silent or hidden or tag in SILENT))
        state["links"] += tag == "a"
    say(page[at:])
    flush()
    return found, tree


#: Most that a block's own text weighs, the edge to its element, and an element's say for each block that it governs.
MOST, HOLD, SAYS = 3.0, 4.0, {-1: -4.0, 1: 1.5, 2: 4.0}


def score(b: Block) -> float:
    """Evidence for content in the text alone: above 0 the cost of calling the block boilerplate, below 0 of calling it content."""
    n = len(b.text)
    s = -0.6 + min(n, 240) / 120 - 3 * min(1.0, b.linked / n)
    s += 0.6 * min(3, len(re.findall(r"[.!?,;:。、]", b.text)))
    s += {"p": 1.0, "blockquote": 1.0, "pre": 1.0, "h1": 1.6, "h2": 0.8, "h3": 0.6, "li": -0.5, "td": -0.4, "th": -0.6, "label": -1.0}.get(b.tag, 0.0)
    return max(-MOST, min(MOST, s))


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least total cost: node i pays |score| if its label is against its sign, an edge its weight if its ends differ.

    Maximum flow from nodes with a positive score to nodes with a negative one, in phases: the
    distance to a negative node is worked out for all nodes at once, then flow is pushed along
    shortest paths until none is left. The content side is what the residual graph still reaches.
    """
    tiny, n = 1e-9, len(scores)
    left = list(scores)
    arcs: list[list[int]] = [[] for _ in scores]  # arc k ends at end[k]; k ^ 1 is the other way
    end: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        arcs[a].append(len(end))
        arcs[b].append(len(end) + 1)
        end += [b, a]
        room += [w, w]
    while True:
        far = [-1] * n
        queue = [i for i in range(n) if left[i] < -tiny]
        for i in queue:
            far[i] = 0
        for at in queue:
            for k in arcs[at]:
                if far[end[k]] < 0 and room[k ^ 1] > tiny:
                    far[end[k]] = far[at] + 1
                    queue.append(end[k])
        sources = [i for i in range(n) if left[i] > tiny and far[i] >= 0]
        if not sources:
            break
        tried = [0] * n
        for s in sources:
            path: list[int] = []
            at = s
            while left[s] > tiny:
                if left[at] < -tiny and far[at] == 0:
                    flow = min(left[s], -left[at], *[room[k] for k in path])
                    left[s] -= flow
                    left[at] += flow
                    for k in path:
                        room[k] -= flow
                        room[k ^ 1] += flow
                    cut = next((j for j, k in enumerate(path) if room[k] <= tiny), len(path))
                    if cut == len(path) and left[at] < -tiny:
                        break
                    if cut == len(path):  # the end is full
                        far[at] = -1
                        cut = max(0, cut - 1)
                    at = end[path[cut] ^ 1] if path else s
                    del path[cut:]
                    continue
                mine = arcs[at]
                while tried[at] < len(mine) and not (room[mine[tried[at]]] > tiny and far[end[mine[tried[at]]]] == far[at] - 1 and far[at] > 0):
                    tried[at] += 1
                if tried[at] < len(mine):
                    path.append(mine[tried[at]])
                    at = end[path[-1]]
                elif path:
                    far[at] = -1
                    at = end[path.pop() ^ 1]
                else:
                    far[s] = -1
                    break
    reach = [i for i in range(n) if left[i] > tiny]
    content = [x > tiny for x in left]
    for at in reach:
        for k in arcs[at]:
            if room[k] > tiny and not content[end[k]]:
                content[end[k]] = True
                reach.append(end[k])
    return content


def graph(found: list[Block], tree: Tree) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Scores and edges of the blocks, then of the elements around them."""
    scores = [score(b) for b in found]
    governs: dict[int, int] = {}
    for b in found:
        by = tree.side[b.at]
        governs[by] = governs.get(by, 0) + 1
    says = dict(tree.says)
    if any(v == 2 and governs.get(e) for e, v in says.items()):
        says[0] = -1  # the page has a main part: the rest is not
    below = [0] * len(tree.parent)  # blocks inside each element
    for b in found:
        below[b.at] += 1
    for e in range(len(below) - 1, 0, -1):
        below[tree.parent[e]] += below[e]
    node: dict[int, int] = {}
    edges: list[tuple[int, int, float]] = []

    def place(e: int) -> int:
        """The node of an element; new ones are joined to their parents, loosely where they say something themselves."""
        new = []
        while e >= 0 and e not in node:
            new.append(e)
            e = tree.parent[e]
        for e in reversed(new):
            node[e] = len(scores)
            own = SAYS.get(says.get(e, 0), 0.0)
            scores.append(own * (governs.get(e, 0) + (abs(own) > 2)))
            if e:
                edges.append((node[tree.parent[e]], node[e], 0.3 if e in says else HOLD * below[e]))
        return node[new[0] if new else e]

    last: dict[int, int] = {}
    for i, b in enumerate(found):
        side = tree.side[b.at]
        edges.append((i, place(b.at), HOLD if side in says else 0.5))
        if i:
            c = found[i - 1]
            near = 0.3 + 1.2 * tree.shared(b.at, c.at) / (1 + max(tree.depth[b.at], tree.depth[c.at]))
            edges.append((i - 1, i, near if side == tree.side[c.at] else 0.1))
        parent = tree.parent[b.at]
        if parent in last and side == tree.side[found[last[parent]].at]:
            edges.append((last[parent], i, 0.8))
        last[parent] = i
    return scores, edges


def label(found: list[Block], tree: Tree) -> list[bool]:
    """Which blocks are content."""
    scores, edges = graph(found, tree)
    return min_cut(scores, edges)[: len(found)]


def main_text(page: str | None) -> str:
    """The content blocks, joined by two newlines."""
    found, tree = blocks(page)
    return "\n\n".join(b.text for b, ok in zip(found, label(found, tree), strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars, n_blocks)``: one row per input row, from the whole page.

    A null, empty or unreadable page gives an empty text. Repeated rows give repeated results; an
    empty table gives an empty one; other columns are not read.
    """
    picked = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for page in b.column(2).to_pylist():
                found, tree = blocks(page)
                texts.append("\n\n".join(x.text for x, ok in zip(found, label(found, tree), strict=True) if ok))
                counts.append(len(found))
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, url_col, "text", "n_chars", "n_blocks"])

    return picked.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long, n_blocks long")
