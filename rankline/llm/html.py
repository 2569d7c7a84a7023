"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags). Neighbouring blocks with
one parent and the same sign of classifier score are one node. The classifier's log odds of being
content are the node's terminal capacity; nodes next to each other, and nodes that share
ancestors, are joined by smoothness edges; a minimum cut gives the labels. The classifier is
naive Bayes: its text measures are learned over all pages from blocks whose place in the page
already tells what they are (inside article or main, inside nav, footer, aside, ...). A class or
id that holds a furniture word (or aria-hidden) marks an element as furniture, but main, and the articles that
stand in the fewest such marks, are content nevertheless: a wrapper "has-sidebar" around them
is layout. Inside main or an article a whole class or id marks an element; a furniture word that is only a part of
one ("restaurant-menu") is a hint that lowers the score, and the cut decides. A form that holds
every article and main of the page, or most text of a page without them, is layout; its labels
and controls go. Nothing undoes nav, footer, aside, the attribute hidden and the like. Where all text of a page is
marked, the classifier decides on what the outermost marks alone hold.

Defined cases: a null or empty page has an empty text; markup that never ends is closed at the
end of the page; blocks without text are no blocks; rows that repeat an id are extracted each;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, and words that name page furniture.
SKIPPED = frozenset("script style noscript template head title svg iframe object select textarea button canvas audio video map math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset("article main".split())
FURNITURE = frozenset("nav footer aside header menu dialog label legend".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr "
                  "sidebar menu nav navigation navbar breadcrumb breadcrumbs footer header masthead comment comments reply replies respond discussion disqus "
                  "share sharing social related recommended newsletter subscribe signup login popup modal widget toolbar pagination pager".split())
ROLES = {"navigation": False, "banner": False, "contentinfo": False, "complementary": False, "search": False, "form": False, "alert": False,
         "dialog": False, "main": True, "article": True}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMED = re.compile(r"(?i)\b(?:class|id|role|hidden|style)\b")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
PLACE_ODDS = 6.0  # log odds of a block whose place is known
HINT_ODDS = 2.0  # what a hint takes from the log odds
NEXT_TO, SHARED = 0.6, 0.8  # capacities of smoothness edges


class Element:
    __slots__ = ("name", "parent", "depth", "place", "real", "main", "hints", "article", "form", "soft")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.place = parent.place if parent else None  # True: content, False: furniture
        self.real = parent.real if parent else False  # furniture by an element or role, which nothing inside undoes
        self.main = parent.main if parent else False
        self.hints = parent.hints if parent else 0  # marks by class or id around this, up to the next main
        self.article = parent.article if parent else None  # marks around the article that this is in; None: in no article, or marked inside it
        self.form = self if name == "form" else parent.form if parent else None  # the innermost form
        self.soft = parent.soft if parent else False  # hinted at inside main or an article
        role, hinted, whole, unseen = None, False, False, False
        if attributes and name not in ("html", "body") and NAMED.search(attributes):
            for key, *value in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(value).lower()
                if key == "role" and value in ROLES:
                    role = value
                elif key in ("class", "id") and not HINTS.isdisjoint(WORD.findall(value)):
                    hinted, whole = True, whole or not HINTS.isdisjoint(value.split())
                elif key == "aria-hidden" and value == "true":
                    hinted = whole = True
                elif key == "hidden" or (key == "style" and UNSEEN.search(value)):
                    unseen = True
        content = ROLES[role] if role else True if name in CONTENT else False if name in FURNITURE else None
        self.soft = self.soft and not content
        if self.real or unseen or content is False:
            self.place, self.real, self.article = False, True, None
        elif content and "main" in (name, role):
            self.place, self.main, self.hints, self.article = True, True, 0, None
        elif content and not self.hints:
            self.place, self.article = True, 0
        elif content:
            self.article = self.hints + hinted if self.article is None else self.article
        elif hinted and not whole and (self.main or self.article is not None):
            self.soft, self.hints = True, self.hints + 1
        elif hinted:
            self.place, self.hints, self.article = False, self.hints + 1, None


class Block:
    __slots__ = ("text", "parent", "linked")

    def __init__(self, text: str, parent: Element, linked: int):
        self.text, self.parent, self.linked = text, parent, linked


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    if not page:
        return out
    here = Element("", None, "")
    parts: list[str] = []
    links = linked = 0
    skip = ""

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(raw)

    def end() -> None:
        nonlocal linked
        if parts:
            t = SPACE.sub(" ", unescape("".join(parts))).strip()
            if t:
                out.append(Block(t, here, linked))
            parts.clear()
            linked = 0

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1]:
            if name in SKIPPED:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if name == "head" and not close:
                    continue
                at = close.end() if close else len(page)
                if name not in ("script", "style", "title"):
                    parts.append(" ")
                continue
            if name in BLOCKS:
                end()
                up = here
                while up.parent and up.name not in BLOCKS:
                    up = up.parent
                if up.name in CLOSED_BY_BLOCK or (up.name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    here = up.parent
                    links = 0
                here = Element(name, here, m[3])
                if name in VOID:
                    here = here.parent
            elif name in VOID:
                parts.append(" ")
            elif name == "a":
                links += 1
        elif name in BLOCKS:
            up = here
            while up.parent and up.name != name:
                up = up.parent
            if up.name == name:
                end()
                here, links = up.parent, 0
        elif name == "a" and links:
            links -= 1
    end()
    settle(out)
    return out


def settle(found: list[Block]) -> None:
    """Takes back the marks by class or id around the articles (of main, if it has text) with the
    fewest of them, which are the page's layout (beside text in main itself, of articles with one
    mark only), and the outermost ones if all text is marked. Forms that are not layout go."""
    settle_forms(found)
    inside = [b.parent for b in found if b.parent.main] or [b.parent for b in found]
    least = min((e.article for e in inside if e.article is not None), default=None)
    if least is not None and (least < 2 or not any(e.place for e in inside)):
        for e in inside:
            if e.article == least:
                e.place = True
    if all(b.parent.place is False for b in found):
        marked = [b.parent for b in found if not b.parent.real]
        least = min((e.hints for e in marked), default=0)
        for e in marked:
            if e.hints == least:
                e.place = None


def settle_forms(found: list[Block]) -> None:
    """Marks what is in a form as furniture, unless the form is the page's layout."""
    size: dict[Element | None, int] = {}
    named: dict[Element | None, bool] = {}
    for b in found:
        form, inside = b.parent.form, b.parent.main or b.parent.article is not None
        while True:  # with the forms around it; None stands for the page
            size[form] = size.get(form, 0) + len(b.text)
            named[form] = named.get(form, 0) + inside
            if form is None:
                break
            form = form.parent.form
    layout = {f for f in size if f is None or (named[f] == named[None] if named[None] else 2 * size[f] > size[None])}
    for e in {b.parent for b in found}:
        form = e.form
        while form in layout and form is not None:
            form = form.parent.form
        if form is not None:
            e.place, e.real, e.article = False, True, None


def measures(b: Block) -> list[str]:
    """Names of the bins of a block's text measures."""
    n = len(b.text)
    share = min(1.0, b.linked / n)
    return [f"n{min(5, int(math.log2(n + 1)) // 2)}", f"l{0 if share < 0.1 else 1 if share < 0.6 else 2}",
            f"e{b.text[-1] in '.!?…'}", f"t{b.parent.name if b.parent.name in ('p', 'li', 'td', 'h1', 'h2', 'div', 'pre', 'blockquote') else ''}"]


def learned(pages: DataFrame) -> dict[str, float]:
    """Log odds of each bin, from counts over the blocks of all pages whose place is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for page in b.column(0):
                for block in blocks(page.as_py()):
                    if block.parent.place is not None and not block.parent.soft:
                        for name in ("", *measures(block)):
                            seen.setdefault(name, [0, 0])[block.parent.place] += 1
        if seen:
            yield pa.RecordBatch.from_pylist([{"bin": k, "no": v[0], "yes": v[1]} for k, v in seen.items()],
                                             schema=pa.schema([("bin", pa.string()), ("no", pa.int64()), ("yes", pa.int64())]))

    rows = pages.select("html").mapInArrow(run, "bin string, no long, yes long").groupBy("bin").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    got = {r["bin"]: (r["no"], r["yes"]) for r in rows.collect()}  # about twenty bins
    no, yes = got.pop("", (0, 0))
    return {k: math.log((b[1] + 1) / (yes + 6)) - math.log((b[0] + 1) / (no + 6)) for k, b in got.items()}


def score(b: Block, odds: dict[str, float]) -> float:
    if b.parent.place is not None and not (b.parent.soft and b.parent.place):
        return PLACE_ODDS if b.parent.place else -PLACE_ODDS
    return (-HINT_ODDS if b.parent.soft else 0.0) + sum(odds.get(m, 0.0) for m in measures(b)) / 2


def _common(a: Element, b: Element) -> int:
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of the minimum cut. A node with a positive cost is tied to the
    source by it, one with a negative cost to the sink. Maximum flow by blocking flows: all
    shortest paths of one length are filled in one walk, in which no edge is tried again once
    it is full, so the work grows with the nodes and the few lengths that occur."""
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, ab: float, ba: float) -> None:  # an edge and its way back are neighbours
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((ab, ba))

    for i, c in enumerate(costs):
        tie(source, i, c, 0.0) if c > 0 else tie(i, sink, -c, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                full = 0
                for k in range(len(path) - 1, -1, -1):
                    room[path[k]] -= flow
                    room[path[k] ^ 1] += flow
                    if room[path[k]] <= 1e-9:
                        full = k
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            else:  # a dead end
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
                continue
            path.append(e)
            a = to[e]


def extract(page: str | None, odds: dict[str, float]) -> str:
    """The main text of a page: content blocks joined by empty lines."""
    found = blocks(page)
    nodes: list[list[int]] = []
    costs: list[float] = []
    for i, b in enumerate(found):
        s = score(b, odds)
        last = found[nodes[-1][0]] if nodes else None
        if last and (last.parent is b.parent or (last.parent.parent is b.parent.parent and last.parent.place == b.parent.place)) and (costs[-1] > 0) == (s > 0):
            nodes[-1].append(i)
            costs[-1] += s
        else:
            nodes.append([i])
            costs.append(s)
    edges = []
    for k in range(len(nodes) - 1):
        for far in (1, 2):
            if k + far < len(nodes):
                a, b = found[nodes[k][-1]].parent, found[nodes[k + far][0]].parent
                near = _common(a, b) / max(a.depth, b.depth, 1)
                edges.append((k, k + far, (NEXT_TO if far == 1 else 0.0) + SHARED * near * near / far))
    content = min_cut(costs, edges)
    return "\n\n".join(found[i].text for keep, node in zip(content, nodes) if keep for i in node)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    odds = learned(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), odds) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
