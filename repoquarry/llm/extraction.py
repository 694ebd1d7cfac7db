"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text. What a block's elements say and what a classifier thinks of its form become its capacity to the
source (content) or to the sink (boilerplate). Blocks next to each other, and blocks of the same container, are tied by edges that are the
stronger the nearer the blocks lie in the document tree. The minimum cut parts content from boilerplate.

No block has a label, so the classifier learns from the pages themselves: blocks whose elements leave no doubt are its examples, and its
features (length, share of links, kind of element, marks of sentences) are counted over all pages. Weights of the elements and of the
edges, and the counts the classifier starts with, are stated below.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.tables import map_arrow

UNREAD = frozenset("script style template noscript title textarea select option button svg math iframe object embed canvas audio video noembed noframes".split())
"""Elements whose text no reader sees as part of an article."""
RAW = frozenset("script style title textarea noscript iframe noembed noframes template svg".split())
"""Elements that end only with their own end tag."""
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
AGAINST = frozenset("nav footer aside form menu dialog".split())
WITHIN = frozenset("article main".split())
ROLES = {
    **dict.fromkeys("main article".split(), 1),
    **dict.fromkeys("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split(), -1),
}
GOOD_NAMES = frozenset("article content entry main post story".split())
BAD_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promoted promotion "
    "related recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget widgets".split()
)
"""Words of class and id."""

SURE = 60
"""Capacity for elements that say what a block is."""
LIKELY = 12
"""Capacity for elements that make content likely, and the most the classifier adds."""
SIDE_BY_SIDE = 6
"""Edge of neighbours in one container; it falls with their distance in the tree."""
SAME_CONTAINER = 3
"""Edge of blocks of a container that others part."""

STARTING_COUNTS = {
    ("kind", "p"): (8, 2), ("kind", "h"): (4, 3), ("kind", "li"): (2, 5), ("kind", "td"): (2, 4), ("kind", "other"): (3, 4),
    ("links", 0): (8, 4), ("links", 1): (3, 4), ("links", 2): (1, 9),
    ("marks", 0): (2, 6), ("marks", 1): (5, 4), ("marks", 2): (8, 2),
    **{("length", i): (1 + i, max(1, 9 - i)) for i in range(11)},
}
"""Content and boilerplate blocks by feature that count as seen before any page."""

_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
"""Open elements that a start tag ends without an end tag."""


class Element:
    """An open or closed element: its parent, what it says of its blocks (1, 0, -1), and whether only its names say so."""

    __slots__ = ("name", "parent", "depth", "says", "by_name", "holds_main")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.says, self.by_name, self.holds_main = 0, False, False
        if name in WITHIN:
            self.says = 1
        elif name in AGAINST:
            self.says = -1
        elif name == "header" and not any(e.name in WITHIN for e in self.ancestors()):
            self.says = -1
        if attributes.strip(" /\n\t") and name not in ("html", "body"):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
                self.says = -1
            elif (role := ROLES.get(found.get("role", "").lower())) is not None:
                self.says = role
            else:
                words = set(_WORD.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()))
                bad, good = not words.isdisjoint(BAD_NAMES), not words.isdisjoint(GOOD_NAMES)
                if bad and not good and self.says >= 0:
                    self.says, self.by_name = -1, True
                elif bad and self.says > 0 and "comment" in words | {w.rstrip("s") for w in words}:
                    self.says, self.by_name = -1, True
                elif good and not bad and self.says == 0:
                    self.says, self.by_name = 1, True
        if name in WITHIN or self.says > 0 and not self.by_name:
            for e in self.ancestors():
                e.holds_main = True

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e:
            yield e
            e = e.parent

    def verdict(self) -> int:
        """-1 if this element or one around it is boilerplate, 1 if one is content. Names of an element that holds the article do not count."""
        said = 0
        for e in (self, *self.ancestors()):
            if e.says < 0 and not (e.holds_main and (e.by_name or e.name == "form")):
                return -1
            said = said or max(0, e.says)
        return said


class Block:
    __slots__ = ("text", "linked", "at")

    def __init__(self, text: str, linked: int, at: Element):
        self.text, self.linked, self.at = text, linked, at


def blocks_of(page: str) -> list[Block]:
    """Blocks of text of a page in order, with the element each lies in. Broken markup is read as browsers do, roughly."""
    at = Element("", None, "")
    found: list[Block] = []
    pieces: list[str] = []
    linked = links = unread = 0
    position = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not unread:
            text = references.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text.strip())

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                found.append(Block(text, linked, at))
        linked = 0

    def close(names: set[str] | frozenset[str], until: frozenset[str] = frozenset()) -> None:
        """Ends the nearest open element with one of the names, and all inside it."""
        nonlocal at, unread
        e = at
        while e.parent and e.name not in names:
            if e.name in until:
                return
            e = e.parent
        if e.parent:
            flush()
            while at is not e.parent:
                unread -= at.name in UNREAD
                at = at.parent

    while position < len(page):
        tag = page.find("<", position)
        if tag < 0:
            add(page[position:])
            break
        add(page[position:tag])
        match = _OPEN.match(page, tag)
        if not match:  # a lone "<"
            add("<")
            position = tag + 1
            continue
        position = match.end()
        if match["cdata"] is not None:
            add(match["cdata"])
            continue
        name = (match["name"] or match["name2"] or "").lower()
        if not name:
            continue
        rest = match["rest"] if match["name"] else match["rest2"]
        if match["end"] or match["end2"]:
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                add(" ")
            elif name in INLINE:
                pass
            else:
                flush()
                close({name})
        elif name == "br" or name == "wbr":
            add(" " if name == "br" else "")
        elif name == "a":
            links += 1
        elif name in VOID:
            if name == "hr":
                flush()
        elif name in INLINE:
            # Only inline elements that hide or mark their text as something else matter.
            pass
        else:
            flush()
            links = 0  # a link that nobody closed
            close({"p"}, frozenset({"td", "th", "table", "button", "object", "template"}))
            if name in _CLOSES:
                close(_CLOSES[name], frozenset({"ul", "ol", "dl", "table", "menu", "select"}))
            if not rest.endswith("/") or name not in ("svg", "math"):
                at = Element(name, at, rest)
                unread += name in UNREAD
                if name in RAW:
                    end = re.compile(rf"</{name}\b", re.I).search(page, position)
                    position = end.start() if end else len(page)
    flush()
    return found


def features(block: Block) -> list[tuple[str, object]]:
    size = len(block.text)
    name = block.at.name
    kind = "p" if name == "p" else "h" if re.fullmatch(r"h[1-6]", name) else "li" if name in ("li", "dt", "dd") else "td" if name in ("td", "th") else "other"
    share = block.linked / size
    marks = sum(block.text.count(c) for c in ".!?。！？")
    return [("kind", kind), ("links", 0 if share == 0 else 1 if share < 0.5 else 2), ("marks", min(2, marks)), ("length", min(10, size.bit_length()))]


Counts = dict[tuple[str, object], tuple[int, int]]


def learn(pages: DataFrame, html: str = "html") -> Counts:
    """How often each feature is seen in content and in boilerplate, over all pages; as many rows as there are features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for page in batch.column(html):
                for block in blocks_of(page.as_py() or ""):
                    if said := block.at.verdict():
                        for name, value in features(block):
                            seen.setdefault((name, str(value)), [0, 0])[said < 0] += 1
        columns = list(zip(*[(*key, *counts) for key, counts in seen.items()], strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["feature", "value", "good", "bad"])

    rows = map_arrow(pages.select(F.col(html)), run, "feature string, value string, good bigint, bad bigint")
    counts = {(r.feature, r.value): (r.good, r.bad) for r in rows.groupBy("feature", "value").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()}
    return {key: tuple(a + b for a, b in zip(start, counts.get((key[0], str(key[1])), (0, 0)), strict=True)) for key, start in STARTING_COUNTS.items()}


def odds(counts: Counts) -> dict[tuple[str, object], float]:
    """Logarithm of how much likelier a feature is in content than in boilerplate."""
    sums: dict[str, list[int]] = {}
    for (name, _), (good, bad) in counts.items():
        total = sums.setdefault(name, [0, 0])
        total[0] += good
        total[1] += bad
    return {key: math.log(good / sums[key[0]][0]) - math.log(bad / sums[key[0]][1]) for key, (good, bad) in counts.items()}


def source_side(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source's side of the minimum cut. A node with cost c > 0 has an edge of c from the source, c < 0 one to the sink."""
    n = len(costs)
    source, sink = n, n + 1
    head: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(head))
        out[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((there, back))

    for node, cost in enumerate(costs):
        if cost > 0:
            link(source, node, cost, 0)
        elif cost < 0:
            link(node, sink, -cost, 0)
    for a, b, weight in edges:
        link(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[a] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(i for i, e in enumerate(path) if not room[e])
                a = head[path[full] ^ 1]
                del path[full:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] and level[head[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                e = path.pop()
                a = head[e ^ 1]
                continue
            path.append(e)
            a = head[e]


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def main_blocks(page: str, weights: dict[tuple[str, object], float]) -> list[str]:
    """Texts of the blocks on the content side of the cut, in order."""
    blocks = blocks_of(page)
    costs, edges = [], []
    last_in: dict[int, int] = {}
    for i, block in enumerate(blocks):
        said = block.at.verdict()
        form = max(-LIKELY, min(LIKELY, round(2 * sum(weights[f] for f in features(block)))))
        costs.append(form - SURE if said < 0 else form + LIKELY if said > 0 else form)
        if i:
            edges.append((i - 1, i, max(1, SIDE_BY_SIDE // max(1, _distance(blocks[i - 1].at, block.at) - 1))))
        container = id(block.at.parent or block.at)
        if container in last_in and last_in[container] < i - 1:
            edges.append((last_in[container], i, SAME_CONTAINER))
        last_in[container] = i
    kept = source_side(costs, edges)
    return [block.text for block, keep in zip(blocks, kept, strict=True) if keep]


def extract_text(pages: DataFrame, counts: Counts | None = None, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All columns of `pages`, the main text and its number of code points.

    Whole pages are read, one at a time; a null, empty or contentless page has an empty text. Blocks are trimmed, with one space for
    white space inside, and joined by an empty line. Columns with the names of the new ones, in any case, are replaced. `counts` are
    those of `learn`; without them the stated ones are used. Rows stay as many as they are.
    """
    weights = odds(counts or STARTING_COUNTS)
    columns = [c for c in pages.columns if c.lower() not in (text.lower(), n_chars.lower())]
    given = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{html}`").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(page.as_py() or "", weights)) for page in batch.column("_html")]
            columns = [batch.column("_row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_text", "_size"])

    schema = f"_row {given.schema['_row'].dataType.simpleString()}, _text string, _size bigint"
    done = map_arrow(given, run, schema)
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], F.col("_text").alias(text), F.col("_size").alias(n_chars))
