"""Main text of web pages by a minimum cut.

A page is cut into blocks, the runs of text between block-level tags. A logistic classifier of a block's
text and ancestors gives the cost of either label, which become the capacities of its edges to the two
terminals. Blocks that follow each other are tied by an edge that is the stronger the more of their
ancestors they share; blocks with the same parent are tied to the next one of it. The minimum cut is the
labelling of least total cost: what stays with the source is content.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from packlake.llm.common import column

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAG = {}  # by element name: its tags, in any case

# Element names by what they do, and name parts by what they tell.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe object svg math select button canvas audio video head".split())
#: Of these, text up to the end of the page is raw where no end tag comes; the others are then ordinary elements.
TO_THE_END = frozenset("script style title textarea".split())
#: Words that make a name tell a state of the element, not what it is.
STATES = frozenset("has have no not with without is enabled disabled enable disable free on off open closed".split())
CLOSES_P = BLOCKS - frozenset("html body caption legend option optgroup tbody td tfoot th thead tr".split())
OUTSIDE = {"nav": -7, "footer": -7, "aside": -6, "form": -6, "menu": -6, "dialog": -6, "header": -6, "fieldset": -3}
INSIDE = {"article": 2, "main": 1.5}
BAD_PARTS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies disclaimer discussion disqus footer header login menu modal nav navbar navigation newsletter notice notification "
    "pager pagination popup promo promotion reader related reply replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar topbar widget alert complementary contentinfo".split()
)
GOOD_PARTS = frozenset("article articlebody content main post entry story text body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Costs:
    """Weights of the classifier (in log-odds of content) and of the ties."""

    start: float = -1.0
    paragraph: float = 1.5
    heading: float = 1.0
    item: float = 0.0
    words: float = 0.6  # for each doubling of the number of words
    most_words: float = 3.0
    sentence: float = 0.5
    links: float = -5.0  # for a text that is all links
    bad_part: float = -6.0
    good_part: float = 1.0
    hidden: float = -8.0
    next: float = 2.0
    sibling: float = 1.5


COSTS = Costs()


@dataclass
class Element:
    name: str
    number: int
    weight: float
    depth: int
    parent: Element | None


@dataclass
class Block:
    parent: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def weight_of(name: str, attributes: str, above: float, costs: Costs) -> float:
    """Weight of what an element has in it, `above` being its parent's; what marks boilerplate outdoes
    content further up."""
    own = OUTSIDE.get(name, 0)
    if name == "header" and above > 0:  # of an article: its title
        own = -1
    weight = above + INSIDE.get(name, 0) if own >= -1 else min(above, 0.0)
    weight += own
    if not attributes:
        return weight
    bad = good = False
    for found in ATTRIBUTE.finditer(attributes):
        value = found[2] or found[3] or found[4] or ""
        if found[1].lower() == "hidden":
            weight += costs.hidden
        elif name not in ("html", "body"):
            for word in value.split():
                parts = {p.lower() for p in NAME_PART.findall(word)}
                if parts.isdisjoint(STATES):
                    bad |= not parts.isdisjoint(BAD_PARTS)
                    good |= not parts.isdisjoint(GOOD_PARTS)
    return min(weight, 0.0) + costs.bad_part if bad else weight + (costs.good_part if good else 0)


def raw_end(page: str, name: str, tag: str, at: int) -> int:
    """Where an element ends whose text does not count, `tag` being its start tag, which ends at `at`.

    Elements of its name within it are skipped with it. One that closes itself, or that has no end tag, is
    just its tag, but a script and the like without an end goes on to the end of the page, as browsers have it.
    """
    if tag.endswith("/>") and name in ("svg", "math"):
        return at
    if name not in TAG:
        TAG[name] = re.compile(rf"<(/?){re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE)
    depth = 1
    for found in TAG[name].finditer(page, at):
        if found[1]:
            depth -= 1
        elif name not in TO_THE_END and not (found[0].endswith("/>") and name in ("svg", "math")):
            depth += 1
        if not depth:
            return found.end()
    if name == "head":
        # A head without its end tag ends where the body starts.
        body = re.compile(r"<body\b", re.IGNORECASE).search(page, at)
        return body.start() if body else at
    return len(page) if name in TO_THE_END else at


def blocks_of(page: str, costs: Costs = COSTS) -> list[Block]:
    """The blocks of a page that have text, in order. Unclosed and stray tags, and a page that is cut off
    anywhere, are read as far as they go."""
    root = Element("", 0, 0.0, 0, None)
    top, count, blocks, at = root, 0, [], 0
    block: Block | None = None
    links = 0

    def add(text: str) -> None:
        nonlocal block
        if block is None:
            if text.isspace():
                return
            block = Block(top)
            blocks.append(block)
        text = html.unescape(text) if "&" in text else text
        block.pieces.append(text)
        if links:
            block.linked += len(text)

    def close(name: str, stop: frozenset[str]) -> None:
        nonlocal top
        node = top
        while node.parent is not None and node.name != name:
            if node.name in stop:
                return
            node = node.parent
        if node.parent is not None:
            top = node.parent

    while True:
        token = TOKEN.search(page, at)
        if token is None:
            if at < len(page):
                add(page[at:])
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        if token[1] or token[4]:
            if name == "a":
                links = 0
            if name in BLOCKS:
                block = None
                close(name, frozenset())
            continue
        if name in RAW:
            at = raw_end(page, name, token[0], at)
            continue
        if name == "br":
            add(" ") if block is not None else None
        if name == "a":
            links = 1
        if name in BLOCKS:
            block = None
            if name in CLOSES_P:
                close("p", frozenset(("td", "th", "table", "caption")))
            if name == "li":
                close("li", frozenset(("ul", "ol", "menu", "dir")))
            if name not in VOID:
                count += 1
                top = Element(name, count, weight_of(name, token[3] or token[6] or "", top.weight, costs), top.depth + 1, top)
    for block in blocks:
        block.text = " ".join("".join(block.pieces).split())
    return [b for b in blocks if b.text]


def odds(block: Block, costs: Costs = COSTS) -> float:
    """Log-odds that a block is content."""
    name, words = block.parent.name, block.text.count(" ") + 1
    z = costs.start + block.parent.weight
    z += costs.paragraph if name in ("p", "pre", "blockquote") else costs.heading if name in HEADINGS else costs.item
    z += min(costs.words * math.log2(words), costs.most_words)
    z += costs.sentence if block.text[-1] in ".!?:;\"'”’»…。！？" else 0
    return z + costs.links * min(1.0, block.linked / max(1, len(block.text)))


def shared_depth(a: Element, b: Element) -> int:
    while a is not b:
        if a.number > b.number:
            a = a.parent
        else:
            b = b.parent
    return a.depth


def ties(blocks: list[Block], costs: Costs = COSTS) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for k, block in enumerate(blocks):
        # Paragraphs and the like stand for their container.
        home = block.parent if block.parent.name in ("div", "td", "article", "section", "main", "body", "") else block.parent.parent
        if k:
            before = blocks[k - 1].parent
            deepest = max(before.depth, block.parent.depth, 1)
            out.append((k - 1, k, costs.next * (shared_depth(before, block.parent) / deepest) ** 2))
        if home.number in last and last[home.number] < k - 1:
            out.append((last[home.number], k, costs.sibling))
        last[home.number] = k
    return out


def minimum_cut(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut.

    Node k has a source edge of capacity z[k] or a sink edge of -z[k]; `edges` run both ways. A node whose
    terminal edge outweighs all its ties has that label in a minimum cut, and its ties become terminal
    capacities of its neighbours; max-flow by shortest augmenting paths settles what is left.
    """
    z = list(z)
    near: list[dict[int, float]] = [{} for _ in z]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * len(z)
    todo = deque(range(len(z)))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(z[k]) >= sum(near[k].values()):
            label[k] = z[k] > 0
            for other, w in near[k].items():
                del near[other][k]
                z[other] += w if label[k] else -w
                todo.append(other)
            near[k].clear()
    rest = [k for k, known in enumerate(label) if known is None]
    room = {k: dict(near[k]) for k in rest}
    source = {k: max(z[k], 0.0) for k in rest}
    sink = {k: max(-z[k], 0.0) for k in rest}
    while True:
        before: dict[int, int] = {k: -1 for k in rest if source[k] > 1e-12}
        queue, end = deque(before), -1
        while queue:
            k = queue.popleft()
            if sink[k] > 1e-12:
                end = k
                break
            for other, w in room[k].items():
                if w > 1e-12 and other not in before:
                    before[other] = k
                    queue.append(other)
        if end < 0:
            for k in rest:
                label[k] = k in before
            return [bool(x) for x in label]
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        flow = min(source[path[-1]], sink[end], *(room[b][a] for a, b in zip(path, path[1:])))
        source[path[-1]] -= flow
        sink[end] -= flow
        for a, b in zip(path, path[1:]):
            room[b][a] -= flow
            room[a][b] += flow


def main_text(page: str | None, costs: Costs = COSTS) -> str:
    """Content blocks joined by line feeds; white space inside a block is one space. Null gives none."""
    blocks = blocks_of(page or "", costs)
    content = minimum_cut([odds(b, costs) for b in blocks], ties(blocks, costs))
    return "\n".join(b.text for b, kept in zip(blocks, content, strict=True) if kept)


def extract(pages: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html).

    A null html, or one without content, has the empty text. Repeated rows are read one by one, null ids
    and urls stay null, no rows give no rows; other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")

    def run(batches):
        for batch in batches:
            texts = [main_text(page, costs) for page in column(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
