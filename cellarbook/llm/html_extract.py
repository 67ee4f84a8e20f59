"""Main text of web pages: blocks labelled by a minimum cut.

A page becomes a row of text blocks. A logistic classifier gives each block log odds of being content, which
are its capacities to the two terminals; blocks that follow each other or share a parent are tied by edges.
The minimum cut keeps blocks with their surroundings unless their own evidence is stronger than the ties.

The classifier's evidence has two parts. Text and layout (length, links, punctuation, neighbours) have weights
fitted on a bounded sample of pages, where semantic elements (article, main; nav, footer, aside) tell some blocks'
labels; the fit sees neither those elements nor any name. Markup has fixed weights, and a name or form counts less
the more of the page's own text it holds: what holds the article is its wrapper, whatever it is called.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the classifier is fitted on, at most, and their blocks, at most.
SAMPLE, SAMPLE_BLOCKS = 2048, 60_000
ADJACENT, SAME_PARENT = 0.4, 0.8

#: Names in HTML and in common markup.
RAW = "script style title textarea"  # up to their closing tag, whatever is between
UNSEEN = frozenset("noscript template svg iframe object canvas select button annotation annotation-xml".split())
FOREIGN = frozenset(("svg", "math"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = frozenset(("article", "main"))
FRAME_TAGS = frozenset("nav footer aside menu dialog".split())
FORM_TAGS = frozenset(("form", "fieldset"))
FRAME_WORDS = frozenset(
    "ad ads adv nav navbar navigation menu footer header sidebar side aside banner cookie cookies notice consent promo sponsor sponsored "
    "breadcrumb breadcrumbs share social related recommended newsletter subscribe signup login popup modal overlay toolbar widget "
    "pagination pager tags comment comments reply replies disqus contentinfo complementary search alert masthead topbar copyright legal".split()
)
#: Names written as one word: a frame's name between what may stand before and behind it.
FRAME_PARTS = re.compile(
    r"(?:page|site|main|top|left|right|bottom|post|user|reader)?(?:advert|cookie|sidebar|footer|comment|newsletter|breadcrumb|sponsor|promo|banner|navigation|popup)"
    r"(?:s|ing|isement|isements|ment|or|ors|bar|box|list|area|wrap|wrapper|section|form|notice|banner|block|container|content|thread|row|inner|menu|links|consent|policy)?"
)
#: Words that make a name a state of what holds the frame, or of the page: "has-sidebar", "comments-open".
STATES = frozenset("has no with without layout on off open closed enabled disabled".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")(?![\w:-])[^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_CLOSE = {raw: re.compile(rf"</{raw}\s*>", re.IGNORECASE) for raw in RAW.split()}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HUMP = re.compile("(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)

MARKUP = ("content_tag", "outside_content", "frame_tag", "frame_name", "content_name")
TEXT = ("one", "heading", "words", "links", "stop", "item", "commas", "near")
FEATURES = MARKUP + TEXT
PRIOR = np.array([3.0, -3.0, -6.0, -6.0, 1.0, -1.0, 0.5, 0.5, -3.0, 0.7, -0.7, 0.1, 0.1])
TEXT_MOST = 2.5  # log odds that text and layout give at most, less than the elements of HTML
#: A wrapper holds the page's title or main element with this share of its text, or else more and more of the text.
TITLED, FADES, FADED = 0.3, 0.6, 0.9


class _Element:
    """An open element. `frame` and `framed` become its weights as a frame, its own and those it inherits."""

    __slots__ = ("tag", "content", "frame", "framed", "fades", "named", "number", "above")

    def __init__(self, tag: str, attrs: str, above, number: int):
        names = " ".join("".join(m) for m in _NAMES.findall(attrs)) if attrs else ""
        parts = [[w for w in re.split("[^a-z0-9]+", _HUMP.sub("-", name).lower()) if w] for name in names.split()]
        words = {w for part in parts if not STATES.intersection(part) for w in part}
        inside = above is not None and above.content
        self.tag, self.number, self.above = tag, number, above
        self.content = inside or tag in CONTENT_TAGS or "main" in words and tag not in FRAME_TAGS
        self.frame = float(tag in FRAME_TAGS or tag in FORM_TAGS or tag == "header" and not inside)
        named = any(w in FRAME_WORDS or FRAME_PARTS.fullmatch(w) for w in words)
        if inside and tag == "header" or tag in ("body", "html", "article", "main"):
            named = False
        self.framed = float(named or bool(attrs and _HIDDEN.search(attrs)))
        self.fades = tag not in FRAME_TAGS and tag != "header"
        self.named = bool(words & CONTENT_WORDS) or above is not None and above.named


class Block:
    __slots__ = ("text", "linked", "element", "parent")

    def __init__(self, text: str, linked: int, element: _Element, parent: int):
        self.text, self.linked, self.element, self.parent = text, linked, element, parent


def _weigh(elements: list[_Element], blocks: list[Block]) -> None:
    """Make frames weigh less the more of the page's text they hold, then hand their weights down.

    Text of links and of elements that are always frames is not counted. Elements are in page order, so that each
    comes behind the one around it.
    """
    text, always = [0] * len(elements), [False] * len(elements)
    for e in elements[1:]:
        always[e.number] = always[e.above.number] or e.frame > 0 and not e.fades
    for b in blocks:
        if not always[b.element.number]:
            text[b.element.number] += max(0, len(b.text) - b.linked)
    titled = [e.tag in ("h1", "main") for e in elements]
    content = [0] * len(elements)  # text of articles within
    for e in reversed(elements[1:]):
        i, up = e.number, e.above.number
        if e.content and not e.above.content:
            content[i] = 0 if e.framed or e.frame else text[i]
        text[up] += text[i]
        content[up] += content[i]
        titled[up] = titled[up] or titled[i]
    for e in elements[1:]:
        i = e.number
        if (e.frame or e.framed) and e.fades and text[0] and 2 * content[i] >= content[0]:
            share = text[i] / text[0]
            left = 0.0 if titled[i] and share >= TITLED else min(1.0, max(0.0, (FADED - share) / (FADED - FADES)))
            e.frame, e.framed = e.frame * left, e.framed * left
        e.frame, e.framed = max(e.frame, e.above.frame), max(e.framed, e.above.framed)


def _tags(page: str) -> tuple[list[tuple[int, int, re.Match]], dict[int, int]]:
    """(start, end, match) of every tag or comment, raw text included, and of each unseen element the tag that closes it."""
    tags, closed, at = [], {}, 0
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    while m := _TOKEN.search(page, at):
        at = m.end()
        if m["raw"]:
            # In svg and math, "/>" closes any element.
            if not (page[at - 2] == "/" and any(open_.get(x) for x in FOREIGN)):
                close = _CLOSE[m["raw"].lower()].search(page, at)
                at = close.end() if close else len(page)
        elif m["tag"]:
            tag = m["tag"].lower()
            if not m["end"]:
                if tag not in VOID and not m["attrs"].endswith("/"):
                    stack.append((tag, len(tags)))
                    open_[tag] = open_.get(tag, 0) + 1
            elif open_.get(tag):
                while True:
                    name, number = stack.pop()
                    open_[name] -= 1
                    if name == tag:
                        break
                if tag in UNSEEN:
                    closed[number] = len(tags)
        tags.append((m.start(), at, m))
    return tags, closed


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles, comments and markup are gone, references are decoded.

    An unseen element that nothing closes ends before the next block, or with the element around it. <head> hides
    nothing: its title, script and style are raw text, and any other text ends it.
    """
    root = _Element("", "", None, 0)
    stack, out, elements = [root], [], [root]
    parts: list[str] = []
    linked = links = 0

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            holder = next((e for e in reversed(stack) if e.tag in BLOCKS), root)
            around = next((e for e in reversed(stack) if e.tag in BLOCKS and e is not holder), root)
            out.append(Block(text, linked, holder, around.number))
        parts, linked = [], 0

    at, skip, hidden = 0, -1, False
    tags, closed = _tags(page)
    for k, (start, end, m) in enumerate(tags):
        if k <= skip:
            at = end
            continue
        if start > at and not hidden:
            parts.append(page[at:start])
            linked += (start - at) * (links > 0)
        at = end
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() == "title":
                flush()
            continue
        if hidden:
            hidden = tag.lower() not in BLOCKS and not (m["end"] and any(e.tag == tag.lower() for e in stack))
            if hidden:
                continue
        if tag.lower() == "head":
            flush()
            continue
        if tag.lower() in UNSEEN and not m["end"] and not m["attrs"].endswith("/"):
            skip, hidden = closed.get(k, -1), k not in closed
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if m["end"]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if place:
                links -= sum(e.tag == "a" for e in stack[place:])
                del stack[place:]
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag in ("p", "li") or tag in BLOCKS and stack[-1].tag in ("p", "b", "i", "em", "strong", "span"):
            # An open paragraph ends where the next block begins, and so do marks that were left open in it.
            limit = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in BLOCKS and stack[i].tag not in ("p", "li")), 0)
            open_ = next((i for i in range(limit + 1, len(stack)) if stack[i].tag == ("li" if tag == "li" else "p")), 0)
            if open_:
                links -= sum(e.tag == "a" for e in stack[open_:])
                del stack[open_:]
        links += tag == "a"
        stack.append(_Element(tag, m["attrs"], stack[-1], len(elements)))
        elements.append(stack[-1])
    if at < len(page) and not hidden:
        parts.append(page[at:])
    flush()
    _weigh(elements, out)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    anywhere = any(b.element.content for b in blocks)
    words = [float(np.log1p(b.text.count(" "))) for b in blocks]
    around = [0.0, *words, 0.0]
    rows = []
    for i, b in enumerate(blocks):
        e = b.element
        rows.append(
            (
                e.content, anywhere and not e.content, e.frame, e.framed, e.named,
                1.0, e.tag in ("h1", "h2", "h3"), words[i], min(1.0, b.linked / max(1, len(b.text))), b.text[-1] in ".!?…:\"'”", e.tag == "li",
                np.log1p(b.text.count(", ")), (around[i] + around[i + 2]) / 2,
            )
        )
    return np.array(rows, float).reshape(-1, len(FEATURES))


def odds(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of being content: those of the markup, and those of text and layout within bounds."""
    n = len(MARKUP)
    return x[:, :n] @ weights[:n] + np.clip(x[:, n:] @ weights[n:], -TEXT_MOST, TEXT_MOST)


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 in article or main, 0 in nav, footer, aside and the like, -1 where no element of HTML tells."""
    content, tag, name = x[:, 0] > 0, x[:, 2] >= 1, x[:, 3] > 0
    return np.where(tag, 0, np.where(content & ~name, 1, -1))


def fit_rows(x: np.ndarray, y: np.ndarray, strength: float = 20.0) -> np.ndarray:
    """PRIOR with logistic weights of TEXT near it; the columns of MARKUP are not looked at."""
    n = len(MARKUP)
    x, prior = x[:, n:], PRIOR[n:]
    w = prior.copy()
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([PRIOR[:n], w])


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut.

    A node is tied to the source by its odds if they are positive, else to the sink. A node whose odds outweigh
    all its edges is on its own side in every minimum cut; its edges then count as odds of its neighbours. What
    is left goes through augmenting paths.
    """
    n, odds = len(odds), list(odds)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, weight in edges:
        if a != b:
            around[a][b] = around[a].get(b, 0.0) + weight
            around[b][a] = around[b].get(a, 0.0) + weight
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        x = todo.popleft()
        if side[x] is None and abs(odds[x]) >= sum(around[x].values()):
            side[x] = odds[x] > 0
            for y, weight in around[x].items():
                odds[y] += weight if side[x] else -weight
                del around[y][x]
                todo.append(y)
            around[x] = {}
    rest = [x for x in range(n) if side[x] is None]
    if rest:
        room = {x: dict(around[x]) for x in rest}
        room["s"] = {x: odds[x] for x in rest if odds[x] > 0}
        for x in rest:
            room[x]["s"] = 0.0
            room[x]["t"] = max(0.0, -odds[x])
        room["t"] = dict.fromkeys(rest, 0.0)
        while True:
            came, line = {"s": None}, deque(["s"])
            while line and "t" not in came:
                x = line.popleft()
                for y, left in room[x].items():
                    if left > 1e-12 and y not in came:
                        came[y] = x
                        line.append(y)
            if "t" not in came:
                break
            path, y = [], "t"
            while came[y] is not None:
                path.append((came[y], y))
                y = came[y]
            flow = min(room[a][b] for a, b in path)
            for a, b in path:
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0.0) + flow
        for x in rest:
            side[x] = x in came
    return [bool(s) for s in side]


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other, and between the next ones of one parent."""
    last: dict[int, int] = {}
    out = []
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, ADJACENT))
        if b.parent in last:
            out.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return out


def extract(page: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by empty lines; nothing for null and for pages without text."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    kept = minimum_cut(odds(features(blocks), weights).tolist(), ties(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from the pages with the smallest hashes of page_id, `sample` at most, read whole.

    The driver gets SAMPLE_BLOCKS rows of numbers at most. Without pages the prior weights hold.
    """

    def run(batches):
        for batch in batches:
            found = [features(b) for page in batch.column(0).to_pylist() if (b := blocks_of(page or ""))]
            if found:
                x = np.concatenate(found)
                arrays = [pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(weak_labels(x), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["x", "y"])

    ids = pages.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").select("html")  # bounded by `sample` rows
    known = rows.mapInArrow(run, "x array<double>, y int").where("y >= 0")
    found = known.orderBy(F.xxhash64("x", "y"), "x", "y").limit(SAMPLE_BLOCKS).collect()  # the same however rows are spread
    if not found:
        return PRIOR.copy()
    ordered = sorted((tuple(r.x), r.y) for r in found)
    return fit_rows(np.array([x for x, _ in ordered]), np.array([y for _, y in ordered], float))


def main_text(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text) of every row; other columns are ignored, rows that repeat are done again."""

    def run(batches):
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
