"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each at the end of a path of tags. Text length and punctuation are summed up per
path, averaged over its blocks, smoothed along the page, fused into one score and held against a threshold. The element that
holds the paths above it is the content: all of it where that is an article. Elsewhere blocks of links come out only on paths
that score like the page's text. Parts that by their tag or role are no article text (menus, footers and the like) carry no score and
never come out; nor do forms and parts that only a class or id names so, unless they hold most of the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import texts_of

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[.,;:!?…。，、！？؟]")
# HTML's void elements, elements whose text is not markup, block elements, and elements that end an open paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes svg".split())
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
INLINE_END = BLOCKS - {"br", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "body", "html", "head"}
# What is no article text, by tag, role, and words of class or id.
DROPPED = set("head nav footer aside button select menu dialog object applet audio video canvas search datalist label".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog menu menubar form toolbar tablist alert".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar sidebar "
    "footer foot comment comments disqus cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay "
    "share sharing social breadcrumb breadcrumbs related recommended recommendations pagination pager toolbar masthead widget widgets skip outbrain taboola alert disclaimer paywall".split()
)
READERS = {"comment", "comments", "disqus"}
#: Words that a class may have beside READERS and still name the comment itself, not a state of what is commented.
OF_READERS = READERS | {"list", "item", "thread", "body", "text", "reply", "replies", "user", "section", "area", "box"}
#: A class that says how a layout goes with a side part, not that it is one.
LAYOUT = {"with", "without", "has", "no"}
OUTER_NAMES = {"header", "topbar", "top"}
SECTIONS = {"article", "main", "section", "body", "html", "div", "td", "center"}


@dataclass
class Node:
    tag: str
    parent: Node | None
    path: int  #: number of the root-to-leaf tag path on this page
    dropped: bool
    depth: int = 0
    article: bool = False
    named: Node | None = None  #: the nearest element, itself included, that goes by a name unless it holds most of the text


@dataclass
class Block:
    node: Node
    text: str
    linked: int = 0


def _names(attributes: str) -> tuple[set[str], set[str], bool, bool]:
    words: set[str] = set()
    comment = False
    roles: set[str] = set()
    hidden = False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            for part in value.split():
                own = {w.lower() for w in _TOKEN.findall(part)}
                comment |= bool(own & READERS) and own <= OF_READERS
                words |= own
        elif name == "role":
            roles |= set(value.lower().split())
        elif name == "hidden" and not attributes[: m.start()].rstrip().endswith("-"):
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
    return words, roles, hidden, comment


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, those in dropped parts too, white space as one space, character references decoded."""
    root = Node("", None, 0, False)
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    at = root
    out: list[Block] = []
    held: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(at, text, linked))
        held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            held.append(entities.unescape(raw))
            if links:
                linked += len(raw)

    def close_to(node: Node) -> None:
        nonlocal at
        while at is not node:
            opened[at.tag] -= 1
            at = at.parent or root
        opened[node.tag] -= 1
        at = node.parent or root

    def find(tags: set[str], stop: set[str]) -> Node | None:
        if not any(opened[t] for t in tags):
            return None
        node = at
        while node is not root:
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
            node = node.parent
        return None

    pos = 0
    scan = _MARK.search
    while (m := scan(page, pos)) is not None:
        add(page[pos : m.start()])
        pos = m.end()
        end, start = m[1], m[2] or m[4]
        if end:
            tag = end.lower()
            if tag == "br":
                flush()
                continue
            if tag == "p" and find({"p"}, set()) is None:
                flush()
                continue
            # an inline end tag closes its element only within the present block
            stop = set() if tag in BLOCKS else BLOCKS - {"br"}
            node = find({tag}, stop)
            if node is None:
                continue
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            close_to(node)
        elif start:
            tag, attributes = start.lower(), m[3] or m[5] or ""
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, pos)
                    pos = close.end() if close else len(page)
                continue
            if tag in BLOCKS:
                flush()
                links = 0
            if tag in INLINE_END and (p := find({"p"}, {"td", "th", "table", "button", "object"})):
                close_to(p)
            if re.fullmatch("h[1-6]", tag) and (h := find({f"h{i}" for i in range(1, 7)}, BLOCKS - {f"h{i}" for i in range(1, 7)} - {"br"})):
                close_to(h)
            if tag in CLOSERS:
                while node := find(CLOSERS[tag], SCOPES[tag]):
                    close_to(node)
            if tag in VOID:
                continue
            if tag == "a":
                links += 1
            words, roles, hidden, comment = _names(attributes) if attributes else (set(), set(), False, False)
            article = at.article or tag in ("article", "main")
            body = tag in ("html", "body", "article", "main")
            names = NAMES if article else NAMES | OUTER_NAMES
            dropped = at.dropped or tag in DROPPED or tag == "header" and not article or hidden or bool(roles & ROLES)
            dropped = dropped or comment and tag not in ("html", "body", "main")
            path = paths.setdefault((at.path, tag), len(paths) + 1)
            node = Node(tag, at, path, dropped, at.depth + 1, article, at.named)
            # a form may be all of a page's frame, so it goes as an element that only goes by a name does
            if tag == "form" or not body and not words & LAYOUT and words & names:
                node.named = node
            if not attributes.rstrip().endswith("/") or tag in BLOCKS:
                at = node
                opened[tag] += 1
    add(page[pos:])
    flush()
    _drop_named(out)
    return out


def _drop_named(blocks: list[Block]) -> None:
    """Drop what lies in elements named as no article text, except those that hold most of the text that is not links, and of
    the text in articles if there is any."""
    live = [b for b in blocks if not b.node.dropped]
    whole, held = [0, 0], defaultdict(lambda: [0, 0])
    for b in live:
        n = max(0, len(b.text) - b.linked)
        for count in (whole, *(held[id(x)] for x in _named(b.node))):
            count[0] += n
            count[1] += n * b.node.article
    for b in live:
        b.node.dropped = any(2 * held[id(x)][0] <= whole[0] or 2 * held[id(x)][1] < whole[1] for x in _named(b.node))


def _named(node: Node) -> Iterator[Node]:
    at = node.named
    while at is not None:
        yield at
        at = at.parent.named if at.parent else None


def path_scores(blocks: list[Block], reach: int = 2) -> dict[int, float]:
    """Fused score of each tag path: its smoothed text and punctuation ratios, both against the page's highest."""
    text: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    many: dict[int, int] = defaultdict(int)
    for b in blocks:
        text[b.node.path] += max(0, len(b.text) - b.linked)
        marks[b.node.path] += len(_PUNCT.findall(b.text))
        many[b.node.path] += 1
    order = [b.node.path for b in blocks]
    kernel = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2)
    total = np.convolve(np.ones(len(order)), kernel, "same") if len(order) > 2 * reach else None
    parts = []
    for ratio in (text, marks):
        line = np.array([ratio[p] / many[p] for p in order])
        if total is not None:
            line = np.convolve(line, kernel, "same") / total
        parts.append(line / max(line.max(initial=0.0), 1e-9))
    line = np.sqrt(parts[0] * (parts[1] + 0.1))
    sums: dict[int, float] = defaultdict(float)
    for q, v in zip(order, line.tolist(), strict=True):
        sums[q] += v
    return {p: sums[p] / many[p] for p in many}


def _above(node: Node) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out[::-1]


def main_text(page: str) -> str:
    """Text blocks of the page's content, one to a line; empty if there is none."""
    blocks = [b for b in blocks_of(page) if not b.node.dropped]
    if not blocks:
        return ""
    scores = path_scores(blocks)
    values = np.array([scores[b.node.path] for b in blocks])
    threshold = min(values.max(), values.mean() - 0.5 * values.std())  # equal values may lie below their own mean
    chosen = [b for b, v in zip(blocks, values, strict=True) if v >= threshold]
    # the deepest element that holds nearly all of the chosen text
    weight: dict[int, float] = defaultdict(float)
    nodes: dict[int, Node] = {}
    for b in chosen:
        for n in _above(b.node):
            weight[id(n)] += len(b.text)
            nodes[id(n)] = n
    whole = sum(len(b.text) for b in chosen)
    top = max((n for k, n in nodes.items() if weight[k] >= 0.85 * whole), key=lambda n: n.depth)
    while top.parent is not None and top.tag not in SECTIONS:
        top = top.parent
    for n in _above(top):  # an article is whole
        if n.tag in ("article", "main"):
            return "\n".join(b.text for b in blocks if any(x is n for x in _above(b.node)))
    # elsewhere all but what is mostly links is content, and headings are; links are if their path scores like text and they stand
    # within the lowest element above all that scores
    plain = {id(b) for b in blocks if 2 * b.linked < len(b.text)}
    inner = _common([b for b in chosen if id(b) in plain] or chosen)
    kept = plain | {id(b) for b in blocks if any(re.fullmatch("h[1-6]", n.tag) for n in _above(b.node))}
    size = sum(len(b.text) for b in blocks if id(b) in plain)
    level = sum(len(b.text) * scores[b.node.path] for b in blocks if id(b) in plain) / max(1, size)
    scored = {id(b) for b in blocks if scores[b.node.path] >= level / 2}  # of the score that the page's text has on average
    return "\n".join(b.text for b in blocks if id(b) in kept or id(b) in scored and any(n is inner for n in _above(b.node)))


def _common(blocks: list[Block]) -> Node:
    """The lowest element above all blocks."""
    lines = [_above(b.node) for b in blocks]
    return [ns[0] for ns in zip(*lines, strict=False) if all(n is ns[0] for n in ns)][-1]


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)``, a row per input row; text is empty where a page is null, empty or has no content.

    Ids and urls, null or repeated, stay as they are; other columns are not read. No shuffle.
    """
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.decode("utf-8", "replace")) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
