"""HTML main-text extraction by tree scoring.

Each paragraph (``p``, ``pre``, ``td``, ``blockquote``, and a ``div`` or the like that holds
text but no block) passes points to its ancestors: 1, one for each comma, and one for each 100
characters up to 3.  The parent gets all of them, the grandparent half, the next ones half
of that, a third of it and so on, as far as ``LEVELS``.  An ancestor's score is discounted by its link density, the
share of its text inside links.  The best container is kept, with those of its siblings that score a
fifth of it or are paragraphs of mostly plain text.

Elements that by their tag (``_SUSPECT``) or their class, id or role (``_UNLIKELY``) are no content are left
out only if they hold fewer than ``SUSPECT_CHARS`` characters or a third of their text is in links, each
without what is left out within it.  If the result is shorter than a share ``NEARLY_EMPTY`` of the plain
text left out, the page is extracted again with all of them.

Defined results: null, empty and tagless ``html`` give an empty or the plain text, score 0; ties go to the
container that opens first; unclosed, stray and misnested tags are repaired; every row gives
a row, null ids and repeated rows included; an empty table gives none; extra columns are ignored.
Work is linear in a page's length, whatever its tags and quotes.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm._store import column

MIN_CHARS = 25
LEVELS = 5
SUSPECT_CHARS, SUSPECT_LINKED, NEARLY_EMPTY = 200, 1 / 3, 1 / 5
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
SCHEMA = "page_id bigint, title string, text string, n_chars bigint, score double"
#: A tag whose attributes hold neither < nor >, as most do; no part can match a text twice, so failing is linear too.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*+)([^<>\"']*+(?:\"[^<>\"]*+\"[^<>\"']*+|'[^<>']*+'[^<>\"']*+)*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*+)")
_STOP = re.compile(r"[>\"']")
#: Elements whose content is no text of the page.
_RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "noscript", "template", "textarea", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SCORED = frozenset("p pre td blockquote".split())
_PLAIN = frozenset("div section article main li dd body".split())
_ENDS_P = _BLOCK - {"body", "html"}
_KEEPS_P = ("table", "td", "th", "div", "section", "article", "body", "li", "blockquote", "button")
_SAME = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
_UNLIKELY = re.compile(r"\b(?:ad|ads|advert\w*|banner|breadcrumb\w*|comment\w*|cookie\w*|footer|menu|nav|navbar|navigation|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|widget)\b", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SUSPECT = frozenset("nav footer aside form button".split())
_DROPPED = frozenset("select iframe object".split())
_BLANKS = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parent", "kids", "chars", "linked", "points", "dropped", "order", "blocks", "has_points", "suspect")

    def __init__(self, tag: str, parent: _Node | None, order: int, dropped: bool):
        self.tag, self.parent, self.order, self.dropped = tag, parent, order, dropped
        self.kids: list = []
        self.chars = self.linked = 0
        self.points = 0.0
        self.blocks = self.has_points = self.suspect = False


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(first character, character after the last, whether it closes, name, attributes) of each tag; comments, declarations and the content of ``_RAW`` elements have no name.

    A tag ends at the first > outside quotes.  Before a quote that is never closed, quotes mean nothing.
    """
    at, last, plain = 0, source.rfind(">"), 0
    while (at := source.find("<", at)) >= 0:
        begin = at
        m = _TAG.match(source, at)
        if m:
            closing, name, attributes = m.groups()
            at = m.end()
        elif source.startswith("<!--", at):
            at = source.find("-->", at + 4)
            at = len(source) if at < 0 else at + 3
            yield begin, at, False, "", ""
            continue
        elif at > last:
            return
        elif source.startswith(("<!", "<?"), at):
            at = source.find(">", at) + 1
            yield begin, at, False, "", ""
            continue
        elif m := _NAME.match(source, at):
            closing, name = m.groups()
            end = m.end()
            while at >= plain and (stop := _STOP.search(source, end)) and stop.group() != ">":
                end = source.find(stop.group(), stop.end()) + 1
                if not end:
                    plain = stop.end()
            end = source.find(">", m.end() if at < plain else end)
            if end < 0:  # the quoted ones were the last
                plain, end = len(source), source.find(">", m.end())
            attributes, at = source[m.end() : end], end + 1
        else:
            at += 1
            continue
        name = name.lower()
        if name in _RAW and not closing and not (name == "svg" and attributes.endswith("/")):
            m = _RAW[name].search(source, at)
            at, name = m.end() if m else len(source), ""
        yield begin, at, bool(closing), name, attributes


def parse(source: str) -> tuple[_Node, list[_Node], str]:
    """The root, all nodes in order, and the title's text."""
    root = _Node("#root", None, 0, False)
    nodes, path, title = [root], [root], []
    places: dict[str, list[int]] = {}  # where in ``path`` the open elements of each name stand
    blocks: list[int] = []  # and the open blocks
    end = 0

    def text(piece: str) -> None:
        at = path[-1]
        if "&" in piece:
            piece = _html.unescape(piece)
        if at.tag == "title":
            title.append(piece)
        elif piece and at.tag != "head":
            at.kids.append(piece)
            n = len(piece.strip())
            if n and not at.dropped:
                at.chars += n
                if places.get("a"):
                    at.linked += n

    def deepest(*names: str) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(depth: int) -> None:
        while len(path) > depth:
            tag = path.pop().tag
            places[tag].pop()
            if tag in _BLOCK:
                blocks.pop()

    for first, last, closing, name, attributes in tags(source):
        if first > end:
            text(source[end:first])
        end = last
        if not name:
            continue
        if closing:
            depth = deepest(name)
            if depth and (name in _BLOCK or not blocks or blocks[-1] < depth):
                close(depth)
            continue
        if name in _VOID:
            if name in ("br", "hr"):
                path[-1].kids.append("\n")
            continue
        if name in _ENDS_P and places.get("p") and places["p"][-1] > deepest(*_KEEPS_P):
            close(places["p"][-1])
        elif name in _SAME and deepest(name) > deepest(*_SAME[name]):
            close(deepest(name))
        at = path[-1]
        dropped = at.dropped or name in _DROPPED
        suspect = name in _SUSPECT
        if not dropped and not suspect and name not in ("body", "html", "article", "main") and attributes and ("class" in attributes or "id" in attributes or "role" in attributes or attributes.isupper()):
            suspect = any(_UNLIKELY.search(a or b or c) for a, b, c in _NAMES.findall(attributes))
        node = _Node(name, at, len(nodes), dropped)
        node.suspect = suspect
        if name in _BLOCK:
            up = at
            while up is not None and not up.blocks:
                up.blocks = True
                up = up.parent
        at.kids.append(node)
        nodes.append(node)
        if not attributes.endswith("/"):
            places.setdefault(name, []).append(len(path))
            if name in _BLOCK:
                blocks.append(len(path))
            path.append(node)
    if end < len(source):
        text(source[end:])
    return root, nodes, _BLANKS.sub(" ", "".join(title)).strip()


def render(node: _Node) -> str:
    """Text of a node: blocks on lines of their own, white space collapsed, dropped parts left out."""
    pieces: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            pieces.append(x if x == "\n" else _BLANKS.sub(" ", x))
        elif not x.dropped:
            if x.tag in _BLOCK:
                pieces.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.kids))
    return "\n".join(s for line in "".join(pieces).split("\n") if (s := _BLANKS.sub(" ", line).strip()))


def extract(source: str | None) -> tuple[str, str, float]:
    """(title, main text, score of the container)."""
    if not source:
        return "", "", 0.0
    title, text, score, lost = _extract(source, True)
    if len(text) < NEARLY_EMPTY * lost:
        again = _extract(source, False)
        if len(again[1]) > len(text):
            return again[:3]
    return title, text, score


def _extract(source: str, drop: bool) -> tuple[str, str, float, int]:
    """(title, main text, score of the container, characters outside links that were left out)."""
    root, nodes, title = parse(source)
    commas: dict[int, int] = {}
    lost = 0
    for node in reversed(nodes):  # sums over subtrees
        own = sum(k.count(",") + k.count("，") + k.count("、") for k in node.kids if isinstance(k, str)) if not node.dropped else 0
        commas[node.order] = commas.get(node.order, 0) + own
        if drop and node.suspect and not node.dropped and (node.chars < SUSPECT_CHARS or node.linked >= node.chars * SUSPECT_LINKED):
            node.dropped = True
            lost += node.chars - node.linked
        if node.parent is not None and not node.dropped:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            commas[node.parent.order] = commas.get(node.parent.order, 0) + commas[node.order]
    for node in nodes[1:]:
        node.dropped |= node.parent.dropped
    for node in nodes:
        if node.dropped or node.chars < MIN_CHARS or not (node.tag in _SCORED or node.tag in _PLAIN and not node.blocks):
            continue
        points = 1 + commas[node.order] + min(node.chars / 100, 3.0)
        up, level = node.parent, 0
        while up is not None and level < LEVELS:
            up.points += points / (1 if level == 0 else 2 * level)
            up.has_points = True
            up, level = up.parent, level + 1
    best, top = root, 0.0
    for node in nodes:
        if node.has_points and not node.dropped and node.tag != "#root":
            score = node.points * (1 - (node.linked / node.chars if node.chars else 0.0))
            if score > top:
                best, top = node, score
    if best is root:
        return title, render(root), 0.0, lost
    least = max(SIBLING_LEAST, top * SIBLING_SHARE)
    kept = []
    for k in best.parent.kids:
        if k is best:
            kept.append(k)
        elif not isinstance(k, str) and not k.dropped:
            density = k.linked / k.chars if k.chars else 0.0
            if k.points * (1 - density) >= least or k.tag == "p" and (density < 0.25 if k.chars > 80 else k.chars > 0 and density == 0):
                kept.append(k)
    return title, "\n".join(t for k in kept if (t := render(k))), top, lost


def scan(pages: DataFrame) -> DataFrame:
    """One row for each page: title, main text, its length and the container's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = [extract(s) for s in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())],
                    names=["page_id", "title", "text", "n_chars", "score"],
                )

    return pages.select(column(pages, "page_id", "bigint"), column(pages, "html", "string")).mapInArrow(run, SCHEMA)
