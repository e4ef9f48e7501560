"""Malformed and long pages, and the scores against a plain version of their definition."""

import re
import time
from html.parser import HTMLParser

import pytest

from fieldloom.llm import htmltext

N = 1 << 20
WORDS = "Some words, some more words, and a last clause of the sentence with enough text to count."


@pytest.mark.parametrize(
    "page",
    ["<script " * (N // 8), '<a "' * (N // 4), '<a "' * (N // 4) + ">", "<!" * (N // 2), "<a '>'" * (N // 6) + '"', "<p>" + "<b>" * (N // 14) + "</i>" * (N // 14), "<div>" * (N // 10), "<b>" * (N // 14) + "<div>" + "</b>" * (N // 14), "<title>" + "a<!---->" * (N // 8), "&a" * (N // 2), "<script>" + "</script " * (N // 9), "<ul><li>" * (N // 16), "<p><b>" * (N // 12)],
    ids=["script", "quotes", "odd quotes", "declarations", "mixed quotes", "stray ends", "deep", "ends beyond blocks", "title", "entities", "raw text", "lists", "paragraphs"],
)
def test_time_is_linear_in_a_malformed_page(page):
    began = time.process_time()
    htmltext.extract(page[: N // 8])
    eighth = time.process_time() - began
    began = time.process_time()
    htmltext.extract(page)
    assert time.process_time() - began < max(1.0, 24 * eighth)


def test_long_pages_are_read_whole():
    body = "".join(f"<p>{k} {WORDS}</p>" for k in range(12_000))
    _, text, _ = htmltext.extract(f"<body><div class=menu><a href=/>Home</a></div><article>{body}</article></body>")
    assert len(text) > 1_000_000 and text.startswith("0 Some") and text.splitlines()[-1].startswith("11999 Some")


@pytest.mark.parametrize(
    "page, text",
    [("a < b and <3", "a < b and <3"), ("<p>x<svg width=1 /> y</p>", "x y"), ("<p>x<script-like>y</script-like></p>", "xy"), ("<p title='a>b'>x</p>", "x"), ("<p title='a>x", "x"), ("<p>x<!-- never closed", "x"), ("x<style>p{}", "x"), ("<P>x</P >y", "x\ny"), ("<p>x</b></div>y</p>", "xy"), ("<", "<"), ("<p", "<p")],
)
def test_broken_tags(page, text):
    assert htmltext.extract(page)[1] == text


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "head", "noscript", "template", "textarea", "svg", "select", "iframe", "object")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "head", "noscript", "template", "textarea", "svg", "select", "iframe", "object")

    def handle_data(self, data):
        if not self.skip:
            self.found.append(data)


def _pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()


def test_no_text_is_lost_or_made_up():
    for page in _pages():
        other = _Text()
        other.feed(page)
        other.close()
        root, _, _ = htmltext.parse(page)
        assert re.sub(r"\s", "", htmltext.render(root)) == re.sub(r"\s", "", "".join(other.found))


def _plain(page):
    """(score, text) of the best container: each node's characters, links, commas and points counted anew from its subtree."""
    root, nodes, _ = htmltext.parse(page)
    text_of = lambda n: [k for k in n.kids if isinstance(k, str)]

    def below(n):
        yield n
        for k in n.kids:
            if not isinstance(k, str) and k not in gone:
                yield from below(k)

    def linked(n):
        while n is not None:
            if n.tag == "a":
                return True
            n = n.parent

    def chars(n, links=False):
        return sum(len(k.strip()) for x in below(n) for k in text_of(x) if not x.dropped and (not links or linked(x)))

    gone = {n for n in nodes if n.dropped}
    for n in reversed(nodes):  # inner ones first
        if n.suspect and n not in gone and (chars(n) < htmltext.SUSPECT_CHARS or chars(n, True) >= chars(n) * htmltext.SUSPECT_LINKED):
            gone.add(n)
    out = lambda n: n is not None and (n in gone or out(n.parent))
    live = [n for n in nodes if not out(n)]
    paragraphs = [n for n in live if chars(n) >= htmltext.MIN_CHARS and (n.tag in htmltext._SCORED or n.tag in htmltext._PLAIN and not n.blocks)]
    points = {}
    for p in paragraphs:
        own = 1 + sum(k.count(",") for x in below(p) for k in text_of(x)) + min(chars(p) / 100, 3)
        up = p.parent
        for divisor in (1, 2, 4, 6, 8):
            if up is not None:
                points[up] = points.get(up, 0) + own / divisor
                up = up.parent
    scores = [(points[n] * (1 - chars(n, True) / max(1, chars(n))), n) for n in live if n in points and n is not root]
    best = max((s for s, _ in scores), default=0.0)
    return best, next((n for s, n in scores if s == pytest.approx(best)), root)


def test_scores_are_those_of_the_definition():
    for page in [*_pages(), f"<body><div><p>{WORDS}</p><div><p>{WORDS} <a href=x>{WORDS}</a></p></div></div><nav>{WORDS}</nav></body>", "<ul><li>" + WORDS + "<li>" + WORDS + "</ul>"]:
        best, _ = _plain(page)
        _, _, score, _ = htmltext._extract(page, True)
        assert score == pytest.approx(best)
