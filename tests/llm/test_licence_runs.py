import random
import re

import pyarrow as pa
import pytest

from fieldloom.llm import licences
from helpers import frame, prose

MIT, GPL = licences.TEMPLATES[0][1], next(text for name, text in licences.TEMPLATES if name == "GPL-3.0")  # the notice


def _paragraphs(text, blank, mark=""):
    return blank.join(mark + p for p in re.split(r"(?<=[.:]) ", text))


@pytest.mark.parametrize("blank, mark", [("\n\n", ""), ("\r\n\r\n", ""), ("\n  \n", ""), ("\n#\n", "# "), ("\n", " * "), (" ", "")])
def test_licences_in_any_layout_within_longer_texts(spark, blank, mark):
    rows = [(k, f"{prose(k, 300)}{blank}{_paragraphs(text, blank, mark)}{blank}{prose(k + 9, 300)}") for k, text in enumerate((MIT, GPL))]
    found = {(r.doc_id, r.licence): r for r in licences.scan(frame(spark, rows)).collect()}
    assert set(found) == {(0, "MIT"), (1, "GPL-3.0")}
    assert all(r.dice == 1.0 and r.units == 1 for r in found.values())


def test_a_sentence_within_a_line():
    text = f"{prose(1, 80)} This project is licensed under the MIT License. {prose(2, 80)}"
    assert [(r[1], r[2]) for r in licences.find(pa.array([prose(3, 50), text]))] == [("MIT", 1.0)]


def test_each_occurrence_counts_once():
    line = "This is free and unencumbered software released into the public domain."
    text = f"{prose(1, 40)} {line} {prose(2, 40)}\n{line}\n{prose(3, 40)} {line} {prose(4, 40)}"
    assert [r[1:] for r in licences.find(pa.array([text]))] == [("Unlicense", 1.0, 3)]


@pytest.mark.parametrize("seed", range(20))
def test_best_run_is_that_of_all_runs(seed):
    r = random.Random(seed)
    template = [f"w{r.randrange(9)}" for _ in range(10)]
    words = [f"w{r.randrange(40)}" for _ in range(15)] + [x for x in template if r.random() < 0.95] + [f"w{r.randrange(40)}" for _ in range(15)]
    b = licences.bigrams(" ".join(template))
    most = int((len(template) - 1) * 1.5)
    want = max(2 * len(a & b) / (len(a) + len(b)) for i in range(len(words)) for k in range(1, most + 1) if i + k < len(words) and (a := licences.bigrams(" ".join(words[i : i + k + 1]))))
    got = [f[2] for f in licences.find(pa.array([" ".join(words)]), (("L", " ".join(template)),))]
    assert got == ([pytest.approx(want)] if want >= licences.THRESHOLD else [])


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"])
def test_whole_texts(spark, name):
    text = dict(licences._TEXTS)[name]
    rewrapped = " ".join(text.split())
    rows = [(1, text), (2, rewrapped.upper()), (3, f"{prose(1, 40)}\n{text}\n{prose(2, 40)}"), (4, text[: len(text) // 3])]
    found = {(r.doc_id, r.licence): r.dice for r in licences.scan(frame(spark, rows)).collect()}
    assert found[1, name] == found[2, name] == 1.0 and found[3, name] >= 0.9
    assert {lic for doc, lic in found if doc in (1, 2)} == {name} and (4, name) not in found


def test_templates_that_tie_are_both_found():
    twins = (("A", "one two three four five six"), ("B", "one two three four five six"))
    assert [r[1:] for r in licences.find(pa.array([f"{prose(1, 30)}\none two three four five six\n{prose(2, 30)}"]), twins)] == [("A", 1.0, 1), ("B", 1.0, 1)]
