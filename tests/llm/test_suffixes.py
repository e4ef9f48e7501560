import random

import numpy as np
import pytest

from fieldloom.llm import suffixes
from helpers import HIDDEN, ODD, clashing, empty, frame, prose


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    r = random.Random(seed)
    t = [r.randrange(r.randint(1, 5)) + 9 for _ in range(r.randint(0, 60))]
    t = np.array(t + ([3] + t if seed % 3 == 0 else []) + [0])
    assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    sa = suffixes.suffix_array(t)
    for k, n in zip(range(1, len(t)), suffixes.common(t, sa, 6)[1:]):
        a, b = t[sa[k - 1] :].tolist(), t[sa[k] :].tolist()
        assert n == min(6, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def brute(rows, least):
    """Ranges by comparing all grams."""
    docs = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=lambda d: (d[0], d[1] or 0))
    places = {}
    for none, i, t in docs:
        w = t.split()
        for p in range(len(w) - least + 1):
            places.setdefault(tuple(w[p : p + least]), []).append((i, t, p))
    marks = {}
    for where in places.values():
        if len(where) > 1:
            for nth, (i, t, p) in enumerate(where):
                marks.setdefault((i, t, nth == 0), []).append(p)
    out = []
    for (i, _, first), ps in marks.items():
        start = last = None
        for p in sorted(ps):
            if start is None or p > last + least:
                if start is not None:
                    out.append((i, start, last + least, first))
                start = p
            last = p
        out.append((i, start, last + least, first))
    return sorted(out, key=str)


def rows_of(seed):
    r = random.Random(seed)
    shared = [prose(1000 + k, r.randint(8, 40), 50) for k in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(seed * 100 + i * 7 + k, r.randint(0, 25), 300) for k in range(3)]
        parts.insert(r.randint(0, 3), r.choice([*shared, ""]))
        rows.append((i, " ".join(p for p in parts if p)))
    return [*rows, (50, rows[3][1]), (51, "x y " * 30), *ODD, *ODD[-2:]]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_are_those_of_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "SORTED_WORDS", 400)
    rows = rows_of(seed)
    got = sorted(map(tuple, suffixes.ranges(frame(spark, rows), least=8, anchor=3).select("doc_id", "start", "stop", "first").collect()), key=str)
    assert got == brute(rows, 8)


def test_cut_leaves_one_occurrence(spark):
    passage = prose(5, 60)
    rows = [(1, prose(6, 30) + " " + passage), (2, passage + " " + prose(7, 30)), (3, prose(8, 200)), (None, None), (4, ""), (5, passage), (6, prose(9, 25_000))]
    docs = frame(spark, rows)
    out = suffixes.cut(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[6].text == rows[6][1] and got[None].text is None
    assert got[2].text == prose(7, 30) and got[5].text == "" and got[2].n_chars == len(got[2].text)


def test_columns_of_any_name_stay(spark):
    docs = clashing(frame(spark, [(1, prose(5, 60)), (2, prose(5, 60)), (3, None)]))
    out = suffixes.cut(docs)
    assert out.columns == docs.columns and out.filter("text <> ''").count() == 1 and all(r[name] == name for r in out.collect() for name in HIDDEN)


def test_rows_alike_in_id_and_text_are_one_document(spark):
    docs = frame(spark, [(1, prose(5, 60)), (1, prose(5, 60))])
    assert suffixes.repeats(docs).count() == 0 and suffixes.cut(docs).filter("text <> ''").count() == 2


def test_empty_table(spark):
    assert suffixes.repeats(empty(spark)).count() == 0 and suffixes.cut(empty(spark)).count() == 0
