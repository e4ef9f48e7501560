import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import _text, nearcopies
from helpers import HIDDEN, ODD, clashing, empty, frame, prose


def bag(text):
    import re

    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return Counter(zip(*(w[k:] for k in range(3)))) if len(w) >= 3 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 0.0


def disturbed(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"n{r.randrange(9999)}" if r.random() < share else w for w in text.split())


def test_signatures_estimate_the_weighted_similarity():
    a = [prose(k, 20 + 7 * k, 60) for k in range(80)]
    b = [disturbed(t, 0.15, k) for k, t in enumerate(a)]
    texts = pa.array(a + b, pa.large_string())
    s = nearcopies.signatures(*nearcopies.shingles(_text.words(texts, nearcopies._SEPARATORS, fold=True), 160), 160, 512)
    true = np.array([jaccard(bag(x), bag(y)) for x, y in zip(a, b)])
    error = (s[:80] == s[80:]).mean(1) - true
    assert abs(error.mean()) < 0.01 and error.std() < 0.04
    assert np.allclose(nearcopies.overlap(texts[:80], texts[80:]), true)


def test_weights_count():
    """Words that repeat: the same set, other weights."""
    a, b = " ".join(["a b c"] * 20 + ["d e f"] * 2), " ".join(["a b c"] * 4 + ["d e f"] * 2)
    texts = pa.array([a, b], pa.large_string())
    s = nearcopies.signatures(*nearcopies.shingles(_text.words(texts, nearcopies._SEPARATORS, fold=True), 2), 2, 4096)
    assert (s[0] == s[1]).mean() == pytest.approx(jaccard(bag(a), bag(b)), abs=0.03)


def corpus():
    rows = []
    for g in range(60):
        base = prose(g, 30 + 11 * g)
        rows += [(2000 + len(rows) + k, disturbed(base, 0.03 * (k % 5), 100 * g + k)) for k in range(1 + g % 5)]
    return [*rows, *((1000 + k, rows[5][1].upper() + "!") for k in range(3)), *ODD]


def brute(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if bags[x] and bags[y] and jaccard(bags[x], bags[y]) >= nearcopies.THRESHOLD:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    out = {}
    for x, (i, _) in enumerate(rows):
        if bags[x]:
            out.setdefault(find(x), []).append(i)
    return [sorted(g, key=lambda i: (i is None, i)) for g in out.values() if len(g) > 1]


def test_groups_are_those_of_brute_force(spark):
    rows = corpus()
    got = {}
    for r in nearcopies.groups(frame(spark, rows)).collect():
        got.setdefault(r.group_id, []).append(r.doc_id)
        assert r.group_size > 1
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a is not None and b is not None and a < b}
    want, found = pairs(brute(rows)), pairs(got.values())
    assert found <= want and len(found) >= 0.95 * len(want)
    assert sorted(got[4]) == [4, 4]


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = nearcopies.keep_one(docs)
    assert out.columns == docs.columns
    left = Counter(r.doc_id for r in out.collect())
    grouped = {}
    for r in nearcopies.groups(docs).collect():
        grouped.setdefault(r.group_id, set()).add(r.doc_id)
    gone = {i for lead, g in grouped.items() for i in g if i != lead}
    want = Counter(i for i, _ in rows if i not in gone)
    want[4] = 1  # a repeated row
    assert left == want


def test_columns_of_any_name_stay(spark):
    rows = corpus()[:60]
    out = nearcopies.keep_one(clashing(frame(spark, rows)))
    assert out.columns == clashing(frame(spark, rows)).columns and out.count() == nearcopies.keep_one(frame(spark, rows)).count()
    assert all(r[name] == name for r in out.collect() for name in HIDDEN)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in nearcopies.components(links).collect()}
    assert got == {k: 1 for k in range(2, 41)} | {101: 100, 102: 100}


def test_empty_and_lonely(spark):
    assert nearcopies.groups(empty(spark)).count() == 0 and nearcopies.keep_one(empty(spark)).count() == 0
    assert nearcopies.groups(frame(spark, [(1, "a b c d"), (2, "e f g h"), (3, prose(1, 20_000))])).count() == 0
