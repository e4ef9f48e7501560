import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import arrays
from fieldloom.operators.assign import assignment, by_key, hungarian


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_optimal(seed):
    r = np.random.default_rng(seed)
    n, m = (int(x) for x in r.integers(1, 6, 2))
    c = r.random((n, m)) if seed % 2 else r.integers(0, 3, (n, m)).astype(float)
    k = min(n, m)
    best = min(sum(c[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    got = assignment(c)
    assert sum(c[i, j] for i, j in got) == pytest.approx(best) and len({i for i, _ in got}) == len({j for _, j in got}) == k


def test_hungarian_beats_greedy_order():
    assert hungarian([10, 20], [19, 11], threshold=0.5) == [(0, 1), (1, 0)] and hungarian([], [1]) == []
    assert hungarian([{"k": "a", "v": 1}], [{"k": "b", "v": 1}, {"k": "a", "v": 9}], key="k") == [(0, 1)]


def test_keys():
    assert by_key([{"id": None}, {"x": 1}], [{"id": None}], key="id") == [(0, 0)]
    assert by_key([1, 2], [3], key="id") == []
    assert by_key([{"a": 1, "b": 2}], [{"a": 1, "b": 3}], key=["a", "b"], threshold=0.5) == [(0, 0)]


def test_row_pairs_are_those_of_the_loop(spark):
    r = random.Random(4)
    rows = [([r.randrange(4) for _ in range(r.randrange(6))], [r.randrange(4) for _ in range(r.randrange(6))]) for _ in range(60)]
    df = spark.createDataFrame([(i, e, a) for i, (e, a) in enumerate(rows)], "i int, e array<int>, a array<int>")
    score = lambda a, e: F.when(a == e, 1.0).otherwise(0.0)
    for row in df.select("i", arrays.pairs_by_score(F.col("e"), F.col("a"), score).alias("p")).collect():
        e, a = rows[row.i]
        assert [(p.e, p.a) for p in row.p] == by_key(e, a)


def test_joins_are_those_of_the_loop(spark):
    r = random.Random(5)
    sides = [[(g, p, r.choice([None, 1, 2, 3])) for g in range(15) for p in range(r.randrange(6))] for _ in range(2)]
    e, a = (spark.createDataFrame(s, "g int, p int, k int") for s in sides)
    got = {}
    for row in arrays.align_by_key(e, a, ["g"], ["k"], "p").collect():
        if row.in_expected and row.in_actual:
            got.setdefault(row.g, []).append((row.e_p, row.a_p))
    for g in range(15):
        want = by_key(*([k for gg, _, k in s if gg == g] for s in sides))
        assert sorted(got.get(g, [])) == want


def _all_pairs(expected, actual, scorer=None, key=None):
    """One pair at a time."""
    from fieldloom.operators import assign as A

    if key is None:
        return [[A._score(scorer, e, a) for a in actual] for e in expected]
    scorers = scorer if isinstance(scorer, dict) else dict.fromkeys(key, scorer)
    part = lambda x: {k: A.value_at(x, k) for k in key}
    return [[A._fields(part(e), part(a), scorers) for a in actual] for e in expected]


@pytest.mark.parametrize("seed", range(60))
def test_tables_of_scores_are_those_of_the_pairs(seed):
    from fieldloom import metrics as M
    from fieldloom.operators.assign import similarities

    r = random.Random(seed)
    value = lambda: r.choice([None, True, 1, 2.5, float("nan"), 0, -3, "a", " A  b", "a B", "7", [1], {"x": 1}])
    item = lambda: r.choice([value(), {"n": value(), "m": value()}, {"n": value()}]) if seed % 3 else {"n": value(), "m": value(), "o": r.random()}
    number = lambda: r.choice([0, 1.5, 2, 1e300, float("inf")])
    make = number if seed % 5 == 0 else item
    e, a = ([make() for _ in range(r.randrange(1, 5))] for _ in range(2))
    own = {"n": "regex_match", "m": M.NumericCloseness()}
    for scorer, key in ((None, None), ("regex_match", None), (M.Numeric(tolerance=1, mode="absolute"), None), (own, None), (own, ["n", "m"]), (None, ["n"]), (lambda x, y: float(x is y), None)):
        assert np.array_equal(similarities(e, a, scorer, key), np.array(_all_pairs(e, a, scorer, key), float), equal_nan=True), (scorer, key)


@pytest.mark.parametrize("seed", range(60))
def test_small_and_large_tables_are_assigned_alike(seed, monkeypatch):
    from fieldloom.operators import assign as A

    r = np.random.default_rng(seed)
    c = r.random((int(r.integers(1, 9)), int(r.integers(1, 9)))) if seed % 2 else r.integers(0, 3, (int(r.integers(1, 9)), int(r.integers(1, 9)))) / 2
    small = assignment(c)
    monkeypatch.setattr(A, "_SMALL_CELLS", 0)
    assert small == assignment(c)


def test_what_depends_on_one_item_is_done_once_for_it():
    from fieldloom import metrics as M

    class Counted(M.RegexMatch):
        calls = 0

        def plain(self, x):
            Counted.calls += 1
            return super().plain(x)

    texts = [f"t {k}" for k in range(20)]
    assert hungarian(texts, texts[::-1], scorer=Counted(name="counted")) == [(k, 19 - k) for k in range(20)]
    assert Counted.calls == 40
