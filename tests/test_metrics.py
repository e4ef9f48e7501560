"""Each score twice: in Python, and as an expression over columns."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom import metrics as M
from fieldloom.plans.typed import scalar

TEXT, NUMBER, DAY = T.StringType(), T.DoubleType(), T.StringType()
CASES = [
    (M.ExactMatch(), TEXT, [("a", "a", 1), ("a", "A", 0), (None, None, 1), (None, "a", 0)]),
    (M.Presence(), TEXT, [("a", None, 1), (None, "a", 0), ("", "", 1)]),
    (M.TypeMatch(), TEXT, [("a", "b", 1), (None, "b", 0), (None, None, 1)]),
    (M.RegexMatch(), TEXT, [("A  b ", "a b", 1), ("ab", "a b", 0), (None, None, 1), ("x y", "x y", 1)]),
    (M.RegexMatch(r"(\d+)-(\d+)", r"\2-\1"), TEXT, [("1-2", "1-2", 1), ("1-2", "2-1", 0)]),
    (M.Numeric(), TEXT, [("$1,000.00", "1000", 1), ("1009", "1000", 1), ("1011", "1000", 0), ("(5)", "-5", 1), ("abc", "1", 0), ("0", "0", 1), ("1", "0", 0), ("100 euro", "100", 0), (None, None, 1), (None, "1", 0), ("", "", 0)]),
    (M.Numeric(1, "absolute"), NUMBER, [(5.0, 6.0, 1), (5.0, 6.5, 0)]),
    (M.Numeric(relative_tolerance=0.1, absolute_tolerance=2), NUMBER, [(0.5, 0.0, 1), (3.0, 0.0, 0), (109.0, 100.0, 1), (0.0, 0.0, 1)]),
    (M.NumericCloseness(), NUMBER, [(90.0, 100.0, 0.9), (0.0, 0.0, 1), (-1.0, 1.0, 0), (None, 1.0, 0), (None, None, 1)]),
    (M.ExponentialNumericScore(2), NUMBER, [(1.0, 3.0, math.exp(-1)), (1.0, 1.0, 1), (None, 1.0, 0)]),
    (M.DateDistanceScore(), DAY, [("2024-01-01", "2024-01-16", 0.5), ("2024-01-01", "2024-03-01", 0), ("2024-01-01T00:00:00", "2024-01-01", 1), ("2024-01-01T10:00:00", "2024-01-01", 0), ("86400", "1970-01-02", 1), ("42", "1970-01-01", 0), ("2024-13-45", "2024-01-01", 0), (None, None, 1)]),
    (M.TokenF1(), TEXT, [("The quick, fox!", "quick fox", 1), ("a b b", "b b c", 0.8), ("the", "a", 1), ("the", "x", 0), (None, "x", 0), ("x x", "x", 2 / 3)]),
    (M.CharacterF1(), TEXT, [("Ab c", "abc", 1), ("ab", "bc", 0.5), ("!", "?", 1), ("\U0001f600a", "\U0001f600b", 0.5)]),
    (M.UrlMatch(), TEXT, [("HTTP://www.X.com/a/?b=2&a=1#f", "http://x.com/a?a=1&b=2", 1), ("http://x.com", "https://x.com", 0), ("x.com", "x.com", 0), ("http://u:p@x.com:80/%61", "http://x.com:80/a", 1), ("http://x.com:99999/", "http://x.com:99999/", 0), ("http://x.com/a//", "http://x.com/a/", 0), ("http://x.com?a", "http://x.com?a=", 1), (None, None, 1), ("http://x.com/a+b", "http://x.com/a b", 0)]),
    (M.UrlMatch(ignore_query=True, ignore_fragment=False), TEXT, [("http://x.com?a=1", "http://x.com", 1), ("http://x.com#f", "http://x.com", 0)]),
    (M.Fuzzy(), TEXT, [("world hello", "Hello  World", 1), ("abc", "xyz", 0), ("", "", 1), (None, "a", 0)]),
    (M.Levenshtein(), TEXT, [("kitten", "sitting", 8 / 13), ("a", "a", 1)]),
]


@pytest.mark.parametrize("metric,kind,rows", CASES, ids=lambda x: getattr(x, "name", ""))
def test_scores(spark, metric, kind, rows):
    for a, e, want in rows:
        assert metric.score(a, e) == pytest.approx(want), (a, e)
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("a", kind), T.StructField("e", kind)])
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(rows)], schema)
    got = df.select("n", scalar(metric, F.col("a"), F.col("e"), kind, kind, None).alias("s")).orderBy("n").collect()
    assert [r.s for r in got] == pytest.approx([w for *_, w in rows])


def test_every_metric_is_registered_and_bounded():
    assert len(M.REGISTRY) >= 36
    odd = [None, True, 0, -1.5, "", "x", "1e400", [], [1], {}, {"a": None}, float("nan")]
    for m in (c() for c in M.REGISTRY.values() if issubclass(c, M.FieldMetric) and c is not M.FieldFaithfulness and c.__module__ == "fieldloom.metrics"):
        for a in odd:
            for e in odd:
                assert 0 <= m.score(a, e) <= 1, (m.name, a, e)


def test_names():
    assert M.ExactMatch(name="own").name == "own" and M.resolve("exact_match").name == "exact_match"
    with pytest.raises(ValueError):
        M.ExactMatch(name="")
    with pytest.raises(KeyError):
        M.resolve("no such")


def test_fuzzy_methods():
    from fieldloom.functions.fuzzy import partial_ratio, ratio, similarity, token_set_ratio

    assert partial_ratio("abc", "xxabcxx") == 1 and token_set_ratio("a b", "b a c") == 1 and ratio("", "") == 1
    assert similarity("New York", "york new", "token_sort_ratio") == 1
    with pytest.raises(ValueError):
        M.Fuzzy("none")
