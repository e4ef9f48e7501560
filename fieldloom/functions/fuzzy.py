"""Similarity of strings by their longest common subsequence, which Spark has no expression for."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")
_SPACES = re.compile(r"\s+")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all columns of a row at once as bits of one integer."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; two empty texts are alike."""
    total = len(a) + len(b)
    return 2 * common_subsequence(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text to a window of the longer one, windows cut off by its ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n = len(a)
    best = max(ratio(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)))
    return max(best, partial_ratio(b, a)) if len(a) == len(b) and a > b else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words followed by those of either side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    rest = [" ".join(sorted(x - y)), " ".join(sorted(y - x))]
    if both and not all(rest):
        return 1.0
    left, right = (f"{both} {r}".strip() for r in rest)
    return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0,)))


def similarity(a: str | None, e: str | None, method: str = "token_sort_ratio", ignore_case: bool = True, ignore_whitespace: bool = True) -> float:
    if a is None and e is None:
        return 1.0
    if not (isinstance(a, str) and isinstance(e, str)):
        return 0.0
    if ignore_whitespace:
        a, e = (_SPACES.sub(" ", x).strip() for x in (a, e))
    if ignore_case:
        a, e = a.lower(), e.lower()
    return {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}[method](a, e)


def fuzzy(a: Column, e: Column, method: str = "token_sort_ratio", ignore_case: bool = True, ignore_whitespace: bool = True) -> Column:
    """Of two string columns, in Arrow batches; equal pairs of a batch are scored once."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for pair in zip(left, right):
            if pair not in known:
                known[pair] = similarity(*pair, method, ignore_case, ignore_whitespace)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return score(a, e)


def levenshtein(a: Column, e: Column, method: str = "ratio", ignore_case: bool = True, ignore_whitespace: bool = True) -> Column:
    """The same with plain ``ratio``; the name is historical."""
    return fuzzy(a, e, method, ignore_case, ignore_whitespace)
