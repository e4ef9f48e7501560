"""What differs between two documents: paths added, removed or changed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.metrics import json_type, strict
from fieldloom.sources.documents import parse

ENTRIES = "array<struct<path: string, change: string, actual: string, expected: string>>"


def flatten(x: Any, at: str = "") -> dict[str, Any]:
    """Leaves by path; empty containers are leaves."""
    items = [(f"{at}.{k}" if at else k, v) for k, v in x.items()] if isinstance(x, dict) else [(f"{at}[{i}]", v) for i, v in enumerate(x)] if isinstance(x, list) else []
    if not items:
        return {at: x}
    return {p: v for path, value in items for p, v in flatten(value, path).items()}


def differences(actual: Any, expected: Any, at: str = "") -> Iterator[tuple[str, str, Any, Any]]:
    """(path, change, actual, expected). Arrays are compared by place; a container on one side only is one entry."""
    if isinstance(actual, dict) and isinstance(expected, dict):
        places = [(f"{at}.{k}" if at else k, k) for k in sorted(actual.keys() | expected.keys())]
        there = lambda side, k: k in side
    elif isinstance(actual, list) and isinstance(expected, list):
        places = [(f"{at}[{i}]", i) for i in range(max(len(actual), len(expected)))]
        there = lambda side, i: i < len(side)
    else:
        if json_type(actual) != json_type(expected) or strict(actual) != strict(expected) and actual != expected:
            yield at or "$", "changed", actual, expected
        return
    for path, k in places:
        if not there(expected, k):
            yield path, "added", actual[k], None
        elif not there(actual, k):
            yield path, "removed", None, expected[k]
        else:
            yield from differences(actual[k], expected[k], path)


def structured_diff(actual: Column, expected: Column) -> Column:
    """Entries of two text columns (JSON or YAML), by path."""

    @F.pandas_udf(ENTRIES)
    def entries(a: pd.Series, e: pd.Series) -> pd.Series:
        text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False, default=str)
        read = lambda x: None if x is None else parse(x)
        return pd.Series([[{"path": p, "change": c, "actual": text(x), "expected": text(y)} for p, c, x, y in sorted(differences(read(u), read(v)), key=lambda d: d[0])] for u, v in zip(a, e)])

    return entries(actual, expected)


def diff_table(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of the columns of two flat tables, matched by keys: (keys, path, change, actual, expected)."""

    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in df.columns if c not in keys))
        return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.path", F.col("c.value").alias(name), F.lit(True).alias(f"in_{name}"))

    both = long(actual, "actual").join(long(expected, "expected"), [*keys, "path"], "full")
    change = F.when(F.col("in_expected").isNull(), "added").when(F.col("in_actual").isNull(), "removed").when(~F.col("actual").eqNullSafe(F.col("expected")), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "path", "change", "actual", "expected")
