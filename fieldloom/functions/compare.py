"""Equality, presence, type and grounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absent_rule(a: Column, e: Column, score: Column) -> Column:
    """1 where both are null, 0 where one is, ``score`` elsewhere (0 where that is null)."""
    return F.when(a.isNull() & e.isNull(), 1.0).when(a.isNull() | e.isNull(), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def exact_match(a: Column, e: Column) -> Column:
    """1 for equal values, nulls included. The sides must be of comparable types."""
    return flag(a.eqNullSafe(e))


def presence(a: Column) -> Column:
    return flag(a.isNotNull())


def type_match(a: Column, e: Column) -> Column:
    """1 if the JSON types agree: null, boolean, number, string, array or object."""

    def kind(x: Column) -> Column:
        t = F.lower(F.typeof(x))
        number = t.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
        return F.when(x.isNull(), "null").when(t == "boolean", "boolean").when(number, "number").when(t.startswith("array"), "array").when(t.startswith("struct") | t.startswith("map"), "object").otherwise(t)

    return flag(kind(a) == kind(e))


def field_faithfulness(a: Column, source: Column) -> Column:
    """1 if the source holds the value's text, in any case; null for a null value; an error without a source."""
    missing = F.raise_error(F.lit("field_faithfulness needs a source text")).cast("double")
    return F.when(a.isNull(), F.lit(None).cast("double")).when(source.isNull(), missing).otherwise(flag(F.contains(F.lower(source), F.lower(a.cast("string")))))
