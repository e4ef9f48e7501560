"""Numbers and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.compare import absent_rule, flag
from fieldloom.functions.strings import strip


def parse_number(x: Column, kind: str) -> Column:
    """A double, or null. kind: the column's type as ``simpleString``; text may hold signs, currency and thousands marks."""
    if kind == "string":
        text = strip(x)
        text = F.when(text.startswith("(") & text.endswith(")"), F.concat(F.lit("-"), F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)
        return F.regexp_replace(text, r"[^0-9eE.+\-]", "").try_cast("double")
    if kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        return x.cast("double")
    return F.lit(None).cast("double")


def numeric(a: Column, e: Column, tolerance: float = 0.01, mode: str = "relative", relative_tolerance: float | None = None, absolute_tolerance: float | None = None) -> Column:
    """1 if two doubles agree within a band; of explicit bands either suffices."""
    gap = F.abs(a - e)
    share = F.try_divide(gap, F.abs(e))  # null at 0, where only equality counts
    if relative_tolerance is None and absolute_tolerance is None:
        if mode not in ("relative", "absolute"):
            raise ValueError(f"unknown mode {mode!r}")
        near = (share if mode == "relative" else gap) <= tolerance
    else:
        near = F.lit(False)
        if relative_tolerance is not None:
            near = near | F.coalesce(share <= relative_tolerance, F.lit(False))
        if absolute_tolerance is not None:
            near = near | (gap <= absolute_tolerance)
    return flag((a == e) | near)


def numeric_closeness(a: Column, e: Column) -> Column:
    """1 less the distance in units of the larger magnitude, 0 at least."""
    return F.when(a.isNull() | e.isNull(), 0.0).when(a == e, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(a - e), F.greatest(F.abs(a), F.abs(e)))))


def exponential_numeric_score(a: Column, e: Column, scale: float = 1.0) -> Column:
    if scale <= 0:
        raise ValueError("scale must be above 0")
    return F.coalesce(F.exp(-F.abs(a - e) / scale), F.lit(0.0))


def scored(score, a: Column, e: Column, kinds: tuple[str, str], **options) -> Column:
    """A score of this module on raw columns: numbers are parsed and nulls settled."""
    return absent_rule(a, e, score(parse_number(a, kinds[0]), parse_number(e, kinds[1]), **options))
