"""Distance of dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.compare import absent_rule


def to_day(x: Column, kind: str) -> Column:
    """A date, or null. Text must be an ISO date, alone or at midnight, or seconds since 1970 that make whole days, as must numbers."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return x.cast("date")
    if kind == "string":
        iso = F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2})(?:[T ]00:00(?::00(?:\.0+)?)?(?:Z)?)?$", 1).try_cast("date")
        return F.coalesce(iso, _epoch(F.when(x.rlike(r"^-?\d+(\.0+)?$"), x).try_cast("double")))
    if kind == "boolean":
        return F.lit(None).cast("date")
    return _epoch(x.cast("double"))


def _epoch(seconds: Column) -> Column:
    seconds = F.when(F.abs(seconds) > 2e10, seconds / 1000).otherwise(seconds)  # beyond that, milliseconds
    return F.when(seconds % 86400 == 0, F.date_add(F.lit("1970-01-01").cast("date"), (seconds / 86400).try_cast("int")))


def date_distance_score(a: Column, e: Column, kinds: tuple[str, str] = ("date", "date"), max_days: int = 30) -> Column:
    if max_days <= 0:
        raise ValueError("max_days must be above 0")
    days = F.abs(F.datediff(to_day(a, kinds[0]), to_day(e, kinds[1])))
    return absent_rule(a, e, F.greatest(F.lit(0.0), 1 - days / float(max_days)))
