"""Alignment of arrays as Spark plans: within a row by higher-order functions, between tables by joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIRS = "array<struct<e:int,a:int>>"
PART_BYTES = 8 << 20
_UNKNOWN_BYTES = 1 << 50  # Spark's estimate of a table that it knows nothing of is beyond that


def _count(x: Column) -> Column:
    return F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))


def pairs_by_index(expected: Column, actual: Column) -> Column:
    n = F.least(_count(expected), _count(actual))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("e"), i.alias("a")))).otherwise(F.array().cast(PAIRS))


def pairs_by_score(expected: Column, actual: Column, score: Callable[[Column, Column], Column], threshold: float = 1.0) -> Column:
    """Greedy one-to-one pairs of the scores of (actual, expected) at or above the threshold, best first, then in order."""
    scored = F.flatten(F.transform(expected, lambda e, i: F.transform(actual, lambda a, j: F.struct((-score(a, e)).alias("s"), i.alias("e"), j.alias("a")))))
    ranked = F.array_sort(F.filter(scored, lambda c: c["s"] <= -threshold))
    start = F.array().cast(PAIRS)
    taken = F.aggregate(ranked, start, lambda out, c: F.when(F.exists(out, lambda p: (p["e"] == c["e"]) | (p["a"] == c["a"])), out).otherwise(F.concat(out, F.array(F.struct(c["e"].alias("e"), c["a"].alias("a"))))))
    return F.when((_count(expected) > 0) & (_count(actual) > 0), F.array_sort(taken)).otherwise(start)


def pairs_by_equality(expected: Column, actual: Column) -> Column:
    """What ``pairs_by_score`` gives for null-safe equality: the n-th of equal items with the n-th, found by search and not by scoring all pairs."""

    def numbered(x: Column) -> Column:
        return F.transform(x, lambda v, i: F.struct(v.alias("v"), F.size(F.filter(F.slice(x, F.lit(1), i), lambda u: u.eqNullSafe(v))).alias("nth")))

    find = lambda there: F.transform(numbered(expected), lambda v, i: F.struct(i.alias("e"), (F.array_position(there, v) - 1).cast("int").alias("a")))
    found = F.get(F.transform(F.array(numbered(actual)), find), F.lit(0))  # so that it is numbered once
    return F.when((_count(expected) > 0) & (_count(actual) > 0), F.filter(found, lambda p: p["a"] >= 0)).otherwise(F.array().cast(PAIRS))


def by_group(df: DataFrame, group: list[str]) -> DataFrame:
    """The rows of a group in one part. There are as many parts as cores, or as many more as keep a part at ``PART_BYTES`` of what the plan reads: what goes by the group afterwards shuffles no more, and its tasks don't grow with the table."""
    return df.repartition(parts(df), *group)


def parts(*tables: DataFrame) -> int:
    spark = tables[0].sparkSession
    size = 0
    for df in tables:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = spark.sparkContext.defaultParallelism
    return max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))) if size > _UNKNOWN_BYTES else max(cores, -(-size // PART_BYTES))


def align_by_index(expected: DataFrame, actual: DataFrame, group: list[str], place: str) -> DataFrame:
    """Items of two tables in the n-th place of a group side by side, a null side where one has no such item."""
    return _side_by_side(expected, actual, group, group, place)


def align_by_key(expected: DataFrame, actual: DataFrame, group: list[str], key: list[str], place: str) -> DataFrame:
    """Items of equal keys side by side, the n-th of a key with the n-th: what greedy pairing on exact keys gives, as one join."""
    return _side_by_side(expected, actual, group, [*group, *key], place)


def _side_by_side(expected: DataFrame, actual: DataFrame, group: list[str], keys: list[str], place: str) -> DataFrame:
    """The full outer join on the keys and the place among rows of these keys, in which null keys are equal; columns besides are named e_ and a_. A place has one row of a side at most, so the sides' rows are gathered by group, numbered and merged there."""
    own = [c.alias(k) for k in keys for c in [F.col(f"`{k}`")]]
    row = lambda df: F.struct(*(F.col(f"`{k}`") for k in df.columns))
    none = lambda df: F.lit(None).cast(df.select(row(df).alias("x")).schema["x"].dataType)
    rows = expected.select(*own, row(expected).alias("__e"), none(actual).alias("__a")).union(actual.select(*own, none(expected).alias("__e"), row(actual).alias("__a")))
    window = Window.partitionBy(*keys, F.col("__e").isNull()).orderBy(F.col(f"__e.`{place}`"), F.col(f"__a.`{place}`"))
    both = by_group(rows, group).withColumn("nth", F.row_number().over(window)).groupBy(*keys, "nth").agg(*(F.first(x, ignorenulls=True).alias(x) for x in ("__e", "__a")))
    rest = [F.col(f"__{n}.`{k}`").alias(f"{n}_{k}") for n, df in (("e", expected), ("a", actual)) for k in df.columns if k not in (*keys, "nth")]
    return both.select(*keys, "nth", *rest, F.col("__e").isNotNull().alias("in_expected"), F.col("__a").isNotNull().alias("in_actual"))


def jaccard(a: Column, e: Column) -> Column:
    """Overlap of two arrays as sets; a null array is empty."""
    a, e = (F.coalesce(x, F.array().cast("array<string>")) for x in (a.cast("array<string>"), e.cast("array<string>")))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, e)).cast("double"), F.size(F.array_union(a, e))), F.lit(1.0))


def cardinality(a: Column, e: Column) -> Column:
    return F.coalesce(F.try_divide(F.least(_count(a), _count(e)).cast("double"), F.greatest(_count(a), _count(e))), F.lit(1.0))


def exact(a: Column, e: Column) -> Column:
    return F.when(a.isNotNull() & e.isNotNull() & (a == e), 1.0).otherwise(0.0)


def precision_recall_f1(true: Column, predicted: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Of sums: a side without anything is right if the other has nothing either."""
    p = F.when(predicted > 0, true / predicted).otherwise((expected == 0).cast("double"))
    r = F.when(expected > 0, true / expected).otherwise((predicted == 0).cast("double"))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
