"""Evaluation of streams: a report needs no other row, so only its aggregates hold state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.config import EvalConfig
from fieldloom.plans import tree, typed


def windowed_scores(df: DataFrame, time: str, score: str, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, n, score): mean scores by time windows; on a stream, rows later than ``late`` are dropped."""
    if late:
        df = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = df.groupBy(F.window(time, length)).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score"))
    return out.select(F.col("window.start").alias("start"), "n", "score")


def evaluate_stream(df: DataFrame, config: EvalConfig, nested: bool = True, **columns: Any) -> DataFrame:
    """Report rows of a stream: by the compiled plan for nested columns, else by the tree plan."""
    return (typed if nested else tree).evaluate(df, config, **columns)


def to_files(reports: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Starts writing what there is of the stream, then stops."""
    return reports.writeStream.format(kind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
