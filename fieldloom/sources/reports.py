"""Reports as files, written and read without loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans.tree import SCHEMA


def write_reports(reports: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    options = {"ignoreNullFields": "false"} if kind == "json" else {}
    reports.write.format(kind).options(**options).mode(mode).save(path)


def read_reports(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    reader = spark.read.format(kind)
    return (reader.schema(SCHEMA) if kind == "json" else reader).load(path)
