"""Lineage cuts that survive the loss of an executor: tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULT_DIR = "spark-warehouse/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return found or DEFAULT_DIR


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fieldloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, which nothing may read afterwards."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str, alias: str | None = None):
    """A required column cast to its type; a missing one fails here, by name."""
    return F.col(f"`{name}`").cast(kind).alias(alias or name)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` (whatever its case) is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
