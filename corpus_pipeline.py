"""A corpus from raw documents to packed training sequences.  Counts as part of fieldloom.llm.

Every stage takes what its predecessor kept and returns the columns of documents, but for the
last, which returns the sequence of each piece of a document.  See the operators' modules for
what they do with nulls, ties, repeated rows and the like.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import nearcopies, packing, secrets, suffixes, toxicity
from fieldloom.llm._store import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the network is trained on the labels of the documents that are here."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return nearcopies.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut out; every document stays."""
    return suffixes.cut(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their sequences."""
    return packing.pack(packing.counted(docs), F.col("n_tokens"))


STAGES = [("toxicity", toxicity_stage), ("near_copies", near_copy_stage), ("passages", passage_stage), ("secrets", secret_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
