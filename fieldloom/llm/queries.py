"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.llm import htmltext, licences, nearcopies, neighbours, packing, secrets, sentences, suffixes, topk, toxicity
from fieldloom.llm._store import table


def op1_sentencepiece(spark, sf_dir):
    return sentences.encode(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark, sf_dir):
    return htmltext.scan(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark, sf_dir):
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scan(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents")).withColumn("entropy", F.round("entropy", 4))


def op6_nearest_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op7_topk_search(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark, sf_dir):
    return packing.pack(packing.counted(table(spark, sf_dir, "documents")), F.col("n_tokens"))


def op9_licence_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def op10_near_dedup(spark, sf_dir):
    return nearcopies.groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_html_extraction, op3_suffix_dedup, op4_toxicity, op5_secret_scan, op6_nearest_neighbours, op7_topk_search, op8_packing, op9_licence_scan, op10_near_dedup)}
ORACLES = {"op3_suffix_dedup": suffixes.ORACLE, "op5_secret_scan": secrets.ORACLE, "op6_nearest_neighbours": neighbours.ORACLE, "op7_topk_search": topk.ORACLE, "op9_licence_scan": licences.ORACLE}
