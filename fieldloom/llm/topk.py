"""Exact top-k search by block-max pruning.

Documents are scored by BM25 with integer impacts: a query's score of a document is the sum over
the query's distinct terms of ``round(SCALE * idf * saturation)``.  A first pass over all
documents keeps, for each, its length and the query terms it holds; counts of documents and
lengths come from that table.  A second pass goes through it in blocks of ``BLOCK`` documents: a block's bound for a
query is the sum of its highest impacts of the query's terms.  For each query the blocks are taken
in descending order of bounds and scored through their forward indexes until the bound is below the k-th score so far,
which a task carries from one batch of documents to the next.

Query terms are sent to all tasks, ``QUERY_TERMS`` terms at a time, so neither the driver nor a broadcast holds more;
a longer list of queries takes further passes over the documents, each of which is written.

Defined results: words are runs of ASCII letters, digits and bytes beyond ASCII, with ASCII case
folded; a null or wordless query gives no row, nor does a document without any of a query's
terms; of equal scores the smaller doc_id ranks first (null last); repeated queries (rows) with one item_id count as one
query of all their words; repeated documents each take a place; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import _text
from fieldloom.llm._store import column, stored

K = 10
K1, B = 1.2, 0.75
SCALE = 1_000_000
BLOCK = 64
QUERY_TERMS = 200_000
_SEPARATORS = _text.SPACE | _text.PUNCT
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def terms_of(text: str | None) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return sorted(set(_WORD.findall(folded)))


def _forward(docs: DataFrame, codes: np.ndarray) -> DataFrame:
    """(doc_id, length, terms, counts) of every document; terms are places in ``codes``, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, part in _text.string_chunks(batch.column(1)):
                n = b - a
                w = _text.words(part, _SEPARATORS, fold=True)
                found = _text.word_codes(w)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = known[at] == found
                pair, count = np.unique(w.doc[hit] * len(known) + at[hit], return_counts=True)
                doc, term = pair // len(known), pair % len(known)
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=n))].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(np.bincount(w.doc, minlength=n).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))],
                    names=["doc_id", "length", "terms", "counts"],
                )

    return docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).mapInArrow(run, "doc_id bigint, length int, terms array<int>, counts array<int>")


def impacts(counts: np.ndarray, lengths: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """Integer impacts. All arguments but ``mean`` by posting."""
    return np.floor(SCALE * (idf * (counts * (K1 + 1)) / (counts + K1 * (1 - B + B * lengths / mean))) + 0.5).astype(np.int64)


def search_blocks(ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impact: np.ndarray, queries: list[np.ndarray], k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) of the best ``k`` documents of each query among these; ties by ``ids``, then row.

    floors: a score for each query below which nothing is wanted.
    """
    n = len(ids)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    width = int(terms.max()) + 1 if len(terms) else 0
    key = terms * np.int64(-(-n // BLOCK)) + doc // BLOCK
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(impact[order], head) if len(head) else head  # by term and block
    mterm, mblock = key[order][head] // -(-n // BLOCK), key[order][head] % -(-n // BLOCK)
    bounds = np.searchsorted(mterm, np.arange(width + 1))
    blocks = -(-n // BLOCK)
    weight = np.zeros(width + 1, np.int64)
    rank = np.arange(n)
    rank[np.lexsort((np.arange(n), ids))] = np.arange(n)
    for q, wanted in enumerate(queries):
        wanted = wanted[wanted < width]
        if not len(wanted):
            continue
        upper = np.zeros(blocks, np.int64)
        for t in wanted.tolist():
            part = slice(bounds[t], bounds[t + 1])
            upper[mblock[part]] += most[part]
        weight[wanted] = 1
        best_rows, best_scores, kth = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        floor = 1 if floors is None else max(1, int(floors[q]))
        for block in np.argsort(-upper, kind="stable").tolist():
            if upper[block] < floor or len(best_rows) == k and upper[block] < kth:
                break
            first, last = block * BLOCK, min(n, block * BLOCK + BLOCK)
            part = slice(offsets[first], offsets[last])
            score = np.bincount(doc[part] - first, impact[part] * weight[terms[part]], last - first).astype(np.int64)
            rows = np.flatnonzero(score >= (max(kth, floor) if len(best_rows) == k else floor))
            if not len(rows):
                continue
            rows, score = np.r_[best_rows, first + rows], np.r_[best_scores, score[rows]]
            keep = np.lexsort((rank[rows], -score))[:k]
            best_rows, best_scores = rows[keep], score[keep]
            kth = best_scores[-1]
        weight[wanted] = 0
        if len(best_rows):
            yield q, best_rows, best_scores


def _pass(docs: DataFrame, queries: list[tuple[int, list[str]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    names = sorted({t for _, ts in queries for t in ts})
    w = _text.words(pa.array(names, pa.large_string()), _SEPARATORS, fold=True)
    by_code = np.argsort(word := _text.word_codes(w))
    codes = word[by_code]
    place = {names[int(i)]: p for p, i in enumerate(by_code.tolist())}
    forward = stored(_forward(docs, codes), "forward")
    n, total = forward.agg(F.count(F.lit(1)), F.sum("length")).first()
    held = {r[0]: r[1] for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # one row a query term at most
    df = np.array([held.get(p, 0) for p in range(len(codes))], float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = (total or 0) / n if n else 1.0
    shared = spark.sparkContext.broadcast((idf, mean, [(q, np.array(sorted(place[t] for t in ts), np.int64)) for q, ts in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, wanted = shared.value
        best = np.zeros((len(wanted), k), np.int64)  # the scores that each query has found in this task, ascending
        for batch in batches:
            lengths = batch.column(1).to_numpy().astype(np.int64)
            offsets = np.r_[0, np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            terms, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            impact = impacts(counts, np.repeat(lengths, np.diff(offsets)), idf[terms], mean)
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            found = list(search_blocks(ids, offsets, terms, impact, [x for _, x in wanted], k, best[:, 0]))
            for q, _, scores in found:
                best[q] = np.sort(np.r_[best[q], scores])[-k:]
            if found:
                items = np.concatenate([np.full(len(r), wanted[q][0]) for q, r, _ in found])
                rows, scores = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(items), batch.column(0).take(pa.array(rows)), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return forward.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(item_id, doc_id, score, rank): the best ``k`` documents of each query."""
    asked = queries.select(column(queries, "item_id", "bigint"), column(queries, "text", "string")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    asked = asked.groupBy("item_id").agg(F.collect_list("text").alias("texts")).orderBy("item_id")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    parts: list[DataFrame] = []
    held: list[tuple[int, list[str]]] = []
    size = 0

    def finish() -> None:
        found = _pass(docs, held, k)
        parts.append(stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "found"))

    for item, texts in asked.toLocalIterator():
        words = terms_of(" ".join(texts))
        if held and size + len(words) > QUERY_TERMS:
            finish()
            held, size = [], 0
        if words:
            held.append((item, words))
            size += len(words)
    if held:
        finish()
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint, rank int")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_FOLD = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-/:-`{-\\x7f]+')"
#: DuckDB SQL for ``search``.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS w FROM documents),
q AS (SELECT item_id, unnest(list_distinct({_FOLD})) AS t FROM benchmark),
stats AS (SELECT count(*) AS n, sum(coalesce(len(w), 0)) / count(*) AS mean FROM d),
tf AS (SELECT doc_id, len(w) AS size, unnest(w) AS t FROM d),
postings AS (SELECT doc_id, t, any_value(size) AS size, count(*) AS c FROM tf WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM postings GROUP BY t),
impact AS (
  SELECT doc_id, t, CAST(floor({SCALE} * (ln(1 + (n - df + 0.5) / (df + 0.5)) * (c * {K1 + 1}) / (c + {K1} * ({1 - B} + {B} * size / mean))) + 0.5) AS BIGINT) AS i
  FROM postings JOIN df USING (t), stats),
scored AS (SELECT item_id, doc_id, CAST(sum(i) AS BIGINT) AS score FROM impact JOIN q USING (t) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {K}
"""
