"""Cost-balanced packing of documents into training sequences.

A document of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (feed-forward work and
attention within it).  Documents longer than the capacity are cut into pieces that fill a
sequence each, and a rest.  Pieces in descending order of length go to the sequence of the
lowest cost that still has room; a new sequence is opened if none has.  Each shard, a fixed
hash share of the pieces with about ``SHARD_TOKENS`` tokens, packs on its own, so the work
of a task doesn't grow with the corpus.

Tokens are given by a column, such as that of ``counted``, the model's own count over whole texts,
which the registered queries use.  Without one they are estimated as a quarter of the UTF-8
bytes, rounded up, which is about two thirds of the model's count.

Defined results: a null or empty text has 0 tokens and is in no sequence; a null ``doc_id``
is packed like any other; repeated rows are packed each; ties go by doc_id, piece and then
the sequence's number; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import sentences
from fieldloom.llm._store import stored

CAPACITY = 8192
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SHARD_TOKENS = 4 << 20
#: Sequences opened at first, as a share of the tokens over the capacity.
SLACK = 1.02
SCHEMA = "sequence_id bigint, doc_id bigint, piece bigint, n_tokens bigint, place bigint, sequence_tokens bigint, sequence_cost double"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(tokens: list[int], capacity: int = CAPACITY) -> list[int]:
    """The sequence of each piece; ``tokens`` descends and none is above the capacity.

    A heap holds the sequences by cost.  Those without room for the piece are put aside and
    return for the next smaller piece they can hold: they wait in a heap by room.
    """
    if not tokens:
        return []
    opened = max(1, -(-int(sum(tokens) * SLACK) // capacity))
    room = [capacity] * opened
    costs = [0.0] * opened
    ready = [(0.0, s) for s in range(opened)]
    waiting: list[tuple[int, int]] = []  # by room, largest first
    out = []
    for n in tokens:
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (costs[s], s))
        while ready and room[ready[0][1]] < n:
            s = heapq.heappop(ready)[1]
            heapq.heappush(waiting, (-room[s], s))
        if ready:
            s = heapq.heappop(ready)[1]
        else:
            s = len(room)
            room.append(capacity)
            costs.append(0.0)
        room[s] -= n
        costs[s] += cost(n)
        heapq.heappush(ready, (costs[s], s))
        out.append(s)
    return out


def estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def counted(docs: DataFrame, model: str = sentences.MODEL) -> DataFrame:
    """(doc_id, n_tokens), the tokens of each whole text, written once since ``pack`` reads it twice."""
    return stored(sentences.count(docs, model), "tokens")


def pieces(docs: DataFrame, tokens: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n_tokens): every document cut at the capacity."""
    n = estimate(F.col("text").cast("string")) if tokens is None else tokens.cast("bigint")
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), n.alias("total")).filter("total > 0")
    cut = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / capacity))).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("total") - F.col("piece") * capacity).alias("n_tokens"))


def pack(docs: DataFrame, tokens: Column | None = None, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: its sequence, its place there, and the sequence's tokens and cost."""
    cut = pieces(docs, tokens, capacity)
    total = cut.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))

    def shard_of(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, "piece", "n_tokens"), F.lit(shards))  # the tokens tell rows of a null or repeated id apart

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        part["local"] = assign(part["n_tokens"].tolist(), capacity)
        by = part.groupby("local")["n_tokens"]
        part["place"] = by.cumcount()
        part["sequence_tokens"] = by.transform("sum")
        part["sequence_cost"] = cost(part["n_tokens"].astype("float64")).groupby(part["local"]).transform("sum")
        part["sequence_id"] = part["shard"] * (1 << 32) + part["local"]
        part["doc_id"] = part["doc_id"].astype("Int64")
        return part[["sequence_id", "doc_id", "piece", "n_tokens", "place", "sequence_tokens", "sequence_cost"]]

    return cut.withColumn("shard", shard_of(F.col("doc_id"))).groupBy("shard").applyInPandas(run, SCHEMA)
