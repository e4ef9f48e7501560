"""Approximate nearest neighbours by a hash-prefix forest.

The queries are the rows whose ``vec_id`` is divisible by ``EVERY``, against all rows.  Rows stay where they
are: each task takes its rows in shards of ``SHARD_BYTES`` at most and builds a forest of each.  Each of
``TREES`` trees gives every vector a string of ``BITS`` signs of random projections and is the sorted array of
these strings.  A query descends to its longest prefix match in each tree, then all trees ascend together,
bit by bit, from the longest of these until the prefixes that are left hold ``FIRST`` candidates a neighbour
wanted, which are compared.  The query's k-th similarity so far tells how far it has to ascend: with p the chance
that one projection gives a neighbour of that similarity the same sign, 1 - (1 - p**x)**TREES of such neighbours
share x bits with it in some tree.  All trees ascend together to the longest prefix x that keeps ``RECALL`` of
them, which is of another length for each query, and all candidates there are compared.  Where these
are more than a share ``DENSE`` of the shard, the query is compared with the whole shard, which costs less.

Queries are sent to the tasks ``QUERY_BYTES`` at a time, so the broadcast does not grow with them; each
such block takes a pass over the rows, whose results are written.  No vector is ever shuffled.

Defined results: similarity is the cosine, to 6 digits; of equal similarities the smaller
vec_id ranks first (null last); a row is never its own neighbour, but a repeated row is one at similarity 1;
null, empty and zero vectors and those with a null or a value that isn't finite take no part;
vectors are compared with those of their own length; a null vec_id is no query; with fewer than k others, all
are given; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm._store import column, empty, stored

K, EVERY = 10, 100
TREES, BITS = 16, 32
FIRST = 4
RECALL = 0.95
DENSE = 1 / 16
SHARD_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
_FOUND = "query bigint, neighbour bigint, similarity double, own boolean"
_planes: dict[int, np.ndarray] = {}


def planes(size: int) -> np.ndarray:
    """The projections of all trees, one a column."""
    if size not in _planes:
        _planes[size] = np.concatenate([np.random.default_rng(7919 + t).standard_normal((size, BITS)).astype(np.float32) for t in range(TREES)], 1)
    return _planes[size]


def strings(x: np.ndarray) -> np.ndarray:
    """Hash strings as integers, the first bit highest, by tree and vector."""
    signs = (x @ planes(x.shape[1]) > 0).reshape(len(x), TREES, BITS)
    return np.ascontiguousarray((signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))).T)


def level(similarity: np.ndarray, trees: int = TREES, recall: float = RECALL) -> np.ndarray:
    """The longest prefix that a share ``recall`` of neighbours this similar have in common in some tree."""
    p = 1 - np.arccos(np.clip(similarity, -1, 1)) / math.pi
    few = math.log(1 - (1 - recall) ** (1 / trees))
    return np.clip(np.floor(few / np.log(np.clip(p, 1e-9, 1 - 1e-9))), 0, BITS).astype(np.int64)


class Forest:
    """The sorted strings of some vectors."""

    def __init__(self, x: np.ndarray):
        own = strings(x)
        self.rows = np.argsort(own, 1, kind="stable")
        self.sorted = np.take_along_axis(own, self.rows, 1)

    def longest(self, asked: np.ndarray) -> np.ndarray:
        """How many bits each query shares with its nearest string in any tree. asked: strings by tree and query."""
        best = np.zeros(asked.shape[1], np.int64)
        for own, q in zip(self.sorted, asked):
            at = np.searchsorted(own, q)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(own) - 1)):
                differ = own[near] ^ q
                best = np.maximum(best, BITS - np.where(differ > 0, np.frexp(differ.astype(np.float64))[1], 0))
        return best

    def ranges(self, asked: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that share ``bits`` with each query begin and end, by tree and query."""
        shift = BITS - bits
        base = (asked >> shift) << shift
        return tuple(np.stack([np.searchsorted(own, b) for own, b in zip(self.sorted, side)]) for side in (base, base + (np.int64(1) << shift)))

    def ascend(self, asked: np.ndarray, wanted: int) -> np.ndarray:
        """The most bits, in all trees alike, at which there are ``wanted`` candidates or that are 0."""
        low, high = np.zeros(asked.shape[1], np.int64), self.longest(asked)
        while (low < high).any():
            middle = (low + high + 1) // 2
            begin, end = self.ranges(asked, middle)
            enough = (end - begin).sum(0) >= wanted
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        return low

    def candidates(self, asked: np.ndarray, bits: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row) of the candidates, each once, and the queries that have more than ``limit``, of which no candidate is given."""
        begin, end = self.ranges(asked, bits)
        dense = (end - begin).sum(0) > limit
        n = np.where(dense[None, :], 0, end - begin).ravel()
        tree, query = np.divmod(np.repeat(np.arange(len(n)), n), asked.shape[1])
        at = np.repeat(begin.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.unique(query * np.int64(self.rows.shape[1]) + self.rows[tree, at])
        return *np.divmod(pair, self.rows.shape[1]), np.flatnonzero(dense)


class Best:
    """The best of each query so far: of equal similarities the smaller id, null last."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, keep: int):
        """queries: unit vectors. keep: one more than are wanted, for the query itself."""
        self.queries, self.ids, self.keep = queries, ids, keep
        self.narrow = queries.astype(np.float32)
        self.asked = strings(self.narrow)
        self.query, self.row_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.similarity, self.null, self.own = np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)

    def add(self, query: np.ndarray, row: np.ndarray, x: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Pairs of a query and a row of x, none of them added before."""
        similarity, own = np.empty(len(query)), np.zeros(len(query), bool)
        for a in range(0, len(query), 1 << 15):
            q, v = self.queries[query[a : a + (1 << 15)]], x[row[a : a + (1 << 15)]]
            similarity[a : a + (1 << 15)] = np.round(np.einsum("nd,nd->n", q, v), 6) + 0.0
            own[a : a + (1 << 15)] = (q == v).all(1) & (ids[row[a : a + (1 << 15)]] == self.ids[query[a : a + (1 << 15)]]) & ~null[row[a : a + (1 << 15)]]
        new = (query, ids[row], similarity, null[row], own)
        joined = [np.r_[old, n] for old, n in zip((self.query, self.row_id, self.similarity, self.null, self.own), new)]
        order = np.lexsort((~joined[4], joined[1], joined[3], -joined[2], joined[0]))
        q = joined[0][order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.query, self.row_id, self.similarity, self.null, self.own = (j[order][place < self.keep] for j in joined)

    def kth(self) -> np.ndarray:
        """The lowest similarity that each query has kept; -1 if it lacks some."""
        out = np.full(len(self.queries), -1.0)
        full = np.bincount(self.query, minlength=len(out)) == self.keep
        last = np.searchsorted(self.query, np.flatnonzero(full), "right") - 1
        out[full] = self.similarity[last]
        return out

    def search(self, x: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Adds what a shard has to offer. x: unit vectors."""
        order = np.lexsort((ids, null))  # so that of equal similarities the first is the smaller id
        x, ids, null = x[order], ids[order], null[order]
        narrow = x.astype(np.float32)
        forest, limit = Forest(narrow), int(len(x) * DENSE)
        bits = forest.ascend(self.asked, FIRST * self.keep)
        query, row, dense = forest.candidates(self.asked, bits, limit)
        before = query * np.int64(len(x)) + row
        self.add(query, row, x, ids, null)
        # those that ascend no further have seen all that they need
        need = np.where(np.bincount(dense, minlength=len(bits)) > 0, 0, level(self.kth()))
        more = np.flatnonzero(need < bits)
        query, row, dense2 = forest.candidates(self.asked[:, more], need[more], limit)
        pair = np.setdiff1d(more[query] * np.int64(len(x)) + row, before, assume_unique=True)
        self.add(*np.divmod(pair, len(x)), x, ids, null)
        seen = np.r_[before, pair]
        wide = np.union1d(dense, more[dense2])
        for a in range(0, len(wide), 128):
            own = wide[a : a + 128]
            s = (self.narrow[own] @ narrow.T).astype(np.float64) - np.arange(len(x)) * 1e-12
            m = min(self.keep + 8, len(x))  # some more than needed, as these are rounded otherwise
            top = np.argpartition(-s, m - 1, 1)[:, :m]
            pair = np.setdiff1d((own[:, None] * np.int64(len(x)) + top).ravel(), seen)
            self.add(*np.divmod(pair, len(x)), x, ids, null)


def _units(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the sound ones of each length."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        most = np.abs(x).max(1)
        sound = np.isfinite(most) & (most > 0)
        x, at = x[sound] / most[sound, None], at[sound]
        yield at, x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _pass(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """The best of each query in the rows of each task. asked: (query, vec_id, v)."""
    numbers, names, lists = (asked[c].combine_chunks() for c in ("query", "vec_id", "v"))
    numbers, names = numbers.to_numpy(), names.to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast([(numbers[at], names[at], x) for at, x in _units(lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {x.shape[1]: (number, Best(x, ids, k + 1)) for number, ids, x in shared.value}
        held: dict[int, list] = {size: [] for size in best}

        def search(size: int) -> None:
            parts, held[size] = held[size], []
            if parts:
                best[size][1].search(*(np.concatenate([p[j] for p in parts]) for j in range(3)))

        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for at, x in _units(batch.column(1)):
                size = x.shape[1]
                if size in best and len(at):
                    held[size].append((x, ids[at], null[at]))
                    if sum(len(p[0]) for p in held[size]) * size * 4 >= SHARD_BYTES:
                        search(size)
        for size, (number, own) in best.items():
            search(size)
            yield pa.RecordBatch.from_arrays([pa.array(number[own.query]), pa.array(own.row_id, mask=own.null), pa.array(own.similarity), pa.array(own.own)], names=["query", "neighbour", "similarity", "own"])

    return rows.mapInArrow(run, _FOUND)


def search(df: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(vec_id, neighbour, rank, similarity): the k nearest of each row whose id is divisible by ``every``."""
    rows = df.select(column(df, "vec_id", "bigint"), F.col("embedding").cast("array<double>").alias("v"))
    asking = rows.filter(F.col("vec_id") % every == 0)
    size, n = asking.agg(F.sum(F.size("v").cast("bigint") * 8 + 64), F.count(F.lit(1))).first()
    blocks = -(-(size or 0) // QUERY_BYTES)
    parts = []
    for b in range(blocks):
        own = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # QUERY_BYTES or so
        numbers = pa.array(np.arange(len(own)))
        found = _pass(rows, own.append_column("query", numbers), k)
        order = [F.desc("similarity"), F.col("neighbour").asc_nulls_last(), F.desc("own")]
        by = Window.partitionBy("query")
        # of the rows alike in id and vector one is the query itself
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query", "own").orderBy(*order))).filter("NOT own OR nth > 1")
        found = found.withColumn("rank", F.row_number().over(by.orderBy(*order))).filter(F.col("rank") <= k)
        names = df.sparkSession.createDataFrame(pa.table({"query": numbers, "vec_id": own["vec_id"]}))
        parts.append(stored(found.join(F.broadcast(names), "query").select("vec_id", "neighbour", "rank", "similarity"), "neighbours"))
    if not parts:
        return empty(df.sparkSession, "vec_id bigint, neighbour bigint, rank int, similarity double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: DuckDB SQL for ``search`` on the table ``embeddings``: exact, so it holds where no neighbour is missed.
ORACLE = f"""
WITH q AS (SELECT row_number() OVER () AS query, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % {EVERY} = 0),
scored AS (
  SELECT q.query, q.vec_id, e.vec_id AS neighbour, round(list_cosine_similarity(q.v, CAST(e.embedding AS DOUBLE[])), 6) AS similarity
  FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM scored)
SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, similarity FROM ranked WHERE rank <= {K}
"""
