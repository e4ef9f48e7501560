import math

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import neighbours, topk
from helpers import ODD, empty, frame, prose


def brute_scores(rows, queries, k):
    docs = [topk._WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or "")) for _, t in rows]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    out = []
    for item, text in queries:
        scores = []
        for (i, _), w in zip(rows, docs):
            s = 0
            for t in topk.terms_of(text):
                c = w.count(t)
                if c:
                    df = sum(t in x for x in docs)
                    s += math.floor(topk.SCALE * (math.log(1 + (n - df + 0.5) / (df + 0.5)) * (c * (topk.K1 + 1)) / (c + topk.K1 * (1 - topk.B + topk.B * len(w) / mean))) + 0.5)
            if s:
                scores.append((-s, i is None, i))
        out += [(item, i, -s, rank) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("terms", [10**6, 12])
def test_results_are_those_of_brute_force(spark, terms, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "QUERY_TERMS", terms)
    rows = [(i, prose(i, 5 + i % 40, 60)) for i in range(150)] + [(200, prose(1, 6, 60)), (200, prose(1, 6, 60)), *ODD, (None, prose(3, 9, 60)), (300, prose(9, 9000, 60))]
    queries = [(q, prose(500 + q, 6, 60)) for q in range(12)] + [(20, None), (21, ""), (22, "nothing known"), (None, "w1"), (23, "ONE"), (24, "text")]
    q = spark.createDataFrame([(i, t, "x") for i, t in queries], "item_id bigint, text string, score string")
    got = sorted(map(tuple, topk.search(frame(spark, rows), q, 5).select("item_id", "doc_id", "score", "rank").collect()), key=str)
    assert got == brute_scores(rows, [x for x in queries if x[0] is not None], 5)


def test_no_documents_or_queries(spark):
    q = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert topk.search(empty(spark), q).count() == 0 and topk.search(frame(spark, ODD), q.limit(0)).count() == 0


def _vectors(n, size, seed, noise=0.7):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((12, size))
    return centre[r.integers(0, 12, n)] + noise * r.standard_normal((n, size))


def _exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, 1)[:, :k]


@pytest.mark.parametrize("noise, shard", [(0.7, 1 << 24), (0.7, 24 * 4 * 400), (0.1, 1 << 24), (0.1, 24 * 4 * 400)])
def test_recall_against_brute_force(noise, shard, monkeypatch):
    """Wide and narrow groups, one shard and some, without any query compared with a whole shard for its size."""
    monkeypatch.setattr(neighbours, "DENSE", 1.0)
    x = _vectors(3000, 24, 3, noise)
    ids, size = np.arange(len(x)), shard // (24 * 4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = neighbours.Best(u, ids, 11)
    for a in range(0, len(x), size):
        best.search(u[a : a + size], ids[a : a + size], np.zeros(len(ids[a : a + size]), bool))
    top = _exact(x, 10)
    assert np.mean([len(set(best.row_id[(best.query == i) & ~best.own].tolist()) & set(top[i])) / 10 for i in range(0, len(x), 7)]) >= 0.9
    assert best.own.sum() == len(x)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 5000)
    x = _vectors(1500, 24, 3)
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int, row int")
    out = neighbours.search(df.repartition(5), 10, 20).toPandas()
    top = _exact(x, 10)
    assert len(out) == 750 and (out.vec_id != out.neighbour).all() and sorted(out.vec_id.unique()) == list(range(0, 1500, 20))
    got = out.sort_values("rank").groupby("vec_id").neighbour.apply(list)
    assert np.mean([len(set(got[i]) & set(top[i])) / 10 for i in got.index]) >= 0.9


def test_a_third_of_all_rows_alike(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same if i % 3 == 0 else [float(i), 1.0, -2.0]) for i in range(900)]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 5, 300).collect()
    got = {(r.vec_id, r["rank"]): (r.neighbour, r.similarity) for r in out}
    assert [got[300, k] for k in range(1, 6)] == [(i, 1.0) for i in (0, 3, 6, 9, 12)]
    assert [got[0, k] for k in range(1, 6)] == [(i, 1.0) for i in (3, 6, 9, 12, 15)]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (None, [1.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0]), (9, [None, 1.0]), (10, [-2.0]), (11, [1e300, 1e300])]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 2, 1).collect()
    got = sorted(((r.vec_id, r.neighbour, r["rank"], r.similarity) for r in out), key=str)
    assert len(got) == 2 * 5 + 2
    assert (1, 2, 1, 1.0) in got and got.count((3, 3, 1, 1.0)) == 2 and (1, 11, 2, 0.707107) in got and (8, 10, 1, -1.0) in got
    assert (11, None, 1, 1.0) in got and not any(g[0] is None for g in got)
    assert neighbours.search(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert neighbours.search(spark.createDataFrame(rows[:1], "vec_id bigint, embedding array<double>"), 2, 1).count() == 0


def test_levels():
    assert neighbours.level(np.array([1.0, -1.0])).tolist() == [neighbours.BITS, 0]
    levels = neighbours.level(np.arange(-10, 11) / 10).tolist()
    assert levels == sorted(levels)


def test_prefixes():
    x = np.random.default_rng(4).standard_normal((200, 8)).astype(np.float32)
    f, own = neighbours.Forest(x[:150]), neighbours.strings(x[150:])
    text = [[format(int(s), f"0{neighbours.BITS}b") for s in tree] for tree in neighbours.strings(x)]
    shared = lambda a, b: next((k for k in range(neighbours.BITS) if a[k] != b[k]), neighbours.BITS)
    longest = f.longest(own)
    for q in range(50):
        assert longest[q] == max(shared(t[150 + q], t[r]) for t in text for r in range(150))
    bits = f.ascend(own, 20)
    query, row, dense = f.candidates(own, bits, 10**9)
    for q in range(50):
        count = lambda x: sum(shared(t[150 + q], t[r]) >= x for t in text for r in range(150))
        assert (count(bits[q]) >= 20 or bits[q] == 0) and (bits[q] == longest[q] or count(bits[q] + 1) < 20)
        assert set(row[query == q]) == {r for r in range(150) if any(shared(t[150 + q], t[r]) >= bits[q] for t in text)}
    assert not len(dense) and len(f.candidates(own, bits, 0)[2]) == 50


def test_blocks_are_skipped_only_below_the_kth():
    r = np.random.default_rng(1)
    for _ in range(30):
        n, v = 40, 12
        offsets = np.r_[0, np.cumsum(r.integers(0, 6, n))]
        terms = np.concatenate([np.sort(r.choice(v, d, False)) for d in np.diff(offsets)] or [np.zeros(0, int)]).astype(np.int64)
        impact = r.integers(1, 5, len(terms))
        q = np.array([1, 4, 7])
        scores = [sum(int(i) for t, i in zip(terms[a:b], impact[a:b]) if t in q) for a, b in zip(offsets, offsets[1:])]
        want = sorted([(-s, d) for d, s in enumerate(scores) if s])[:3]
        ((_, rows, got),) = list(topk.search_blocks(np.arange(n), offsets, terms, impact, [q], 3)) or [(0, [], [])]
        assert [(-int(s), int(d)) for d, s in zip(rows, got)] == want


def test_terms_fold_only_ascii():
    assert topk.terms_of("Ab-aB É é 12") == sorted({"ab", "É", "é", "12"})
    assert pa.__version__
