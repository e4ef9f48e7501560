import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import toxicity
from helpers import ODD, empty, frame, prose

BAD = [f"zork{x}" for x in ("a", "en", "ig", "los", "ung", "er")]


def text(seed, toxic, n=None):
    r = random.Random(seed)
    words = prose(seed, n or r.randint(20, 300), 800).split()
    for _ in range(2 if toxic else 0):
        words.insert(r.randrange(len(words)), r.choice(BAD))
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    labels = [k % 4 == 0 for k in range(600)]
    return toxicity.train([text(k, t) for k, t in enumerate(labels)], [int(t) for t in labels])


def judged(model, texts):
    return toxicity.judge(model, pa.array(texts, pa.large_string()))[2] >= model.threshold


def test_held_out_documents(model):
    bad, clean = [text(5000 + k, True) for k in range(150)], [text(7000 + k, False) for k in range(300)]
    assert judged(model, bad).mean() >= 0.95 and judged(model, clean).mean() <= 0.02


def test_characters_tell_unseen_words(model):
    unseen = [text(9000 + k, False) + " zorkheit zorkchen" for k in range(40)]
    assert judged(model, unseen).mean() >= 0.8


def test_a_window_at_the_end_of_a_long_text(model):
    long = prose(1, 30_000, 800)
    assert judged(model, [long + " zorken zorkig", long]).tolist() == [True, False]


def test_windows_cover_all_words_and_overlap():
    doc = np.repeat(np.arange(4), [0, 64, 65, 200])
    doc = np.r_[np.repeat(1, 64), np.repeat(2, 65), np.repeat(3, 200)]
    owner, start, stop = toxicity.windows(doc, 4)
    assert np.bincount(owner, minlength=4).tolist() == [0, 1, 2, 6]
    for d in (1, 2, 3):
        own = owner == d
        assert start[own][0] == np.searchsorted(doc, d) and stop[own][-1] == np.searchsorted(doc, d, "right") and (np.diff(start[own]) == toxicity.STRIDE).all()


def test_gradients_are_those_of_small_differences():
    r = np.random.default_rng(0)
    s = lambda *shape: r.standard_normal(shape).astype(np.float64) * 0.4
    H, D = toxicity.HIDDEN, toxicity.INPUTS
    params = {"Wf": s(D, 3 * H), "Uf": s(H, 3 * H), "bf": s(3 * H), "Wb": s(D, 3 * H), "Ub": s(H, 3 * H), "bb": s(3 * H), "v": s(2 * H), "o": s(2 * H), "b0": s(1)}
    x, index, y = s(7, D), r.integers(0, 7, (toxicity.WINDOW, 3)), np.array([1.0, 0, 1])
    index[:7, 0] = np.arange(7)
    index[40:, 1] = 7
    params = {k: v.astype(np.float32) for k, v in params.items()}
    x = x.astype(np.float32)

    def loss():
        m = toxicity.Model(None, None, None, None, (params["Wf"], params["Uf"], params["bf"]), (params["Wb"], params["Ub"], params["bb"]), params["v"], params["o"], float(params["b0"][0]), 0.5)
        z = toxicity.logits(m, x, index).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    grads, dx = toxicity._gradients(params, x, index, y)
    for name in params:
        flat = params[name].reshape(-1)
        for k in r.choice(len(flat), min(6, len(flat)), False):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-2, abs=2e-3), name
    for k in range(5):
        old = x[k, k]
        x[k, k] = old + 1e-2
        up = loss()
        x[k, k] = old - 1e-2
        down = loss()
        x[k, k] = old
        assert dx[k, k] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_network_is_a_plain_gated_recurrent_one_with_attention():
    """Each window in turn, in loops, against the batches."""
    r = np.random.default_rng(5)
    H, D = toxicity.HIDDEN, toxicity.INPUTS
    layer = lambda: (r.standard_normal((D, 3 * H)), r.standard_normal((H, 3 * H)), r.standard_normal(3 * H))
    f, b, v, o = layer(), layer(), r.standard_normal(2 * H), r.standard_normal(2 * H)
    x = r.standard_normal((9, D)).astype(np.float32)
    index = r.integers(0, 9, (toxicity.WINDOW, 6))
    index[5:, 1], index[1:, 2], index[63:, 3] = 9, 9, 9
    m = toxicity.Model(None, None, None, None, f, b, v, o, 0.3, 0.5)
    got = toxicity.logits(m._replace(forward=tuple(a.astype(np.float32) for a in f), backward=tuple(a.astype(np.float32) for a in b), attention=v.astype(np.float32), out=o.astype(np.float32)), x, index)
    soft = lambda a: a / (1 + np.abs(a))
    for n in range(6):
        words = [x[i] for i in index[:, n] if i < 9]

        def pass_over(words, W, U, bias):
            h, out = np.zeros(H), []
            for w in words:
                g, u = w @ W + bias, h @ U
                z, reset = (soft(g[k * H : k * H + H] + u[k * H : k * H + H]) / 2 + 0.5 for k in (0, 1))
                c = soft(g[2 * H :] + reset * u[2 * H :])
                h = z * h + (1 - z) * c
                out.append(h)
            return out

        states = [np.r_[p, q] for p, q in zip(pass_over(words, *f), pass_over(words[::-1], *b)[::-1])]
        weight = np.exp([s @ v for s in states])
        want = sum(a * s for a, s in zip(weight / weight.sum(), states)) @ o + 0.3
        assert got[n] == pytest.approx(want, abs=2e-3)


def test_equal_rows_give_equal_networks_by_any_number_of_threads():
    code = "import hashlib, test_toxicity as t; m = t.toxicity.train([t.text(k, k % 4 == 0) for k in range(60)], [int(k % 4 == 0) for k in range(60)]); print(hashlib.md5(b''.join(a.tobytes() for a in (*m[:4], *m.forward, *m.backward, m.attention, m.out)) + repr((m.bias, m.threshold)).encode()).hexdigest())"
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.pathsep.join([here, os.path.dirname(os.path.dirname(here))])
    said = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": path, "OPENBLAS_NUM_THREADS": n}, capture_output=True, text=True, check=True).stdout for n in ("1", "8")}
    assert len(said) == 1 and len(said.pop().strip()) == 32


def test_few_labels_of_the_tables_catch_documents_that_were_held_out():
    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.01"
    texts = dict(zip(*(pq.read_table(f"{at}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))))
    labels = pq.read_table(f"{at}/labels.parquet")
    rows = [(texts[i], t) for i, t in zip(labels["doc_id"].to_pylist(), labels["toxic"].to_pylist()) if texts.get(i)]
    own, rest = [r for k, r in enumerate(rows) if k % 4], [r for k, r in enumerate(rows) if not k % 4]
    model = toxicity.train(*zip(*own))
    hit = judged(model, [t for t, _ in rest])
    y = np.array([t for _, t in rest]) == 1
    # about a third of the toxic labels there are of texts that hold no such word
    assert hit[y].mean() >= 0.4 and hit[~y].mean() <= 0.03


def test_training_texts_are_bounded_in_bytes(spark):
    docs = frame(spark, [(k, "some words of a text " * (3 if k % 5 else 400)) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    texts, toxic = toxicity.labelled(docs, labels, 100, 1600)
    assert max(map(len, texts)) <= 100 and 0 < sum(len(t) for t, y in zip(texts, toxic) if y) <= 1600 and sum(len(t) for t, y in zip(texts, toxic) if not y) <= 1600


def test_scan_and_clean(spark, model):
    rows = [*ODD, (10, text(1, True)), (10, text(1, True)), (11, text(2, False)), (12, None)]
    docs = frame(spark, rows)
    found = toxicity.scan(docs, model).collect()
    assert [r.doc_id for r in found] == [10, 10] and all(r.windows >= 1 and 0 <= r.score <= 1 for r in found)
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns and left.count() == len(rows) - 2 and left.filter("doc_id = 10").count() == 0


def test_labels(spark):
    docs = frame(spark, [(k, text(k, k % 2 == 0)) for k in range(40)])
    labels = spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in range(40)] + [(None, 1, 1), (5, 0, None), (999, 1, 1), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    texts, toxic = toxicity.labelled(docs, labels)
    assert len(texts) == 40 and sum(toxic) == 21
    texts, toxic = toxicity.labelled(docs, labels, 4)
    assert sum(toxic) <= 4 and len(toxic) <= 8


def test_without_labels_nothing_is_toxic(spark):
    docs = frame(spark, [(1, text(1, True))])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.fit(docs, none) is None
    assert toxicity.scan(docs, None).count() == 0 and toxicity.clean(docs, None).count() == 1
    assert toxicity.scan(empty(spark), None).count() == 0
