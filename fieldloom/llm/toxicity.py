"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a word input (its log-odds among labelled documents and a learned hashed
embedding) and a character input (the highest and the mean log-odds of its byte n-grams and
the mean of their learned embeddings).  The network reads windows of ``WINDOW`` words that
overlap by half; every window of every document is scored and a document is toxic if its
highest score reaches the threshold.  This is set on the scores of all labelled documents, each
scored by a network that was trained on the other ``CROSSED - 1`` parts of them.

Training takes at most ``TRAIN_ROWS`` labelled documents of either class and ``TRAIN_BYTES`` of their texts,
the first by a hash of ``doc_id``: a document's label is that of its worst window, picked anew as training
goes on.  It sums in a fixed order, whatever the number of threads, so equal rows give equal networks.

Defined results: a null or wordless text has no window and is not toxic; a null ``doc_id`` is
carried as null; repeated rows are each judged; texts are scored whole, whatever their length;
a score equal to the threshold is toxic; an empty table gives no row; without labels of both
classes nothing is toxic; of contradictory labels of one document the toxic one holds; null labels,
labels of unknown documents and those of texts over a sixteenth of ``TRAIN_BYTES`` are ignored; other columns are kept by ``clean`` and ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import _text
from fieldloom.llm._store import column

TRAIN_ROWS, TRAIN_BYTES = 1000, 4 << 20
WINDOW, STRIDE = 64, 32
HIDDEN, LEARNED = 8, 3
INPUTS = 3 + 2 * LEARNED
WORD_BUCKETS, GRAM_BUCKETS = 1 << 17, 1 << 16
GRAM_SIZES = (3, 4, 5)
SHRINK = 2.0
EPOCHS, STEPS, BATCH, RATE = 3, 80, 128, 0.04  # as many epochs as make so many steps, EPOCHS at least; the weights are means over the latter half
LEARNED_RATE = 0.0005
RESCANS = 3  # times that the worst windows are picked
FOLDS = 4  # a document's log-odds in training come from the labels of the other folds
LEAN = 0.75
CROSSED = 3  # networks that score what they were not trained on
SCHEMA = "doc_id bigint, windows bigint, worst_word bigint, score double"
_SEPARATORS = _text.SPACE | _text.PUNCT


class Model(NamedTuple):
    words: np.ndarray  # log-odds by bucket
    grams: np.ndarray
    word_table: np.ndarray  # learned embeddings by bucket
    gram_table: np.ndarray
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]  # input weights, state weights, bias
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    attention: np.ndarray
    out: np.ndarray
    bias: float
    threshold: float


class Types(NamedTuple):
    """The distinct words of a chunk: buckets of the words, flat buckets of their n-grams with bounds."""

    words: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    count: np.ndarray


def types_of(w: _text.Words, codes: np.ndarray, first: np.ndarray, step: int = 1 << 15) -> Types:
    """``first``: one occurrence of each distinct word. ``step`` words at a time, to bound memory."""
    parts = [_grams(w, first[k : k + step]) for k in range(0, len(first), step)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    count = np.concatenate([p[1] for p in parts])
    return Types((codes[first] & np.uint64(WORD_BUCKETS - 1)).astype(np.int32), np.concatenate([p[0] for p in parts]), np.cumsum(count) - count, count)


def _grams(w: _text.Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words, one word after the other, and how many each has."""
    starts, size = w.starts[first], (w.ends - w.starts)[first]
    n = len(first)
    begin = np.cumsum(size + 2) - (size + 2)
    owner = np.repeat(np.arange(n), size + 2)
    inner = np.arange(len(owner)) - begin[owner]
    text = w.data[np.clip(starts[owner] + inner - 1, 0, len(w.data) - 1)].astype(np.uint64)
    text[inner == 0] = 2
    text[inner == size[owner] + 1] = 3
    left = size[owner] + 2 - inner
    key = np.zeros(len(owner), np.uint64)
    buckets, owners = [], []
    for k in range(GRAM_SIZES[-1]):
        key[: len(key) - k] = key[: len(key) - k] * np.uint64(257) + text[k:]
        if k + 1 in GRAM_SIZES:
            fits = left >= k + 1
            buckets.append((_text.mix(key[fits] + np.uint64((k + 1) << 56)) & np.uint64(GRAM_BUCKETS - 1)).astype(np.int32))
            owners.append(owner[fits])
    flat, own = np.concatenate(buckets), np.concatenate(owners)
    return flat[np.argsort(own, kind="stable")], np.bincount(own, minlength=n)


def inputs(t: Types, words: np.ndarray, grams: np.ndarray, word_table: np.ndarray, gram_table: np.ndarray) -> np.ndarray:
    """The network's input for each distinct word; every word has an n-gram, as its ends are marked."""
    out = np.empty((len(t.words), INPUTS), np.float32)
    for k in range(0, len(t.words), 1 << 15):
        some = slice(k, min(k + (1 << 15), len(t.words)))
        first, n = t.first[some] - t.first[k], t.count[some].astype(np.float32)
        own = t.grams[t.first[k] : t.first[k] + int(t.count[some].sum())]
        out[some, 1] = np.maximum.reduceat(grams[own], first)
        out[some, 2] = np.add.reduceat(grams[own], first) / n
        out[some, 3 + LEARNED :] = np.add.reduceat(gram_table[own], first) / n[:, None]
    out[:, 0] = words[t.words]
    out[:, 3 : 3 + LEARNED] = word_table[t.words]
    return out


def windows(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, word after the last) of each window. doc: of each word, ascending."""
    n = np.bincount(doc, minlength=n_docs)
    k = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(n_docs), k)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)
    base = np.cumsum(n) - n
    start = base[owner] + at * STRIDE
    return owner, start, np.minimum(start + WINDOW, base[owner] + n[owner])


def _indices(inverse: np.ndarray, start: np.ndarray, stop: np.ndarray, pad: int) -> np.ndarray:
    """WINDOW rows, one for each place; ``pad`` beyond a window's end."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    out = inverse[np.minimum(at, len(inverse) - 1)]
    out[at >= stop[None, :]] = pad
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, summed in the same order by any number of threads."""
    return np.einsum("ij,jk->ik", a, b)


def _states(projected: np.ndarray, state: np.ndarray, index: np.ndarray, places, keep: list | None = None, product=np.matmul) -> Iterator[tuple[int, np.ndarray]]:
    """The hidden state after each place, in the order of ``places``. The last row of ``projected`` keeps the state as it is."""
    h = np.zeros((index.shape[1], HIDDEN), np.float32)
    for t in places:
        g, u = np.take(projected, index[t], axis=0), product(h, state)
        gates = _squash(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = _squash(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
        h = c + z * (h - c)
        yield t, h


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the network's sigmoid, cheaper than one with exponentials."""
    scale = np.abs(x)
    scale += 1
    x /= scale
    return x


def _projected(x: np.ndarray, layer, product=np.matmul) -> np.ndarray:
    """Projections of the inputs and, last, of the padding: its update gate is shut."""
    hold = np.zeros((1, 3 * HIDDEN), np.float32)
    hold[0, :HIDDEN] = 1e9
    return np.concatenate([product(x, layer[0]) + layer[2], hold]).astype(np.float32)


def logits(m: Model, x: np.ndarray, index: np.ndarray, product=np.matmul) -> np.ndarray:
    """One for each column of ``index``."""
    return _logits(m, _projected(x, m.forward, product), _projected(x, m.backward, product), index, product)


def _logits(m: Model, ahead: np.ndarray, behind: np.ndarray, index: np.ndarray, product=np.matmul) -> np.ndarray:
    """ahead, behind: projections of the inputs. Attention is summed as the backward states come."""
    forward = np.empty((WINDOW, index.shape[1], HIDDEN), np.float32)
    for t, h in _states(ahead, m.forward[1], index, range(WINDOW), product=product):
        forward[t] = h
    n, pad = index.shape[1], len(ahead) - 1
    total, pooled = np.zeros(n, np.float32), np.zeros(n, np.float32)
    ends = np.stack([m.attention, m.out], 1)
    for t, h in _states(behind, m.backward[1], index, range(WINDOW - 1, -1, -1), product=product):
        both = product(forward[t], ends[:HIDDEN]) + product(h, ends[HIDDEN:])
        a = np.exp(np.clip(both[:, 0], -30, 30)) * (index[t] < pad)
        total += a
        pooled += a * both[:, 1]
    return pooled / np.maximum(total, 1e-30) + m.bias


def judge(m: Model, texts: pa.Array, product=np.matmul) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, first word of the worst, its score) of each text; -1 without a window."""
    n = len(texts)
    count, worst, best = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1.0)
    for a, b, part in _text.string_chunks(texts):
        w = _text.words(part, _SEPARATORS, fold=True)
        if not len(w.starts):
            continue
        codes = _text.word_codes(w)
        _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
        x = inputs(types_of(w, codes, first), m.words, m.grams, m.word_table, m.gram_table)
        owner, start, stop = windows(w.doc, b - a)
        sides = [_projected(x, layer, product) for layer in (m.forward, m.backward)]
        score = np.concatenate([_logits(m, *sides, _indices(inverse, start[k : k + 1024], stop[k : k + 1024], len(x)), product) for k in range(0, len(start), 1024)]).astype(np.float64)
        score = 1 / (1 + np.exp(-score))
        count[a:b] = np.bincount(owner, minlength=b - a)
        order = np.lexsort((start, -score, owner))
        head = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        best[a + owner[head]] = score[head]
        base = np.searchsorted(w.doc, owner[head])
        worst[a + owner[head]] = start[head] - base
    return count, worst, best


def _odds(parts: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray, fold: np.ndarray, size: int) -> list[np.ndarray]:
    """Shrunk log-odds of toxicity by bucket, without the documents of each fold and, last, of all.

    parts: (document, bucket) with all that a document has in one part. fold: of each document.
    """
    counts = np.zeros((2 * FOLDS, size), np.float32)
    for doc, bucket in parts:
        seen = np.unique(doc.astype(np.int64) * size + bucket)
        kind = label[seen // size] * FOLDS + fold[seen // size]
        counts += np.bincount(kind * size + seen % size, minlength=counts.size).reshape(counts.shape)
    q, p = counts[:FOLDS], counts[FOLDS:]
    rate = label.sum() / max(1, (~label).sum())
    up, down = max(1.0, rate), max(1.0, 1 / rate)  # counts as if of equal classes, at the smaller one's size
    rest = [(p.sum(0) - p[f], q.sum(0) - q[f]) for f in range(FOLDS)] + [(p.sum(0), q.sum(0))]
    return [np.log((a / up + SHRINK) / (b / down + SHRINK)).astype(np.float32) for a, b in rest]


def _gradients(params: dict, x: np.ndarray, index: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray]:
    """Of the mean log-loss, by parameter and for ``x``."""
    n, pad = index.shape[1], len(x)
    layers = {"f": (params["Wf"], params["Uf"], params["bf"]), "b": (params["Wb"], params["Ub"], params["bb"])}
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
    for t, h in _states(_projected(x, layers["f"], _product), layers["f"][1], index, range(WINDOW), kept["f"], _product):
        states[t, :, :HIDDEN] = h
    for t, h in _states(_projected(x, layers["b"], _product), layers["b"][1], index, range(WINDOW - 1, -1, -1), kept["b"], _product):
        states[t, :, HIDDEN:] = h
    a = np.exp(np.clip(np.einsum("tnh,h->tn", states, params["v"]), -30, 30)) * (index < pad)
    a /= np.maximum(a.sum(0), 1e-30)
    pooled = np.einsum("tn,tnh->nh", a, states)
    p = 1 / (1 + np.exp(-(np.einsum("nh,h->n", pooled, params["o"]) + params["b0"][0])))
    d = ((p - label) / n).astype(np.float32)
    grads = {"o": np.einsum("nh,n->h", pooled, d), "b0": np.array([d.sum()], np.float32)}
    dpool = d[:, None] * params["o"]
    da = np.einsum("tnh,nh->tn", states, dpool)
    da = a * (da - (a * da).sum(0))
    grads["v"] = np.einsum("tn,tnh->h", da, states)
    dstates = a[:, :, None] * dpool + da[:, :, None] * params["v"]
    order = np.argsort(index.ravel(), kind="stable")  # every word of x occurs, so there is a run for each
    ranked = index.ravel()[order]
    heads, padding = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]), ranked[-1] == pad
    dx, dg = np.zeros_like(x), np.empty((WINDOW, n, 3 * HIDDEN), np.float32)
    for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        W, U, _ = layers[side]
        dU = np.zeros_like(U)
        carry = np.zeros((n, HIDDEN), np.float32)
        for t, before, z, r, c, uc in reversed(kept[side]):
            dh = dstates[t, :, part] + carry
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (before - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * uc * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            np.concatenate([dz, dr, dc], 1, out=dg[t])
            du = np.concatenate([dz, dr, dc * r], 1)
            carry = dh * z + np.einsum("nk,hk->nh", du, U)
            dU += np.einsum("nh,nk->hk", before, du)
        projected = np.add.reduceat(dg.reshape(-1, 3 * HIDDEN)[order], heads)  # by word
        projected = projected[:-1] if padding else projected
        dx += np.einsum("wk,ik->wi", projected, W)
        grads |= {f"W{side}": np.einsum("wi,wk->ik", x, projected), f"U{side}": dU, f"b{side}": projected.sum(0)}
    return grads, dx


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model | None:
    """None without documents of both classes, or words."""
    label, column_ = np.array(toxic, bool), pa.array([t or "" for t in texts], pa.large_string())
    made = _network(column_, label, seed)
    if made is None:
        return None
    part, rng = np.zeros(len(label), np.int64), np.random.default_rng(seed + 1)
    for kind in (True, False):
        own = rng.permutation(np.flatnonzero(label == kind))
        part[own] = np.arange(len(own)) % CROSSED
    scores, labels = [], []
    for k in range(CROSSED):
        rest, own = np.flatnonzero(part != k), np.flatnonzero(part == k)
        other = _network(column_.take(pa.array(rest)), label[rest], seed)
        if other is not None and len(own):
            scores.append(judge(other, column_.take(pa.array(own)), _product)[2])
            labels.append(label[own])
    if not scores:  # one document of a class: it can't be held out
        scores, labels = [judge(made, column_, _product)[2]], [label]
    return made._replace(threshold=_threshold(np.concatenate(scores), np.concatenate(labels)))


def _network(column_: pa.Array, label: np.ndarray, seed: int) -> Model | None:
    """A trained network, its threshold not yet set."""
    if not len(label) or label.all() or not label.any():
        return None
    w = _text.words(column_, _SEPARATORS, fold=True)
    if not len(w.starts):
        return None
    rng = np.random.default_rng(seed)
    codes = _text.word_codes(w)
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    types = types_of(w, codes, first)
    fold = np.zeros(len(label), np.int64)
    for kind in (True, False):
        own = rng.permutation(np.flatnonzero(label == kind))
        fold[own] = np.arange(len(own)) % FOLDS
    pair = np.unique(w.doc * np.int64(len(first)) + inverse)

    def words_seen(step: int = 50_000):
        """Distinct words by document, some whole documents at a time."""
        at = 0
        while at < len(pair):
            to = int(np.searchsorted(pair, (pair[min(at + step, len(pair)) - 1] // len(first) + 1) * len(first)))
            yield pair[at:to] // len(first), pair[at:to] % len(first)
            at = to

    def grams_seen():
        for doc, kind in words_seen():
            reps = types.count[kind]
            yield np.repeat(doc, reps), types.grams[np.repeat(types.first[kind] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]

    odds = _odds(((doc, types.words[kind]) for doc, kind in words_seen()), label, fold, WORD_BUCKETS)
    gram_odds = _odds(grams_seen(), label, fold, GRAM_BUCKETS)
    scale = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    params = {"Wf": scale(INPUTS, 3 * HIDDEN), "Uf": scale(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32), "Wb": scale(INPUTS, 3 * HIDDEN), "Ub": scale(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32)}
    params |= {"v": scale(2 * HIDDEN), "o": scale(2 * HIDDEN), "b0": np.zeros(1, np.float32), "ew": scale(WORD_BUCKETS, LEARNED) * 0.1, "eg": scale(GRAM_BUCKETS, LEARNED) * 0.1}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    owner, start, stop = windows(w.doc, len(label))

    def model(threshold: float = 0.5) -> Model:
        return Model(odds[-1], gram_odds[-1], params["ew"], params["eg"], (params["Wf"], params["Uf"], params["bf"]), (params["Wb"], params["Ub"], params["bb"]), params["v"], params["o"], float(params["b0"][0]), threshold)

    def sides() -> list[np.ndarray]:
        """Inputs of all distinct words for the documents of each fold, whose labels don't count."""
        return [inputs(types, odds[f], gram_odds[f], params["ew"], params["eg"]) for f in range(FOLDS)]

    def worst(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((rng.random(len(score)), -score, owner))
        return order[np.r_[True, owner[order][1:] != owner[order][:-1]]]

    step, kinds = 0, np.bincount(label, minlength=2)
    average, averaged = {k: np.zeros_like(v) for k, v in params.items()}, 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // int(4 * kinds.max())))
    for epoch in range(epochs):
        if epoch % -(-epochs // RESCANS) == 0:
            x = np.stack(sides())
            score = np.zeros(len(start))
        else:
            score = None
        if epoch == 0:
            single = [s[:, 0] + s[:, 1] for s in x]
            per_word = np.stack(single)[fold[w.doc], inverse]
            score = np.maximum.reduceat(np.r_[per_word, -9.0], np.c_[start, stop].ravel())[::2]
        elif score is None:
            pass
        else:
            score = np.empty(len(start), np.float32)
            for f in range(FOLDS):
                own, now = np.flatnonzero(fold[owner] == f), model()
                both = [_projected(x[f], layer, _product) for layer in (now.forward, now.backward)]
                for k in range(0, len(own), 1024):
                    part = own[k : k + 1024]
                    score[part] = _logits(now, *both, _indices(inverse, start[part], stop[part], len(types.words)), _product)
        picked = worst(score) if score is not None else picked
        chosen = picked
        clean = np.flatnonzero(~label[owner])
        chosen = np.r_[chosen, rng.choice(clean, min(len(clean), len(chosen)), False)]
        chosen = rng.permutation(chosen)
        balance = max(1, round(float((~label[owner[chosen]]).sum() / max(1, label[owner[chosen]].sum()))))
        chosen = rng.permutation(np.concatenate([chosen, np.repeat(chosen[label[owner[chosen]]], balance - 1)]))
        for k in range(0, len(chosen), BATCH):
            part = chosen[k : k + BATCH]
            y = label[owner[part]]
            index = _indices(inverse, start[part], stop[part], -1)
            index = np.where(index >= 0, index + (fold[owner[part]] * len(types.words))[None, :], -1)
            live, local = np.unique(index, return_inverse=True)
            local = local.reshape(index.shape)
            if live[0] < 0:
                live, local = live[1:], np.where(local == 0, len(live) - 1, local - 1)
            own = live % len(types.words)
            gather = types.count[own]
            bounds = np.cumsum(gather) - gather
            grams = types.grams[np.repeat(types.first[own] - bounds, gather) + np.arange(gather.sum())]
            odds_in = x[live // len(types.words), own, :3]
            learned = np.add.reduceat(params["eg"][grams], bounds) / gather[:, None]
            xs = np.concatenate([odds_in, params["ew"][types.words[own]], learned], 1).astype(np.float32)
            grads, dx = _gradients(params, xs, local, y.astype(np.float32))
            sparse = {"ew": (types.words[own], dx[:, 3 : 3 + LEARNED]), "eg": (grams, np.repeat(dx[:, 3 + LEARNED :] / gather[:, None], gather, 0))}
            step += 1
            rate = RATE * (1 - epoch / (epochs + 2))
            for name, g in grads.items():
                m1, m2 = moments[name]
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                params[name] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            for name, (rows, g) in sparse.items():
                at, back = np.unique(rows, return_inverse=True)
                total = np.stack([np.bincount(back, g[:, j], len(at)) for j in range(LEARNED)], 1).astype(np.float32)
                m2 = moments[name][1]
                m2[at] += total * total
                params[name][at] -= LEARNED_RATE * total / (np.sqrt(m2[at]) + 1e-6)
            if epoch >= epochs // 2:
                averaged += 1
                for name, v in params.items():
                    average[name] += (v - average[name]) / averaged
    params.update(average)
    return model()


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """In the gap with the fewest mistakes (of several, the widest), ``LEAN`` of the way to the higher score."""
    order = np.argsort(score)
    s, y = score[order], label[order]
    wrong = np.r_[0, np.cumsum(y)] + 2 * np.r_[np.cumsum((~y)[::-1])[::-1], 0]  # a clean document lost counts twice
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax(np.r_[s, 1.0][best] - np.r_[0.0, s][best])]
    low, high = np.clip(s[max(k - 1, 0)] if k else 0.0, 1e-4, 0.9999), np.clip(s[k] if k < len(s) else 1.0, 1e-4, 0.9999)
    edge = lambda p: np.log(p / (1 - p))
    return float(1 / (1 + np.exp(-(edge(low) + LEAN * (edge(high) - edge(low))))))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """At most ``rows`` labelled texts and ``size`` bytes of either class, the first by hash of doc_id."""
    known = labels.select(column(labels, "doc_id", "bigint"), column(labels, "toxic", "int")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    texts = docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string"))
    both = chosen[0].unionByName(chosen[1])  # 2 * rows at most, so it may be broadcast
    found = texts.join(F.broadcast(both), "doc_id").filter(F.octet_length("text") <= size // 16)
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("so_far", so_far).filter(F.col("so_far") <= size).select("doc_id", "text", "toxic", F.xxhash64("text").alias("code")).toArrow()
    order = np.lexsort((found["code"].to_numpy(), found["doc_id"].to_numpy()))
    found = found.take(pa.array(order))
    return found["text"].to_pylist(), found["toxic"].to_pylist()


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    return train(*labelled(docs, labels, rows))


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each toxic document: its windows, the first word of the worst one and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is None or not len(batch):
                continue
            count, worst, score = judge(m, batch.column(1))
            hit = np.flatnonzero(score >= m.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array(count[hit]), pa.array(worst[hit]), pa.array(score[hit])], names=["doc_id", "windows", "worst_word", "score"])

    return docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the toxic documents; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array(np.zeros(len(texts), bool) if m is None else judge(m, texts)[2] >= m.threshold)

    return docs.filter(~toxic(F.col("text").cast("string")))
