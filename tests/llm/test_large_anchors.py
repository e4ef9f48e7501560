import numpy as np
import pytest

from fieldloom.llm import _text, suffixes
from helpers import frame, prose
from test_suffixes import brute, rows_of


def test_more_symbols_than_three_fit_in_a_key():
    n = (1 << 21) + 10
    text = np.r_[np.random.default_rng(1).permutation(n) + 1, [5, 4, 9, 5, 4, 8], 0]
    sa = suffixes.suffix_array(text)
    assert (np.sort(sa) == np.arange(len(text))).all() and (np.diff(text[sa]) >= 0).all()
    tied = np.flatnonzero(np.diff(text[sa]) == 0)
    assert len(tied) and all(text[sa[k] :][:9].tolist() < text[sa[k + 1] :][:9].tolist() for k in tied)


@pytest.mark.parametrize("words", [0, 60])
def test_split_anchors_give_the_ranges_of_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(suffixes, "SORTED_WORDS", words)
    common = " ".join(f"c{k}" for k in range(5))
    rows = rows_of(3) + [(100 + i, f"{prose(i % 7, 12, 90)} {common} {prose(i % 5 + 20, 12, 90)}") for i in range(30)]
    got = sorted(map(tuple, suffixes.ranges(frame(spark, rows), least=8, anchor=3).select("doc_id", "start", "stop", "first").collect()), key=str)
    assert got == brute(rows, 8)


def test_equal_grams_keep_equal_keys_and_others_part():
    rng, anchor = np.random.default_rng(2), np.arange(900, 908).astype(np.uint64)
    sides = [rng.integers(1, 1 << 60, 42).astype(np.uint64) for _ in range(60)]
    texts = [np.r_[sides[i], anchor, sides[(i * 7 + 1) % 60]] for i in range(60)] + [np.r_[sides[0], anchor, sides[1]]]
    short = np.concatenate([_text.grams(t, 8) for t in texts])
    each = len(texts[0]) - 7
    of, inner, size, key = suffixes.split(short, np.arange(61) * each, np.full(61, each - 42), np.full(61, _text.grams(anchor, 8)[0]), 43)
    keys = [np.repeat(key[of == k], size[of == k]).tolist() for k in range(61)]
    assert all(len(k) == each - 42 for k in keys) and keys[60] == keys[0]
    assert len(set(key.tolist())) > 60
