"""Vectorised text primitives on Arrow string buffers, shared by the operators.

A chunk of documents is one UTF-8 byte buffer; words are byte ranges in it and their
64-bit codes come from one running sum over the bytes, so no Python object is made
for a word.  Only ASCII white space separates words; a null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte that is neither letter nor digit; bytes beyond ASCII belong to words.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers[:] = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def release() -> None:
    """Gives back to the system what Arrow and malloc keep of freed memory, that of a worker's earlier tasks too."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    data: np.ndarray  # bytes of the chunk
    offsets: np.ndarray  # where each document begins, and the end
    starts: np.ndarray  # byte where each word begins
    ends: np.ndarray  # byte after each word
    doc: np.ndarray  # document of each word, as its row in the chunk
    sums: np.ndarray | None  # running sums for codes of byte ranges


def string_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, strings) with about ``limit`` bytes each; a longer text is its own chunk."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    at = 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, column.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and its offsets from 0."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a document's end: first bytes and bytes after the last."""
    n = len(inside)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < n]
    begin[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def words(column: pa.Array, separators: np.ndarray = SPACE, fold: bool = False, codes: bool = True) -> Words:
    data, offsets = raw(column)
    if fold:
        data = LOWER[data]
    starts, ends = runs(~separators[data], offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    sums = None
    if codes:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * powers(len(data) + 1)[1][: len(data)], out=sums[1:])
    return Words(data, offsets, starts, ends, doc, sums)


def range_codes(w: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit codes of byte ranges: equal for equal bytes wherever they stand."""
    p = powers(len(w.data) + 1)[0]
    return mix((w.sums[ends] - w.sums[starts]) * p[starts] + (ends - starts).astype(np.uint64))


def word_codes(w: Words) -> np.ndarray:
    return range_codes(w, w.starts, w.ends)


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of all runs of ``size`` words, one for each place where such a run can begin."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= _BASE
        out += codes[k : k + n]
    return mix(out)


def code_of(text: str) -> int:
    """The code of one word."""
    w = words(pa.array([text], pa.large_string()), np.zeros(256, bool))
    return int(range_codes(w, np.array([0]), np.array([len(w.data)]))[0])
