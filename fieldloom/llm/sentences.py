"""SentencePiece models run by the tokenizers library.

The model's protobuf is read here, field by field, and rebuilt: its normaliser (character map,
white-space rules), the white-space marker, its pieces with unigram scores (or, in a model of
merges, the merges that the scores imply), and byte fallback.  Batches are encoded by the
library's threads.  ``parity`` compares the ids with those of the SentencePiece library.

If no piece has a marker after another character, no token crosses the place before a run of
markers, and a text is the chain of its units, each a run of spaces and what follows.  Then each
distinct unit is encoded and decoded once for a worker and texts are put together
from the ids.  A model whose normaliser changes characters or collapses spaces, and a text
that holds the marker itself, are encoded and decoded as whole texts.  Parity is always that of whole texts: the
SentencePiece library encodes each text as it stands and all its ids are compared.  (With a unigram model it sums the
scores of a whole text in 32 bits, so of nearly equal segmentations of a long one it may take the second; ``same_ids`` tells.)

Defined results: a null text gives null ids, count 0 and is in parity; an empty text gives no ids; a null
``doc_id`` and repeated rows are carried; texts are encoded whole, whatever their length; an
empty table gives no row; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fieldloom.llm import _text
from fieldloom.llm._store import column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
#: Bytes of text encoded at once: as units, and as whole texts.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 256 << 10
#: Distinct units that a worker remembers, beyond which it starts afresh, and that it encodes at once.
REMEMBERED, UNITS = 1 << 20, 4096
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Put before pieces that text never matches, so that they keep their ids.
_HIDDEN = "\U0010fffe"
SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, same_ids boolean, same_text boolean"


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class Model(NamedTuple):
    pieces: list[Piece]
    kind: int
    byte_fallback: bool
    unknown: int
    charsmap: bytes
    dummy_prefix: bool
    collapse: bool
    escape: bool


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: ints, or bytes for all else."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else None)
            if size is None or at + size > n:
                raise ValueError("not a SentencePiece model")
            yield tag >> 3, data[at : at + size]
            at += size


def read(data: bytes) -> Model:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append(Piece(piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    unknown = next((i for i, p in enumerate(pieces) if p.kind == UNKNOWN), 0)
    return Model(pieces, kind, bool(trainer.get(35, 0)), unknown, normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))


def character_map(data: bytes) -> dict[str, str]:
    """The replacements of a precompiled map: a double-array trie of UTF-8 keys, whose leaves are places in a block of strings."""
    size = int.from_bytes(data[:4], "little")
    units, strings = np.frombuffer(data, "<u4", size // 4, 4).astype(np.int64), data[4 + size :]
    out: dict[str, str] = {}
    offset = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    stack, labels = [(b"", offset(int(units[0])))], np.arange(1, 256)
    while stack:
        key, node = stack.pop()
        at = node ^ labels
        at = np.where(at < len(units), at, 0)
        for label in labels[(units[at] & 0x800000FF) == labels].tolist():
            unit = int(units[node ^ label])
            longer, below = key + bytes([label]), (node ^ label) ^ offset(unit)
            if unit >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                out[longer.decode()] = strings[start : strings.index(b"\0", start)].decode()
            stack.append((longer, below))
    return out


class CharacterMap:
    """Replaces, from the left, the longest keys of a map."""

    def __init__(self, table: dict[str, str]):
        self.table, self.longest = table, max(map(len, table))
        one, two = ("".join(sorted({k[n] for k in table if len(k) >= n + 1 and (n or len(k) == 1)})) for n in (0, 1))
        self.begins = re.compile("|".join([*([f"[{re.escape(one)}]"] if one else []), *([f"(?s:.)(?=[{re.escape(two)}])"] if two else [])]))

    def __call__(self, text: str) -> str:
        out, done, at = [], 0, 0
        while m := self.begins.search(text, at):
            at = m.start()
            found = next((k for n in range(self.longest, 0, -1) if (k := text[at : at + n]) in self.table), None)
            if found is None:
                at += 1
                continue
            out += [text[done:at], self.table[found]]
            at = done = at + len(found)
        return "".join([*out, text[done:]]) if out else text


def merges(model: Model) -> list[tuple[str, str]]:
    """The pairs that make up each piece, best piece first; of one piece, by the ids of the halves."""
    known = {p.text: i for i, p in enumerate(model.pieces) if p.kind in (NORMAL, USER, UNUSED)}
    out = []
    for text, i in known.items():
        if model.pieces[i].kind == NORMAL and len(text) > 1:
            pairs = [(known[text[:k]], known[text[k:]], k) for k in range(1, len(text)) if text[:k] in known and text[k:] in known]
            out += [(-model.pieces[i].score, i, a, b, text[:k], text[k:]) for a, b, k in pairs]
    out.sort()
    return [(a, b) for *_, a, b in out]


def separable(model: Model) -> bool:
    """Whether no piece crosses the place between a character and a marker after it."""
    return not any(MARKER in p.text.lstrip(MARKER) for p in model.pieces if p.kind in (NORMAL, USER, UNUSED))


def build(model: Model):
    """The tokenizer of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

    names = [p.text if p.kind not in (CONTROL, UNKNOWN) else _HIDDEN + p.text for p in model.pieces]
    if model.kind == UNIGRAM:
        scores = [p.score for p in model.pieces]
        core = models.Unigram(list(zip(names, scores)), model.unknown, model.byte_fallback)
    else:
        core = models.BPE(vocab={n: i for i, n in enumerate(names)}, merges=merges(model), unk_token=names[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = []  # the character map comes before these, see Codec
    if model.collapse:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if separable(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+"), "isolated")
    if users := [p.text for p in model.pieces if p.kind == USER]:
        tokenizer.add_tokens([AddedToken(u, normalized=False) for u in users])
    return tokenizer


class Codec:
    """A model's encoder and decoder."""

    def __init__(self, data: bytes):
        self.model = read(data)
        self.tokenizer = build(self.model)
        self.map = CharacterMap(character_map(self.model.charsmap)) if self.model.charsmap else None
        self.kinds = np.array([p.kind for p in self.model.pieces])
        self.bytes = [bytes([int(p.text[3:5], 16)]) if p.kind == BYTE else b"" if p.kind == CONTROL else b" \xe2\x81\x87 " if p.kind == UNKNOWN else p.text.replace(MARKER, " ").encode() for p in self.model.pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.map:
            texts = [self.map(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the marker that the normaliser put before it goes."""
        table = self.bytes
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def normalise(self, text: str) -> str:
        """What a decoded text should be."""
        text = self.map(text) if self.map else text
        out = self.tokenizer.normalizer.normalize_str(text).replace(MARKER, " ") if text else ""
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out


class _Units:
    """Ids of distinct units by code, and whether they give the unit again; kept sorted by code."""

    def __init__(self, own: Codec):
        self.own = own
        self.clear()

    def clear(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.back = np.zeros(0, bool)
        self.flat = np.zeros(0, np.int32)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[bool]]:
        """A unit begins with a space, which is the marker that the normaliser puts before it."""
        own = self.own
        ids = own.encode([u[1:] for u in units])
        alone = own.tokenizer.model.tokenize(MARKER)
        ids = [x if len(u) > 1 else [t.id for t in alone] for u, x in zip(units, ids)]
        return ids, [own.decode(x) == u[1:] for u, x in zip(units, ids)]

    def add(self, codes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes ``UNITS`` at a time: what the library returns for a unit is many times its size."""
        sizes, flats, backs = [], [self.flat], []
        for at in range(0, len(codes), UNITS):
            ids, back = self.encode([data[a:b].tobytes().decode() for a, b in zip(starts[at : at + UNITS].tolist(), ends[at : at + UNITS].tolist())])
            sizes.append(np.array([len(x) for x in ids], np.int64))
            flats.append(np.fromiter((i for x in ids for i in x), np.int32, sizes[-1].sum()))
            backs.append(np.array(back, bool))
        size, back = np.concatenate(sizes), np.concatenate(backs)
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate(flats)
        joined = np.concatenate([self.codes, codes])
        order = np.argsort(joined, kind="stable")
        self.codes = joined[order]
        for name, new in (("begin", begin), ("size", size), ("back", back)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])

    def texts(self, part: pa.Array):
        """(size of each text, flat ids, restored)."""
        data, offsets = _text.raw(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), part, pa.scalar(" ", pa.large_string())))
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1]] = True
        starts = np.flatnonzero(start)
        ends = np.r_[starts[1:], len(data)]
        doc = np.searchsorted(offsets, starts, "right") - 1
        full = np.diff(offsets)[doc] > 1
        starts, ends, doc = starts[full], ends[full], doc[full]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_text._BYTE_CODES[data] * _text.powers(len(data) + 1)[1][: len(data)], out=sums[1:])
        codes = _text.range_codes(_text.Words(data, offsets, starts, ends, doc, sums), starts, ends)
        distinct, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
        while True:
            at = np.searchsorted(self.codes, distinct)
            found = at < len(self.codes)
            found[found] = self.codes[at[found]] == distinct[found]
            new = np.flatnonzero(~found)
            if not len(new):
                break
            if len(self.codes) + len(new) > REMEMBERED:
                self.clear()
                new = np.arange(len(distinct))
            self.add(distinct[new], data, starts[first[new]], ends[first[new]])
        at = at[inverse]
        size = self.size[at]
        flat = self.flat[np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        n = len(part)
        return np.bincount(doc, size, n).astype(np.int64), flat, np.bincount(doc, ~self.back[at], n) == 0


_codecs: dict[str, tuple] = {}


def codec(path: str):
    """(our codec, the SentencePiece processor, the units so far) for a model file, once for each Python process."""
    if path not in _codecs:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, "rb") as f:
            data = f.read()
        own, other = Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        m = own.model
        units = _Units(own) if separable(m) and m.dummy_prefix and m.escape and not m.charsmap and not m.collapse and not any(p.kind == USER for p in m.pieces) else None
        _codecs[path] = own, other, units
    return _codecs[path]


def _whole(own: Codec, part: pa.Array):
    strings = part.to_pylist()
    ids = own.encode(strings)
    back = [own.decode(x) == own.normalise(s) for x, s in zip(ids, strings)]
    size = np.array([len(x) for x in ids], np.int64)
    return size, np.fromiter((i for x in ids for i in x), np.int32, size.sum()), np.array(back, bool)


def same_ids(other, part: pa.Array, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Whether SentencePiece gives the same ids for each whole text, ``BATCH_BYTES`` of them at a time."""
    out, end = np.zeros(len(part), bool), np.cumsum(size)
    for a, b, some in _text.string_chunks(part, BATCH_BYTES):
        for k, ids in enumerate(other.encode(some.to_pylist(), num_threads=THREADS), a):
            out[k] = len(ids) == size[k] and np.array_equal(np.array(ids, np.int32), flat[end[k] - size[k] : end[k]])
    return out


def encode_strings(texts: pa.Array, model: str, parity: bool) -> Iterator[tuple[int, int, tuple]]:
    """(first row, row after the last, (sizes, flat ids, in parity, restored)); a null counts as empty."""
    own, other, units = codec(model)

    def checked(part: pa.Array, found: tuple) -> tuple:
        size, flat, back = found
        return size, flat, same_ids(other, part, size, flat) if parity else np.ones(len(size), bool), back

    for a, b, part in _text.string_chunks(texts, CHUNK_BYTES if units else BATCH_BYTES):
        _text.release()
        if units is None or pc.any(pc.match_substring(part, MARKER)).as_py():
            for c, d, small in _text.string_chunks(part, BATCH_BYTES):
                plain = units is not None and not pc.any(pc.match_substring(small, MARKER)).as_py()
                yield a + c, a + d, checked(small, units.texts(small) if plain else _whole(own, small))
        else:
            yield a, b, checked(part, units.texts(part))


def encode(docs: DataFrame, model: str = MODEL, parity: bool = True) -> DataFrame:
    """One row for each document: ids, whether SentencePiece gives the same, and whether decoding gives the (normalised) text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b, (size, flat, same, back) in encode_strings(texts, model, parity):
                null = texts.slice(a, b - a).is_null().to_numpy(zero_copy_only=False)
                offsets = np.zeros(b - a + 1, np.int32)
                np.cumsum(size, out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(null))
                checked = pa.array(same) if parity else pa.nulls(b - a, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size), lists, checked, pa.array(back)], names=["doc_id", "n_tokens", "ids", "same_ids", "same_text"])

    return docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).mapInArrow(run, SCHEMA)


def count(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) of each document, without the ids and the checks of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (size, *_) in encode_strings(batch.column(1), model, False):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size)], names=["doc_id", "n_tokens"])

    return docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): null ids give a null text, ids outside the model an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)[0]
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(column(encoded, "doc_id", "bigint"), column(encoded, "ids", "array<int>")).mapInArrow(run, "doc_id bigint, text string")
