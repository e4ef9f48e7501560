import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import sentences
from helpers import ODD, empty, frame, prose

sp = pytest.importorskip("sentencepiece")


def test_ids_equal_those_of_sentencepiece_and_decode_to_the_text(spark):
    rows = [*ODD, (7, "a  b   c "), (8, " lead"), (9, "▁ marker ▁x"), (10, prose(1, 30_000)), (11, "\U0001f600 emoji \x00 nul")]
    out = {(r.doc_id, r.n_tokens): r for r in sentences.encode(frame(spark, rows)).collect()}
    assert len(sentences.encode(frame(spark, rows)).collect()) == len(rows)
    assert all(r.same_ids for r in out.values())
    processor = sp.SentencePieceProcessor(model_file=sentences.MODEL)
    for r in out.values():
        text = dict(rows)[r.doc_id]
        if text is None:
            assert r.ids is None and r.n_tokens == 0
        else:
            assert r.ids == processor.encode(text) and r.n_tokens == len(r.ids)


def test_round_trip(spark):
    rows = [(1, "Hello wörld 日本"), (2, "a  b"), (3, None), (4, "")]
    encoded = sentences.encode(frame(spark, rows))
    assert sorted(map(tuple, sentences.decode(encoded).collect()), key=lambda r: r[0]) == rows


def test_empty_table(spark):
    encoded = sentences.encode(empty(spark))
    assert encoded.count() == 0 and sentences.decode(encoded).count() == 0


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def piece(text, score, kind=1):
    return field(1, field(1, text.encode()) + _varint(2 << 3 | 5) + np.float32(score).tobytes() + field(3, kind))


BYTES = b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))


def test_unigram_model_with_normaliser_and_byte_fallback():
    """A model written by hand: the protobuf is read, scores decide, unknown bytes fall back."""
    data = piece("<unk>", 0, 2) + piece("▁a", -1) + piece("b", -2) + piece("▁ab", -2.5) + piece("▁", -4) + piece("a", -3) + BYTES
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(3, 1) + field(4, 1) + field(5, 1))
    model = sentences.read(data)
    assert model.kind == sentences.UNIGRAM and model.byte_fallback and model.collapse
    own, other = sentences.Codec(data), sp.SentencePieceProcessor(model_proto=data)
    texts = ["ab", "a b", "abab  a", "é", " b ", "ba"]
    assert own.encode(texts) == [other.encode(t) for t in texts]
    assert own.decode(own.encode(["ab é"])[0]) == "ab é"


def _documents():
    import pyarrow.parquet as pq

    return [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]


def _unigram():
    """Thousands of pieces with scores by their frequency in the tables, and the library's own character map."""
    from collections import Counter

    counts = Counter()
    for text in _documents():
        for word in text.split():
            word = "▁" + word
            counts.update(word[a : a + n] for n in range(1, 9) for a in range(len(word) - n + 1))
    total = sum(counts.values())
    charsmap = next(v for n, v in sentences.fields(next(v for n, v in sentences.fields(sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()) if n == 3)) if n == 2)
    pieces = [(p, float(np.log(c / total)) - 1e-4 * k) for k, (p, c) in enumerate(counts.most_common(6000))]
    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + BYTES + b"".join(piece(p, s) for p, s in pieces)
    return data + field(2, field(3, 1) + field(35, 1)) + field(3, field(2, charsmap) + field(3, 1) + field(4, 1) + field(5, 1))


ODD_CHARACTERS = ["ﬁne Ⅳ ｆｕｌｌ　width", "  many   spaces\tand\nlines  ", "①②③ ㌔ ½", "e\u0301 \u00e9 \u1e9b\u0323", "zero\u200bwidth\u00adsoft", "日本語 한국어 \U0001f600", "", " ", "\u00a0", "x\u0007y", "ÅΩ ﷺ"]


def test_real_unigram_model_with_character_map(spark, tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(_unigram())
    long = _documents()
    texts = [*ODD_CHARACTERS, *(line for t in long for line in t.split("."))]
    other = sp.SentencePieceProcessor(model_file=str(path))
    got = {r.doc_id: r for r in sentences.encode(frame(spark, list(enumerate(texts + long))), str(path)).collect()}
    for k, text in enumerate(texts):
        assert got[k].ids == other.encode(text) and got[k].same_ids and got[k].same_text, text[:80]
    # the library sums a whole text's scores in 32 bits, so in a long one it may take the second best: that is told
    for k, text in enumerate(long, len(texts)):
        assert got[k].same_ids == (got[k].ids == other.encode(text)) and got[k].same_text
    assert sum(got[k].same_ids for k in range(len(texts), len(got))) > 0.9 * len(long)


def test_parity_is_that_of_whole_texts(monkeypatch):
    """A library that disagrees on a whole text is found out, however its units are encoded."""
    texts = pa.array([" ", "a b", "a  b "], pa.large_string())
    own, other, units = sentences.codec(sentences.MODEL)
    size, flat, _ = units.texts(texts)
    assert sentences.same_ids(other, texts, size, flat).all()

    class Other:
        def encode(self, texts, num_threads):
            return [[*other.encode(t), 5] if t.isspace() else other.encode(t) for t in texts]

    assert sentences.same_ids(Other(), texts, size, flat).tolist() == [False, True, True]
    assert sentences.same_ids(other, texts, size, np.where(np.arange(len(flat)) == len(flat) - 1, 7, flat)).tolist() == [True, True, False]


def test_bytes_that_are_no_model():
    with pytest.raises(Exception):
        sentences.read(b"\x0f\xff\xff")


def test_units_are_forgotten_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(sentences, "REMEMBERED", 50)
    sentences._codecs.clear()
    texts = pa.array([prose(k, 40) for k in range(20)], pa.large_string())
    got = [(a, b, parts) for a, b, parts in sentences.encode_strings(texts, sentences.MODEL, True)]
    assert sum(b - a for a, b, _ in got) == 20 and all(p[2].all() for _, _, p in got)
    sentences._codecs.clear()
