import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from fieldloom.llm import sentences

ROOT = Path(__file__).resolve().parents[2]
#: Counts texts of 6 MB in all whose words are distinct, as a worker does, and prints the MB that takes at most.
RUN = """
import re
from pathlib import Path
import pyarrow as pa
from fieldloom.llm import sentences

def most():
    return int(re.search(r"VmHWM:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

sentences.codec(sentences.MODEL)
texts = pa.array([" ".join(f"{k * 7919:x}q{i}" for i in range(300)) for k in range(2000)])
before = most()
assert sum(len(size) for _, _, (size, *_) in sentences.encode_strings(texts, sentences.MODEL, False)) == 2000
print(most() - before)
"""


def test_memory_of_many_distinct_words():
    out = subprocess.run([sys.executable, "-c", RUN], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True).stdout
    assert float(out) < 330


def test_units_are_encoded_a_part_at_a_time(monkeypatch):
    processor = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentences.MODEL)
    monkeypatch.setattr(sentences, "UNITS", 7)
    asked, whole = [], sentences.Codec.encode
    monkeypatch.setattr(sentences.Codec, "encode", lambda own, texts: asked.append(len(texts)) or whole(own, texts))
    texts = [" ".join(f"w{k * i}" for i in range(40)) + "  end " * (k % 2) for k in range(9)] + ["", " ", "日本語 text"]
    sentences._codecs.clear()
    try:
        ((_, _, (size, flat, same, _)),) = sentences.encode_strings(pa.array(texts), sentences.MODEL, True)
    finally:
        sentences._codecs.clear()
    want = [processor.encode(t) for t in texts]
    assert size.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x] and same.all()
    assert max(asked) == 7
