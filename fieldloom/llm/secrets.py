"""Secret scan: sliding-window Shannon entropy per character class over candidate strings.

A candidate is a maximal run of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9+/=_-]``.
Its class is ``hex``, ``alnum`` or ``base64``; a window of ``WINDOW`` characters slides over
it, its character counts updated by the one that enters and the one that leaves, and the
candidate is a secret if one window that mixes the kinds of characters its class demands
reaches the entropy of the class.

A candidate that is none, or that the allow-list matches somewhere, is split at ``=``, then at ``-`` and
``_``, then at ``+`` and ``/``, and its parts of ``MIN_LENGTH`` or more are judged likewise, each by its own
class.  Parts that a match of the allow-list touches are never reported.

Defined results: a null or empty text and an empty table give no row; a null ``doc_id`` is
carried as null; repeated rows are each reported; texts of any length are scanned whole;
columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text
from fieldloom.llm._store import column

MIN_LENGTH = 20
WINDOW = 20
#: Bits a character. A window of 20 characters reaches 4.32 at most, 4.0 with 16 symbols.
THRESHOLDS = {"hex": 2.55, "alnum": 3.45, "base64": 3.75}
#: Searched in a candidate and its parts; a hit suppresses the part that it touches.
ALLOW = (
    r"(?i)example", r"(?i)placeholder", r"(?i)your[-_]?(api|key|token|secret)", r"(?i)changeme", r"(?i)dummy", r"(?i)redacted",
    r"(?i)0123456789abcdef", r"(?i)abcdefghijklmnop", r"(?i)x{8,}", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
SCHEMA = "doc_id bigint, start bigint, stop bigint, kind string, entropy double, secret string"
MARK = "[SECRET]"
_ALPHABET = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/=_-") for b in range(256)])
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_ALNUM = re.compile(r"[0-9A-Za-z]+\Z")
_SPLITS = (re.compile("[^=]+"), re.compile("[^=_-]+"), re.compile("[^=_+/-]+"))
_NLOGN = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # a character enters before another leaves


def kind_of(candidate: str) -> str:
    return "hex" if _HEX.match(candidate) else "alnum" if _ALNUM.match(candidate) else "base64"


def window_entropy(candidate: str, mixed: int) -> float:
    """The highest entropy of a window with a digit and, of upper and lower case, at least ``mixed``; -1 without one."""
    counts: dict[str, int] = {}
    kinds = [0, 0, 0]
    total, best = 0.0, -1.0
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        k = 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else -1
        if k >= 0:
            kinds[k] += 1
        if i >= WINDOW:
            o = candidate[i - WINDOW]
            n = counts[o]
            total += _NLOGN[n - 1] - _NLOGN[n]
            counts[o] = n - 1
            k = 0 if o.isdigit() else 1 if o.islower() else 2 if o.isupper() else -1
            if k >= 0:
                kinds[k] -= 1
        if i >= WINDOW - 1 and kinds[0] and (kinds[1] > 0) + (kinds[2] > 0) >= mixed:
            best = max(best, math.log2(WINDOW) - total / WINDOW)
    return best


def judge(candidate: str, allow: list[re.Pattern]) -> list[tuple[int, int, str, float]]:
    """(first character, character after the last, kind, entropy) of each secret in a candidate, in order."""
    out: list[tuple[int, int, str, float]] = []

    def part(first: int, stop: int, level: int, hits: list[tuple[int, int]], judged: bool = False) -> None:
        text = candidate[first:stop]
        if not judged:
            hits = hits + [(first + m.start(), first + m.end()) for a in allow for m in a.finditer(text)]
        if not judged and not any(x < stop and y > first for x, y in hits):
            kind = kind_of(text)
            entropy = window_entropy(text, 2 if kind == "base64" else 1)
            if entropy >= THRESHOLDS[kind]:
                out.append((first, stop, kind, entropy))
                return
        if level == len(_SPLITS):
            return
        for m in _SPLITS[level].finditer(text):
            if m.end() - m.start() >= MIN_LENGTH:
                part(first + m.start(), first + m.end(), level + 1, hits, m.end() - m.start() == stop - first)

    part(0, len(candidate), 0, [])
    return out


def find(texts: pa.Array, allow: tuple[str, ...] = ALLOW) -> Iterator[tuple[int, int, int, str, float, str]]:
    """(row, first character, character after the last, kind, entropy, secret) of each secret."""
    patterns = [re.compile(a) for a in allow]
    for first, _, part in _text.string_chunks(texts):
        data, offsets = _text.raw(part)
        starts, ends = _text.runs(_ALPHABET[data], offsets)
        long = ends - starts >= MIN_LENGTH
        starts, ends = starts[long], ends[long]
        rows = np.searchsorted(offsets, starts, "right") - 1
        for row, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist()):
            candidate = data[a:b].tobytes().decode("ascii")
            if found := judge(candidate, patterns):
                before = data[offsets[row] : a]
                at = int(np.count_nonzero((before & 0xC0) != 0x80))
                for x, y, kind, entropy in found:
                    yield first + row, at + x, at + y, kind, entropy, candidate[x:y]


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row for each secret: character range, class, highest window entropy and the string itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            found = list(find(batch.column(1), allow))
            rows = pa.array([f[0] for f in found], pa.int64())
            columns = [list(c) for c in zip(*(f[1:] for f in found))] or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(rows), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "start", "stop", "kind", "entropy", "secret"])

    return docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``MARK`` and ``n_chars`` (if present) kept true.

    All columns and rows stay; a text without a secret, null included, is unchanged.
    """

    @F.pandas_udf("string")
    def cleaned(texts):
        out = texts.copy()
        spans: dict[int, list[tuple[int, int]]] = {}
        for row, a, b, *_ in find(pa.Array.from_pandas(texts, type=pa.large_string()), allow):
            spans.setdefault(row, []).append((a, b))
        for row, cuts in spans.items():
            text, pieces, at = texts.iloc[row], [], 0
            for a, b in cuts:
                pieces += [text[at:a], MARK]
                at = b
            out.iloc[row] = "".join(pieces) + text[at:]
        return out

    text = F.col("text").cast("string")
    out = docs.withColumn("text", cleaned(text))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


#: DuckDB SQL for ``scan``: every separator is one character, so running lengths give the positions.
ORACLE = f"""
WITH parts AS (
  SELECT doc_id, text, unnest(regexp_split_to_array(text, '[^A-Za-z0-9+/=_-]')) AS part,
         generate_subscripts(regexp_split_to_array(text, '[^A-Za-z0-9+/=_-]'), 1) AS k
  FROM documents),
placed AS (
  SELECT doc_id, part, k, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts),
candidates AS (
  SELECT row_number() OVER () AS c, doc_id, start, part,
         CASE WHEN regexp_full_match(part, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(part, '[0-9A-Za-z]+') THEN 'alnum' ELSE 'base64' END AS kind
  FROM placed WHERE length(part) >= {MIN_LENGTH}
    AND NOT ({' OR '.join(f"regexp_matches(part, '{a}')" for a in ALLOW)})),
windows AS (SELECT c, kind, w, substr(part, w, {WINDOW}) AS s FROM (SELECT *, unnest(range(1, length(part) - {WINDOW} + 2)) AS w FROM candidates)),
mixed AS (SELECT * FROM windows WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')
          AND (kind <> 'base64' OR (regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]')))),
letters AS (SELECT c, w, ch, count(*) AS n FROM (SELECT c, w, unnest(string_split(s, '')) AS ch FROM mixed) GROUP BY ALL),
entropies AS (SELECT c, w, -sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)) AS e FROM letters GROUP BY ALL),
best AS (SELECT c, max(e) AS e FROM entropies GROUP BY c)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(part) AS BIGINT) AS stop, kind, round(e, 4) AS entropy, part AS secret
FROM candidates JOIN best USING (c)
WHERE e >= CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items())} END
"""
