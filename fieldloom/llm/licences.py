"""Licence scan: Dice coefficient over word bigrams between normalised text and licence templates.

Text is lower-cased (ASCII) and everything but ASCII letters and digits separates words.  The
units compared are each line, each paragraph (between blank lines) and the whole text; a unit
and a template match if 2|A & B| / (|A| + |B|) over their sets of word bigrams reaches
``THRESHOLD``.  A unit whose size is outside [t/(2-t), (2-t)/t] times the template's can't
reach t, so such templates are never compared.

Whatever the layout, runs of words that overlap no unit matched for any licence are compared as
well: from every word, those of all lengths up to (2-t)/t times the template's.  Of the best
run from each word, those at the threshold are taken, the highest Dice first (then the
earliest, then the shortest), if they overlap none taken before.

Defined results: null, empty and one-word texts and empty tables give no row; a null ``doc_id``
is carried as null; repeated rows are each reported; ties between templates give a row each;
columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm import _text
from fieldloom.llm._store import column

THRESHOLD = 0.8
SCHEMA = "doc_id bigint, licence string, dice double, units bigint"
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY "
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the "
    "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
    "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_CONDITIONS),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_CONDITIONS + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", _ISC),
    ("GPL-3.0", _GPL),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is free software, licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Whole texts of the longer licences, a file each.
_TEXTS = tuple((path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
#: (licence, template text): notices, short licences and whole texts. A licence may have several templates.
TEMPLATES: tuple[tuple[str, str], ...] = _NOTICES + _TEXTS
_BREAKS = ~np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def bigrams(text: str) -> set[tuple[str, str]]:
    w = re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return set(zip(w, w[1:]))


def _templates(templates) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all template bigrams in order, for each the templates that hold it (a flat list with bounds), and the templates' sizes."""
    holders: dict[int, list[int]] = {}
    sizes = np.zeros(len(templates), np.int64)
    for t, (_, text) in enumerate(templates):
        w = _text.words(pa.array([text], pa.large_string()), _BREAKS, fold=True)
        codes = np.unique(_text.grams(_text.word_codes(w), 2))
        sizes[t] = len(codes)
        for c in codes.tolist():
            holders.setdefault(c, []).append(t)
    codes = np.array(sorted(holders), np.uint64)
    bounds = np.cumsum([0] + [len(holders[int(c)]) for c in codes])
    return codes, bounds, np.array([t for c in codes.tolist() for t in holders[c]], np.int64), sizes


def _matches(unit: np.ndarray, pairs: np.ndarray, codes, bounds, flat, sizes, threshold: float):
    """Units and templates with Dice at or above the threshold. unit: of each bigram."""
    key = np.lexsort((pairs, unit))
    unit, pairs = unit[key], pairs[key]
    fresh = np.r_[True, (unit[1:] != unit[:-1]) | (pairs[1:] != pairs[:-1])]
    unit, pairs = unit[fresh], pairs[fresh]
    size = np.bincount(unit)
    at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
    hit = codes[at] == pairs
    unit, at = unit[hit], at[hit]
    n = bounds[at + 1] - bounds[at]
    which = np.repeat(bounds[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    unit, template = np.repeat(unit, n), flat[which]
    a, b, t = size[unit], sizes[template], threshold
    fits = (a * (2 - t) >= b * t - 1e-9) & (a * t <= b * (2 - t) + 1e-9)
    joint, shared = np.unique(unit[fits] * len(sizes) + template[fits], return_counts=True)
    unit, template = joint // len(sizes), joint % len(sizes)
    dice = 2 * shared / (size[unit] + sizes[template])
    good = dice >= threshold
    return unit[good], template[good], dice[good]


def _best_runs(pairs: np.ndarray, held: np.ndarray, free: np.ndarray, size: int, least: int, most: int, threshold: float):
    """(first bigram, number of bigrams, Dice) of the best run from each place, where it reaches the threshold.

    held: which bigrams the template has; free: those that a run may hold.
    """
    n = len(pairs)
    order = np.argsort(pairs, kind="stable")
    again = np.full(n, 2 * n + most)  # where each bigram stands next
    equal = pairs[order][1:] == pairs[order][:-1]
    again[order[:-1][equal]] = order[1:][equal]
    closed = np.r_[0, np.cumsum(~free)]
    place = np.arange(n)
    best, length = np.zeros(n), np.zeros(n, np.int64)
    for k in range(least, min(most, n) + 1):
        # a bigram counts in the runs of which it is the last of its kind
        low, high = np.maximum(place - k + 1, 0), np.minimum(place, again - k) + 1
        counts = high > low
        every, ours = (np.cumsum(np.bincount(low[c], minlength=n + 1) - np.bincount(high[c], minlength=n + 1))[: n - k + 1] for c in (counts, counts & held))
        dice = np.where(closed[k:] == closed[: n - k + 1], 2 * ours / (every + size), 0.0)
        better = np.flatnonzero(dice > best[: n - k + 1])
        best[better], length[better] = dice[better], k
    good = np.flatnonzero(best >= threshold)
    return good, length[good], best[good]


def _runs(same: np.ndarray, doc: np.ndarray, pairs: np.ndarray, table, templates, threshold: float, found: dict) -> None:
    """Adds to ``found`` the runs of words, in no range that it has, that match a template."""
    codes, bounds, flat, sizes = table
    at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
    hit = np.flatnonzero((codes[at] == pairs) & same)
    at = at[hit]
    n = bounds[at + 1] - bounds[at]
    which = flat[np.repeat(bounds[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
    place = np.repeat(hit, n)
    marks = np.zeros(len(doc) + 1, np.int64)
    for spans in found.values():
        for a, b in spans:
            marks[a] += 1
            marks[b + 1] -= 1
    taken = np.cumsum(marks) > 0
    runs: dict[tuple[int, str], list[tuple[float, int, int]]] = {}
    for t in np.unique(which).tolist():
        licence, b = templates[t][0], int(sizes[t])
        least = max(1, int(np.ceil(b * threshold / (2 - threshold) - 1e-9)))
        most = int((len(re.findall("[a-z0-9]+", templates[t][1].lower())) - 1) * (2 - threshold) / threshold + 1e-9)
        p = place[which == t]
        p = p[~(taken[p] | taken[p + 1])]
        if len(p) < least:
            continue
        own = np.unique(pairs[p])
        first, last = p[: len(p) - least + 1], p[least - 1 :]
        near = (last - first < most) & (doc[first] == doc[last])
        first, last = first[near], last[near]
        if not len(first):
            continue
        low = np.maximum(last - most + 1, np.searchsorted(doc, doc[first]))
        high = np.minimum(first + most, np.searchsorted(doc, doc[first], "right") - 1)
        new = np.flatnonzero(np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1]])
        for x, y in zip(low[new].tolist(), np.maximum.reduceat(high, new).tolist()):
            free = ~(taken[x:y] | taken[x + 1 : y + 1])
            begin, length, dice = _best_runs(pairs[x:y], np.isin(pairs[x:y], own), free, b, least, most, threshold)
            runs.setdefault((int(doc[x]), licence), []).extend(zip((-dice).tolist(), (begin + x).tolist(), length.tolist()))
    for key, candidates in runs.items():
        if not candidates:
            continue
        spans = found.setdefault(key, {})
        first = min(a for _, a, _ in candidates)
        used = np.zeros(max(a + k for _, a, k in candidates) - first + 1, bool)
        for minus, a, k in sorted(candidates):
            if not used[a - first : a - first + k + 1].any():
                used[a - first : a - first + k + 1] = True
                spans[a, a + k] = -minus


def find(texts: pa.Array, templates=TEMPLATES, threshold: float = THRESHOLD) -> Iterator[tuple[int, str, float, int]]:
    """(row, licence, highest Dice, number of distinct ranges of words that match) for each text and licence."""
    table = _templates(templates)
    for first, _, part in _text.string_chunks(texts):
        w = _text.words(part, _BREAKS, fold=True)
        if len(w.starts) < 2:
            continue
        newline = np.flatnonzero(w.data == 10)
        blank = newline[1:][np.diff(newline) == 1]
        pairs = _text.grams(_text.word_codes(w), 2)
        found: dict[tuple[int, str], dict[tuple[int, int], float]] = {}
        same = w.doc[1:] == w.doc[:-1]
        for breaks in (newline, blank, np.zeros(0, np.int64)):
            block = np.searchsorted(breaks, w.starts)
            if not len(pairs):
                continue
            new = np.r_[True, ~same | (block[1:] != block[:-1])]
            unit = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            tail = np.r_[head[1:], len(new)] - 1
            inside = unit[1:] == unit[:-1]
            if not inside.any():
                continue
            for u, t, d in zip(*(x.tolist() for x in _matches(unit[:-1][inside], pairs[inside], *table, threshold))):
                spans = found.setdefault((int(w.doc[head[u]]), templates[t][0]), {})
                where = (int(head[u]), int(tail[u]))
                spans[where] = max(d, spans.get(where, 0.0))
        if len(pairs):
            _runs(same, w.doc, pairs, table, templates, threshold, found)
        for (row, licence), spans in sorted(found.items()):
            yield first + row, licence, max(spans.values()), len(spans)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and licence found in it: the highest Dice and the number of word ranges that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(find(batch.column(1), templates, threshold))
            columns = [list(c) for c in zip(*found)] or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())],
                names=["doc_id", "licence", "dice", "units"],
            )

    return docs.select(column(docs, "doc_id", "bigint"), column(docs, "text", "string")).mapInArrow(run, SCHEMA)


def _bigram_sql(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, " ".join(re.findall("[a-z0-9]+", text.lower()))) for i, (name, text) in enumerate(TEMPLATES))
#: DuckDB SQL for ``scan``. Ranges of words are told apart by the unit's normalised text and its count of earlier words.
ORACLE = f"""
WITH templates AS (SELECT t, licence, string_split(body, ' ') AS w FROM (VALUES {_VALUES}) AS v(t, licence, body)),
tb AS (SELECT t, licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM templates),
cut AS (
  SELECT doc_id, 0 AS how, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT doc_id, 1, regexp_split_to_array(text, chr(10) || '(' || chr(10) || ')+') FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT doc_id, 2, [text] FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, how, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM cut),
worded AS (SELECT doc_id, how, k, regexp_extract_all(lower(part), '[a-z0-9]+') AS w FROM numbered),
placed AS (SELECT doc_id, how, w, sum(len(w)) OVER (PARTITION BY doc_id, how ORDER BY k) - len(w) AS first FROM worded),
units AS (SELECT doc_id, first, len(w) AS n, any_value(w) AS w FROM placed WHERE len(w) > 1 GROUP BY doc_id, first, len(w)),
ub AS (SELECT doc_id, first, n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM units),
scored AS (
  SELECT doc_id, licence, first, n, 2.0 * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b)) AS dice
  FROM ub, tb WHERE len(ub.b) * {2 - THRESHOLD} >= len(tb.b) * {THRESHOLD} - 1e-9 AND len(ub.b) * {THRESHOLD} <= len(tb.b) * {2 - THRESHOLD} + 1e-9)
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(DISTINCT (first, n)) AS units
FROM scored WHERE dice >= {THRESHOLD} GROUP BY doc_id, licence
"""
