"""Repeated passages by suffix arrays.

A passage of ``LEAST`` words or more (runs of bytes between ASCII white space) is repeated if it
occurs twice or more in the corpus, within one document or in several.  A run of ``LEAST`` words
is a gram; its anchor is the lowest hash among the shorter runs of ``ANCHOR`` words within it, so
equal grams have equal anchors.  Consecutive grams of a document with one anchor make a
context.  Contexts meet by anchor.  All but one of identical contexts are
repeats outright; the different contexts of an anchor (if these have more than ``SORTED_WORDS`` words, those of an anchor and
a second hash of the other shorter runs) go, as words, to one task that sorts their suffixes
in two stages: only those smaller than their successors are sorted directly, the others are
induced from these by one scan over the buckets.  Common prefixes of
adjacent suffixes then tell which grams are equal.

A result is a range of words: the union of overlapping or touching grams that are all first
occurrences of repeated passages (``first``), or all later ones.  The first is the one of the
smallest doc_id (null comes last), then text hash, then place.

Defined results: null, empty and shorter texts have no gram; rows alike in doc_id and text are one
document; rows alike in doc_id only are separate documents; texts of any length are read whole;
an empty table gives no row; ``cut`` keeps every row and column, and a text without later
occurrences, null included, unchanged; ``repeats`` ignores other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import _text
from fieldloom.llm._store import column, free, stored

LEAST = 50
ANCHOR = 8
#: Words whose suffixes are sorted at once; the contexts of one anchor stay together up to this many; see ``split``.
SORTED_WORDS = 400_000
_SECOND = np.uint64(0xD1B54A32D192ED03)


def lowest(codes: np.ndarray, width: int) -> np.ndarray:
    """Place of the first lowest code among those at p, p + 1 ... p + width - 1, for each p that has as many."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, span = np.arange(len(codes)), 1
    while span * 2 <= width:
        a, b = at[: len(at) - span], at[span:]
        at, span = np.where(codes[b] < codes[a], b, a), span * 2
    a, b = at[:n], at[width - span : width - span + n]
    return np.where(codes[b] < codes[a], b, a)


def contexts(w: _text.Words, least: int = LEAST, anchor: int = ANCHOR):
    """(document, first word, grams, anchor code, context code) of each context; words count from the document's first."""
    codes = _text.word_codes(w)
    n = len(codes) - least + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    short = _text.grams(codes, min(anchor, least))
    at = lowest(short, least - min(anchor, least) + 1)[:n]
    whole = w.doc[:n] == w.doc[least - 1 :][:n]
    new = np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (w.doc[1:n] != w.doc[: n - 1])]
    start = np.flatnonzero(new)
    stop = np.r_[start[1:], n]
    start, stop = start[whole[start]], stop[whole[start]]
    power, inverse = _text.powers(len(codes) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(codes * inverse[: len(codes)])]
    end = stop + least - 1
    own = _text.mix((sums[end] - sums[start]) * power[start] + ((end - start) * 64 + (at[start] - start)).astype(np.uint64))
    base = np.searchsorted(w.doc, w.doc[start])
    return w.doc[start], start - base, stop - start, short[at[start]], own


def split(short: np.ndarray, first: np.ndarray, grams: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, first gram in it, grams, key) of the parts of contexts: equal grams of one anchor have equal keys.

    A gram's key joins the anchor's code with the lowest second hash of its other short runs.  short: codes of
    all short runs; first: where each context's first one stands; code: of the anchors; width: short runs in a gram.
    """
    out = []
    for k, (a, n, c) in enumerate(zip(first.tolist(), grams.tolist(), code)):
        own = short[a : a + n + width - 1]
        second = np.where(own == c, np.uint64(0xFFFFFFFFFFFFFFFF), _text.mix(own ^ _SECOND))
        low = second[lowest(second, width)]
        head = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        out.append((np.full(len(head), k), head, np.diff(np.r_[head, n]), _text.mix(low[head] ^ c)))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in their order. text: integers from 0; the last one occurs nowhere else.

    Suffixes smaller than their successors are sorted directly, three symbols at a time; a
    scan over the buckets of first symbols induces the rest, which come before them in each bucket.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    step = np.zeros(n, np.int64)
    step[:-1] = np.sign(text[1:] - text[:-1])
    differs = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = np.zeros(n, bool)
    known = following < n
    smaller[known] = step[following[known]] > 0
    direct = np.flatnonzero(smaller)
    padded = np.r_[text, np.full(3, -1)] + 1
    size = np.int64(padded.max() + 1)
    pair = padded[:-2] * size + padded[1:-1]
    if size >= 1 << 21:  # three symbols take more than 63 bits, so the rank of the first two stands for them
        pair = np.unique(pair, return_inverse=True)[1] + 1
    key = pair * size + padded[2:]
    key = np.r_[key, 0]
    order = direct[np.argsort(key[direct], kind="stable")]
    group = np.cumsum(np.r_[True, key[order][1:] != key[order][:-1]]) - 1 if len(order) else np.zeros(0, np.int64)
    depth, tied = 3, np.arange(len(order))
    while True:
        same = np.zeros(len(tied), bool)
        if len(tied) > 1:
            same[1:] = group[tied[1:]] == group[tied[:-1]]
            same[:-1] |= same[1:]
        tied = tied[same]
        if not len(tied):
            break
        place, own = order[tied], group[tied]
        deep = key[np.minimum(place + depth, n)]
        rank = np.lexsort((deep, own))
        order[tied] = place[rank]
        deep, own = deep[rank], own[rank]
        fresh = np.r_[True, (own[1:] != own[:-1]) | (deep[1:] != deep[:-1])]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))
        group[tied] = tied[head]  # larger than the groups before and smaller than those behind within the tie
        group[tied] += len(order)
        group[tied] = group[tied]
        depth += 3
    counts = np.bincount(text)
    ends = np.cumsum(counts)
    first = text[order]
    inside = np.arange(len(order)) - np.searchsorted(first, first)
    many = np.bincount(first, minlength=len(counts))
    out = np.full(n, -1)
    out[ends[first] - many[first] + inside] = order
    before = np.full(n, -1)
    before[1:] = np.where(smaller[:-1], -1, text[:-1])
    fill, sa, source = (ends - counts).tolist(), out.tolist(), before.tolist()
    last = n - 1
    if not smaller[last]:  # the last suffix follows on the end of the text, which is before all else
        sa[fill[text[last]]] = last
        fill[text[last]] += 1
    for i in range(n):
        p = sa[i]
        c = source[p]
        if c >= 0:
            k = fill[c]
            sa[k] = p - 1
            fill[c] = k + 1
    return np.array(sa)


def common(text: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, ``limit`` at most; 0 for the first."""
    out = np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    padded = np.r_[text, -np.arange(1, limit + 2)]
    for k in range(limit):
        live = live[padded[sa[live] + k] == padded[sa[live - 1] + k]]
        out[live] = k + 1
    return out


def equal_grams(words: list[np.ndarray], grams: np.ndarray, least: int = LEAST) -> np.ndarray:
    """A class for each gram of the contexts in turn, equal for equal grams. words: codes of each context's words."""
    size = np.array([len(x) for x in words])
    _, dense = np.unique(np.concatenate(words), return_inverse=True)
    # each context ends in a symbol of its own, below all words
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.empty(int((size + 1).sum()), np.int64)
    marks = begin + size
    body = np.ones(len(text), bool)
    body[marks] = False
    text[body] = dense + len(words)
    text[marks] = np.arange(len(words))
    sa = suffix_array(text)
    prefix = common(text, sa, least)
    group = np.cumsum(prefix < least)
    of = np.empty(len(text), np.int64)
    of[sa] = group
    return of[np.repeat(begin - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())]


def _occurrences(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _text.string_chunks(batch.column(2)):
                doc, start, grams, code, own = contexts(_text.words(part), least, anchor)
                at = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(grams.astype(np.int32)), pa.array(code.view(np.int64)), pa.array(own.view(np.int64))], names=["doc_id", "text_hash", "start", "grams", "anchor", "context"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id bigint, text_hash bigint, start int, grams int, anchor bigint, context bigint")


def _sources(docs: DataFrame) -> DataFrame:
    text = column(docs, "text", "string")
    return docs.select(column(docs, "doc_id", "bigint"), text).filter("text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))


def _keys(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def ranges(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, start, stop, first): see above; start and stop count words."""
    source = _sources(docs)
    every = stored(_occurrences(source, least, anchor), "occurrences")
    place = [F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start"]
    # hot anchors and contexts are aggregated before they are shuffled, and the joins back, each written, may split a hot key's rows
    spot = F.xxhash64(*place)
    alike = every.groupBy("anchor").agg((F.min("context") != F.max("context")).alias("mixed"), (F.min(spot) != F.max(spot)).alias("again"), (F.sum(F.col("grams").cast("bigint") + least - 1) > SORTED_WORDS).alias("large"))
    every = stored(every.join(alike.filter("again"), "anchor").drop("again"), "anchors")
    kinds = every.groupBy("anchor", "context").agg(F.min(F.struct(*place)).alias("lead"), F.max(F.struct(*place)).alias("last"))
    kinds = kinds.select("anchor", "context", "lead", F.when(F.col("lead") == F.col("last"), 1).otherwise(2).alias("copies"))
    met = every.join(kinds, ["anchor", "context"]).filter("mixed OR copies > 1")
    leads = F.col("lead.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("lead.text_hash") == F.col("text_hash")) & (F.col("lead.start") == F.col("start"))
    met = stored(met.select("doc_id", "text_hash", "start", "grams", "anchor", "copies", "mixed", "large", leads.alias("first")), "contexts")
    plain = met.filter("NOT (mixed AND first)").select("doc_id", "text_hash", "start", "grams", "first")
    open_ = met.filter("mixed AND first").distinct()
    wanted = open_.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "grams", "anchor", "copies", "large")).alias("wanted"))
    cut = source.join(wanted, _keys(source, wanted)).select(source["doc_id"], source["text_hash"], "text", "wanted")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _text.string_chunks(batch.column(2)):
                lists = batch.column(3).slice(a, b - a)
                flat = lists.flatten()
                large = flat.field(4).to_numpy(zero_copy_only=False)
                w = _text.words(part, codes=bool(large.any()))
                doc = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
                start, grams = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                base = np.searchsorted(w.doc, doc) + start
                code, whole = flat.field(2).to_numpy(), np.arange(len(flat))
                if large.any():
                    few = min(anchor, least)
                    which = np.flatnonzero(large)
                    of, inner, size, key = split(_text.grams(_text.word_codes(w), few), base[which], grams[which], code[which].view(np.uint64), least - few + 1)
                    rest = np.flatnonzero(~large)
                    whole = np.r_[rest, which[of]]
                    code, grams = np.r_[code[rest], key.view(np.int64)], np.r_[grams[rest], size]
                    start, base = (np.r_[x[rest], x[which[of]] + inner] for x in (start, base))
                    doc = doc[whole]
                first, last = w.starts[base], w.ends[base + grams + least - 2]
                texts = pa.array([w.data[x:y].tobytes() for x, y in zip(first.tolist(), last.tolist())], pa.binary()).cast(pa.string())
                at = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(grams.astype(np.int32)), flat.field(3).take(pa.array(whole)), texts], names=["anchor", "doc_id", "text_hash", "start", "grams", "copies", "words"])

    sliced = cut.mapInArrow(slices, "anchor bigint, doc_id bigint, text_hash bigint, start int, grams int, copies int, words string")
    sliced = sliced.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").isNull(), "doc_id", "text_hash", "start")

    def resolve(t: pa.Table) -> pa.RecordBatch | None:
        """Runs of repeated grams in the contexts of whole anchors, sorted by anchor and place."""
        anchors = t["anchor"].to_numpy()
        ids, hashes, start = t["doc_id"].fill_null(-1).to_numpy(), t["text_hash"].to_numpy(), t["start"].to_numpy()
        fresh = np.r_[True, (anchors[1:] != anchors[:-1]) | (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (start[1:] != start[:-1])]
        if not fresh.all():
            t = t.filter(pa.array(fresh))
            start = t["start"].to_numpy()
        grams, copies = t["grams"].to_numpy().astype(np.int64), t["copies"].to_numpy()
        w = _text.words(t["words"].combine_chunks().cast(pa.large_string()))
        codes = _text.word_codes(w)
        words = np.split(codes, np.flatnonzero(w.doc[1:] != w.doc[:-1]) + 1)
        of = equal_grams(words, grams, least)
        owner = np.repeat(np.arange(len(grams)), grams)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
        # contexts stand in the order of their places, so the first of equal grams is the first here
        seen, lead, times = np.unique(of, return_index=True, return_counts=True)
        which = np.searchsorted(seen, of)
        kind = np.where(lead[which] == np.arange(len(of)), np.where((times[which] > 1) | (copies[owner] > 1), 1, 0), 2)
        new = np.r_[True, (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1])]
        head = np.flatnonzero(new)
        length = np.diff(np.r_[head, len(kind)])
        keep = kind[head] > 0
        head, length = head[keep], length[keep]
        at = pa.array(owner[head])
        return pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(at), t["text_hash"].combine_chunks().take(at), pa.array((start[owner[head]] + inner[head]).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(kind[head] == 1)], names=["doc_id", "text_hash", "start", "grams", "first"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(np.sum(batch.column(4).to_numpy(zero_copy_only=False))) + len(batch) * least
            if size < SORTED_WORDS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            anchors = t["anchor"].to_numpy()
            whole = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
            if whole:
                cuts, done = np.cumsum(t["grams"].to_numpy() + least), 0
                while done < whole:
                    to = int(np.searchsorted(cuts, (cuts[done - 1] if done else 0) + SORTED_WORDS))
                    to = whole if to >= whole else int(np.searchsorted(anchors, anchors[to], "left"))
                    to = max(to, int(np.searchsorted(anchors, anchors[done], "right")))
                    yield resolve(t.slice(done, to - done).combine_chunks())
                    done = to
            t = t.slice(whole)
            held, size = t.to_batches(), int(np.sum(t["grams"].to_numpy())) + len(t) * least
        if held and sum(map(len, held)):
            yield resolve(pa.Table.from_batches(held).combine_chunks())

    sorted_ = sliced.mapInArrow(sort, "doc_id bigint, text_hash bigint, start int, grams int, first boolean")
    both = plain.unionByName(sorted_).select("doc_id", "text_hash", "first", "start", (F.col("start") + F.col("grams") + least - 1).alias("stop"))
    by = Window.partitionBy("doc_id", "text_hash", "first").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = both.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "text_hash", "first", "island").agg(F.min("start").cast("bigint").alias("start"), F.max("stop").cast("bigint").alias("stop")).drop("island")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each range of words: (doc_id, start, stop, first)."""
    return ranges(docs, least).select("doc_id", "start", "stop", "first")


def cut(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the later occurrences of repeated passages taken out of ``text``; ``n_chars`` (if present) is kept true."""
    cut_id, cut_hash, cuts_ = free(docs, "__cut_id", "__cut_hash", "__cuts")
    found = ranges(docs, least).filter("NOT first").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts_))
    found = found.select(F.col("doc_id").alias(cut_id), F.col("text_hash").alias(cut_hash), cuts_)

    @F.pandas_udf("string")
    def without(texts, cuts):
        out = texts.copy()
        for row, spans in enumerate(cuts):
            if spans is None or not len(spans):
                continue
            w = _text.words(pa.array([texts.iloc[row]], pa.large_string()), codes=False)
            pieces, at = [], 0
            for span in spans:
                pieces.append(w.data[at : w.starts[span["start"]]].tobytes())
                at = w.starts[span["stop"]] if span["stop"] < len(w.starts) else len(w.data)
            out.iloc[row] = (b"".join(pieces) + w.data[at:].tobytes()).decode()
        return out

    text = F.col("text").cast("string")
    joined = docs.join(found, F.col("doc_id").cast("bigint").eqNullSafe(F.col(cut_id)) & (F.xxhash64(text) == F.col(cut_hash)), "left")
    new = F.when(F.col(cuts_).isNotNull(), without(text, F.col(cuts_))).otherwise(text)
    out = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL for ``repeats``: grams are compared as strings of words.
ORACLE = f"""
WITH worded AS (SELECT doc_id, regexp_extract_all(text, '[^\\t\\n\\x0b\\f\\r ]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + {LEAST}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - {LEAST} + 1)) AS p FROM worded)),
marked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth, count(*) OVER (PARTITION BY g) AS n FROM grams),
kinds AS (SELECT doc_id, p, nth = 1 AS first FROM marked WHERE n > 1),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, first ORDER BY p) AS island
  FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, first ORDER BY p) <= {LEAST} THEN 0 ELSE 1 END AS fresh FROM kinds))
SELECT doc_id, CAST(min(p) AS BIGINT) AS start, CAST(max(p) + {LEAST} AS BIGINT) AS stop, first FROM islands GROUP BY doc_id, first, island
"""
