"""Near-duplicate documents by BagMinHash signatures of their word shingles.

A document is the multiset of its runs of ``SHINGLE`` words (ASCII case and punctuation do not
count), the weight of a shingle being how often it occurs.  For every shingle the weights are
cut into the dyadic ranges (0, 1], (1, 2], (2, 4] ..., each the source of a Poisson process of
the range's rate; a point splits down the range to one unit of weight and counts if the
document's weight covers it.  Points come in ascending order and draw a register each, which keeps
the lowest; a process ends once it has passed the highest register.  Equal registers of two
documents are an unbiased estimate of their weighted Jaccard similarity.

Documents of equal multisets are one class from here on.  Signatures are cut into bands; in
a bucket of equal bands each class is compared with the smallest, by the multisets themselves.
Where that comparison fails, the class is compared with all others of the bucket, but for those
that the triangle inequality of the Jaccard distance excludes.  So every pair of a bucket that
reaches ``THRESHOLD`` ends in one group; groups are the connected parts.

Defined results: a document of fewer than ``SHINGLE`` words has one shingle, all its words;
null, empty and wordless texts are in no group; repeated rows are copies of each other; a null
``doc_id`` is a member like any other and never the keeper of a group that has another id; a
pair at the threshold is similar; an empty table gives no row; other columns are kept by
``keep_one`` and ignored by ``groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import _text
from fieldloom.llm._store import column, discard, free, stored

SHINGLE = 3
BANDS, ROWS = 32, 4
THRESHOLD = 0.5
_SEPARATORS = _text.SPACE | _text.PUNCT
_U = np.uint64


def shingles(w: _text.Words, n_docs: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of the distinct shingles of each document, sorted."""
    codes = _text.word_codes(w)
    n = np.bincount(w.doc, minlength=n_docs)
    parts, docs = [], []
    if len(codes) >= size:
        whole = w.doc[: len(codes) - size + 1] == w.doc[size - 1 :]
        parts.append(_text.grams(codes, size)[whole])
        docs.append(w.doc[: len(whole)][whole])
    base = np.cumsum(n) - n
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            code = np.zeros(len(short), np.uint64)
            for j in range(k):
                code = code * _text._BASE + codes[base[short] + j]
            parts.append(_text.mix(code + _U(k)))
            docs.append(short)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])
    return doc[head], code[head], np.diff(np.r_[head, len(code)])


def classes(doc: np.ndarray, code: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """A code of each document's multiset, 0 for the empty one."""
    out = np.zeros(n_docs, np.uint64)
    if len(doc):
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        term = _text.mix(code ^ _text.mix(count.astype(np.uint64)))
        out[doc[head]] = np.maximum(_text.mix(np.add.reduceat(term, head)), _U(1))
    return out


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(doc: np.ndarray, code: np.ndarray, count: np.ndarray, n_docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Registers by document, as the codes of the points that hold them; rows of empty documents are 0."""
    level = np.ceil(np.log2(count)).astype(np.int64)  # ranges needed besides the first
    owner = np.repeat(np.arange(len(doc)), level + 1)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    pdoc, weight = doc[owner], count[owner]
    rate = np.where(k > 0, np.exp2(np.maximum(k - 1, 0)), 1.0)
    low = np.where(k > 0, np.exp2(np.maximum(k - 1, 0)), 0.0)  # the range is (low, low + rate]
    seed = _text.mix(code[owner] + k.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    at = np.zeros(len(seed))
    value = np.full((n_docs, size), np.inf)
    holder = np.zeros((n_docs, size), np.uint64)
    flat_value, flat_holder, highest = value.ravel(), holder.ravel(), np.full(n_docs, np.inf)
    while len(seed):
        seed = _text.mix(seed + _U(0x9E3779B97F4A7C15))
        at = at - np.log(_uniform(seed)) / rate
        live = at < highest[pdoc]
        draw = _text.mix(seed ^ _U(0xA0761D6478BD642F))
        # the point's unit of weight, by halving the range down to it
        unit = low + np.floor(_uniform(_text.mix(draw)) * rate) + 1
        hit = np.flatnonzero((unit <= weight) & live)
        if len(hit):
            register = pdoc[hit] * size + (draw[hit] % _U(size)).astype(np.int64)
            np.minimum.at(flat_value, register, at[hit])
            holds = at[hit] == flat_value[register]
            flat_holder[register[holds]] = draw[hit][holds]
        highest = value.max(1)
        live = at < highest[pdoc]
        seed, at, pdoc, weight, rate, low = (a[live] for a in (seed, at, pdoc, weight, rate, low))
    return holder


def bands(holder: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A code for each band of each document."""
    code = np.zeros((len(holder), holder.shape[1] // rows), np.uint64)
    for r in range(rows):
        code = _text.mix(code + holder[:, r::rows])
    return _text.mix(code + np.arange(code.shape[1], dtype=np.uint64))


def _signed(df: DataFrame) -> DataFrame:
    """(doc_id, class, bands) of the documents that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _text.string_chunks(batch.column(1), 1 << 20):
                n = b - a
                w = _text.words(part, _SEPARATORS, fold=True)
                triple = shingles(w, n)
                own = classes(*triple, n)
                code = bands(signatures(*triple, n)).view(np.int64)
                full = np.flatnonzero(own)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(code[full].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n).take(pa.array(full)), pa.array(own[full].view(np.int64)), lists], names=["doc_id", "class", "bands"])

    return df.select(column(df, "doc_id", "bigint"), column(df, "text", "string")).mapInArrow(run, "doc_id bigint, class bigint, bands array<bigint>")


def _classed(df: DataFrame) -> DataFrame:
    """(class, text) of the documents that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in _text.string_chunks(batch.column(1)):
                w = _text.words(part, _SEPARATORS, fold=True)
                own = classes(*shingles(w, b - a), b - a)
                full = pa.array(np.flatnonzero(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(full), pa.array(own.view(np.int64)).take(full), part.take(full).cast(pa.string())], names=["doc_id", "class", "text"])

    return df.select(column(df, "doc_id", "bigint"), column(df, "text", "string")).mapInArrow(run, "doc_id bigint, class bigint, text string")


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each text of a and that of b."""
    sides = []
    n = len(a)
    for part in (a, b):
        sides.append(shingles(_text.words(part, _SEPARATORS, fold=True), n))
    total = sum(np.bincount(d, c, n) for d, _, c in sides)
    doc = np.concatenate([s[0] for s in sides])
    code = np.concatenate([s[1] for s in sides])
    count = np.concatenate([s[2] for s in sides])
    order = np.lexsort((code, doc))
    doc, code, count = doc[order], code[order], count[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (code[1:] == code[:-1])) if len(doc) else np.zeros(0, np.int64)
    shared = np.bincount(doc[same], np.minimum(count[same], count[same + 1]), n)
    return np.where(total > 0, shared / np.maximum(total - shared, 1), 1.0)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the distinct pairs of classes."""
    joined = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("right")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(overlap(*(part.column(k).cast(pa.large_string()) for k in (2, 3))))], names=["a", "b", "similarity"])

    return joined.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint, similarity double")


def edges(docs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): pairs of classes of at least ``threshold`` that join all that belong together."""
    single = signed.groupBy("class").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"))
    buckets = single.select("class", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "a")
    stars = stored(buckets.join(least, "bucket").filter("class <> a").select("bucket", "a", F.col("class").alias("b")), "stars")
    near = stars.select("a", "b").distinct()
    nodes = near.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    # one text for each class: its copies go before any text is moved twice
    texts = stored(_classed(docs).join(nodes, "class").groupBy("class").agg(F.min_by("text", F.struct("doc_id", F.length("text"))).alias("text")), "texts")
    checked = stored(_verified(near, texts), "checked")
    good = checked.filter(F.col("similarity") >= threshold)
    failed = checked.filter(F.col("similarity") < threshold)
    lost = stars.join(failed, ["a", "b"]).select("bucket", F.col("b").alias("x"), F.col("similarity").alias("sx"))
    others = stars.join(checked, ["a", "b"]).select("bucket", F.col("b").alias("y"), F.col("similarity").alias("sy"))
    # distance is 1 - similarity: |d(x, a) - d(y, a)| above 1 - threshold rules a pair out
    rest = lost.join(others, "bucket").filter((F.col("x") != F.col("y")) & (F.abs(F.col("sx") - F.col("sy")) <= 1 - threshold + 1e-9))
    pairs = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = _verified(pairs, texts).filter(F.col("similarity") >= threshold)
    return good.select("a", "b").unionByName(more.select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of a link is connected to.

    Each round hangs a node's larger neighbours on its smallest one, then its smaller
    neighbours likewise, until nothing moves, after about as many rounds as the logarithm of the
    longest chain; every round is a written table.
    """
    now = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("a"), F.explode(F.array_distinct(F.array("a", "b"))).alias("b")).filter("a <> b").distinct()
        before, now = now, stored(small, "links")
        discard(before)
        was, size = size, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == size:
            return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, class, group) of every document that has a word; ``group`` is a class."""
    signed = stored(_signed(docs), "signed")
    roots = components(edges(docs, signed, threshold))
    return signed.select("doc_id", "class").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("doc_id", "class", F.coalesce("root", "class").alias("group"))


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document of a group of two or more: the smallest id of its group and the group's size."""
    member = _grouped(docs, threshold).select("doc_id", "group")
    sizes = member.groupBy("group").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return member.join(sizes, "group").select("doc_id", "group_id", "group_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id; all columns stay.

    Documents in no group stay.  Of rows with that id in the group, the smallest class stays, and
    of rows that agree in both, any one.
    """
    pairs = _grouped(docs, threshold).groupBy("doc_id", "class", "group").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")
    keeper = pairs.groupBy("group").agg(F.min(rank).alias("keeper"), F.sum("n").alias("total")).filter("total > 1")
    kept = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.class") == F.col("class"))
    mark = pairs.join(keeper, "group").withColumn("state", F.when(~kept, 2).when(F.col("n") > 1, 1).otherwise(0)).filter("state > 0")
    *keys, state, nth = free(docs, "__key", "__key_id", "__key_null", "__state", "__nth")
    mark = mark.select(F.col("class").alias(keys[0]), F.coalesce("doc_id", F.lit(0)).alias(keys[1]), F.col("doc_id").isNull().alias(keys[2]), F.col("state").alias(state))

    @F.arrow_udf("bigint")
    def class_of(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.uint64)
        for a, b, part in _text.string_chunks(texts):
            out[a:b] = classes(*shingles(_text.words(part, _SEPARATORS, fold=True), b - a), b - a)
        return pa.array(out.view(np.int64))

    id_ = F.col("doc_id").cast("bigint")
    own = docs.withColumns({keys[0]: class_of(F.col("text").cast("string")), keys[1]: F.coalesce(id_, F.lit(0)), keys[2]: id_.isNull()})
    joined = own.join(mark, keys, "left")
    # of rows that agree in id and class one stays; the join has brought them together
    ranked = joined.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return ranked.filter(F.col(state).isNull() | ((F.col(state) == 1) & (F.col(nth) == 1))).select(*(F.col(f"`{c}`") for c in docs.columns))
