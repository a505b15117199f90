"""Exact removal of repeated word passages, found by recompression.

Level 0 of a text is its sequence of word hashes. A round names things that stand side by side: the
first names runs of equal tokens, then every round names pairs whose left symbol falls into one half
of the alphabet and whose right symbol falls into the other. A name is a hash of the round and of
the parts, so all tasks give equal pairs equal names without a dictionary. Only symbols of at most
1, 2, 4 ... words take part in a round (restricted recompression), so whether two neighbours merge
depends on REACH words on either side alone: equal passages get equal symbols except near their ends.

Spark then works in rounds on what the high-level symbols show:

1. Each window of `window` words is represented by one symbol boundary well inside it, the one with
   the smallest name of its surroundings. Windows of one boundary are neighbours. Boundaries whose
   name occurs in two documents are candidates; the rest of the corpus is done.
2. The stretch of all windows of a candidate boundary is compared as a whole. Where a document with
   a smaller id has the same stretch, all its windows are repeats. This settles the inside of long
   repeats with one row a boundary.
3. For names with boundaries that are left, single windows are compared, by 96 bits.

Candidate names travel to the tasks as a bitmap of fixed size; a false hit costs a row, never a
result. Nothing is gathered per name: repeats come from min() aggregates and joins of two exchanged
sides, so a passage that stands in a third of all documents is neither collected nor paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import Words, chunks, encoded, mix, small_batches, stream, table
from skuforge.plans.results import written

WINDOW = 50
LEVELS = (1, 2, 4)  # longest symbols, in words, that a round merges
BITMAP_BITS = 1 << 27
_U = np.uint64


def reach(levels: tuple[int, ...]) -> int:
    """Words on either side of a boundary that decide whether it survives all rounds."""
    return 1 + sum(levels)


def boundaries(h: np.ndarray, first: np.ndarray, levels: tuple[int, ...] = LEVELS) -> np.ndarray:
    """Which words begin a symbol of the highest level; h: word hashes of texts that begin at `first`."""
    n = len(h)
    opens = np.zeros(n + 1, bool)
    opens[first[first < n]] = True
    # runs of equal tokens
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & ~opens[1:n]
    start = np.flatnonzero(~same)
    size = np.diff(np.append(start, n))
    name = np.where(size > 1, mix(h[start] + size.astype(_U) * _U(0xD6E8FEB86659FD93)), h[start])
    for k, most in enumerate(levels):
        if len(start) < 2:
            break
        coin = (mix(name + _U(k + 1)) >> _U(63)).astype(bool)
        short = size <= most
        joins = np.zeros(len(start), bool)  # merges with its left neighbour
        joins[1:] = coin[:-1] & ~coin[1:] & short[:-1] & short[1:] & ~opens[start[1:]]
        left = np.flatnonzero(joins) - 1
        name[left] = mix(name[left] * _U(0x9E3779B97F4A7C15) + name[left + 1] + _U(k))
        size[left] += size[left + 1]
        start, name, size = start[~joins], name[~joins], size[~joins]
    out = np.zeros(n, bool)
    out[start] = True
    return out


class Prefix:
    """Hashes of any stretch of words in constant time: polynomial prefix sums, modulo 2**64."""

    BASE = 0xD1342543DE82EF95

    def __init__(self, h: np.ndarray) -> None:
        n = len(h)
        power = np.full(n + 1, self.BASE, _U)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        self.total = np.concatenate([np.zeros(1, _U), np.cumsum(h * self.power[:n], dtype=_U)])
        # dividing by BASE**i modulo 2**64
        inverse = np.full(n + 1, pow(self.BASE, -1, 1 << 64), _U)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[begin]) * self.inverse[begin] + (end - begin).astype(_U) * _U(0xA0761D6478BD642F))


def anchors(words: Words, window: int, levels: tuple[int, ...] = LEVELS) -> tuple:
    """Boundaries that represent windows: name, text, first and last window start, two stretch hashers.

    A window without a boundary inside (a run of one word) represents itself.
    """
    h, first = words.hashes(), words.first
    alpha, n = reach(levels), len(words)
    a, b = Prefix(h), Prefix(mix(h + _U(0x5851F42D4C957F2D)))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(n)
    start = start[start + window <= first[1:][text]] if n else start
    none = np.zeros(0, np.int64)
    if not len(start):
        return none.astype(_U), none, none, none, none, a, b
    at = np.flatnonzero(boundaries(h, first, levels))
    at = at[(at >= alpha) & (at + alpha <= n)]
    big = np.iinfo(np.uint64).max
    name = np.full(n + window, big, _U)
    name[at] = a.of(at - alpha, at + alpha) >> _U(1)
    # smallest name of start + alpha .. start + window - alpha, leftmost of equals: doubling
    span = window - 2 * alpha + 1
    low, where, have = name.copy(), np.arange(n + window), 1
    while have < span:
        step = min(have, span - have)
        better = low[step:] < low[:-step]
        low[:-step][better], where[:-step][better] = low[step:][better], where[step:][better]
        have += step
    low, where = low[start + alpha], where[start + alpha]
    alone = low == big
    low[alone], where[alone] = a.of(start[alone], start[alone] + window) >> _U(1), -1 - start[alone]
    new = np.ones(len(start), bool)
    new[1:] = (where[1:] != where[:-1]) | (np.diff(start) != 1) | (text[start[1:]] != text[start[:-1]])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(start)) - 1
    return low[lo], text[start[lo]], start[lo], start[hi], np.where(where[lo] < 0, 0, where[lo] - start[lo]), a, b


def _mapper(emit, window: int, levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = encoded(batch.column(2))
            for i, j in chunks(texts):
                words = Words(texts[i:j])
                yield emit(doc[i:j], row[i:j], words, anchors(words, window, levels))
    return run


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


def _in(bits: np.ndarray | None, name: np.ndarray) -> np.ndarray:
    at = name % _U(len(bits) * 8)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & np.uint8(1) == 1


def bitmap(spark: SparkSession, names: DataFrame, bits: int):
    """Broadcast bitmap of fixed size over the names; Spark builds it piece by piece."""
    at = F.pmod(F.col("name"), F.lit(bits)) + 1  # bitmap functions count from 1
    pieces = names.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for piece, part in pieces.toLocalIterator():  # bits / 8 bytes at most
        out[(piece - 1) * 4096:piece * 4096] |= np.frombuffer(bytes(part), np.uint8)[:max(0, len(out) - (piece - 1) * 4096)]
    return spark.sparkContext.broadcast(out)


def repeats(docs: DataFrame, window: int = WINDOW, levels: tuple[int, ...] = LEVELS, bits: int = BITMAP_BITS) -> DataFrame:
    """Word ranges covered by windows that also start in a document with a smaller doc_id.

    docs: doc_id, text. Returns (doc_id, text_hash, ranges array<struct<begin, end>>), ranges sorted
    and merged, one row per document with any. Rows without doc_id or text take no part; documents
    of fewer words than a window have none; rows with equal ids do not count as each other's source.
    """
    if window < 2 * reach(levels) + max(2 * k for k in levels):
        raise ValueError(f"a window of {window} words is too short for levels {levels}")
    spark = docs.sparkSession
    small_batches(spark)
    doc_type = "bigint"
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast(doc_type).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def first(doc, row, words, found):
        name, text = found[0], found[1]
        pair = np.unique(np.rec.fromarrays([doc[text], _signed(name)])) if len(name) else np.rec.fromarrays([doc[:0], doc[:0]])
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(pair.f1, np.int64)), pa.array(np.asarray(pair.f0, np.int64))], ["name", "doc_id"])

    shared = (
        rows.mapInArrow(_mapper(first, window, levels), f"name bigint, doc_id {doc_type}")
        .groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("name")
    )
    some = bitmap(spark, shared, bits)

    def stretches(doc, row, words, found):
        name, text, lo, hi, off, a, b = found
        at = np.flatnonzero(_in(some.value, name))
        name, text, lo, hi, off = name[at], text[at], lo[at], hi[at], off[at]
        base = words.first[text]
        return pa.RecordBatch.from_arrays([
            pa.array(_signed(name)), pa.array(_signed(a.of(lo, hi + window) + off.astype(_U))), pa.array((b.of(lo, hi + window) >> _U(33)).astype(np.int32)),
            pa.array(doc[text].astype(np.int64)), pa.array(row[text].astype(np.int64)), pa.array((lo - base).astype(np.int32)), pa.array((hi + window - base).astype(np.int32)),
        ], ["name", "key", "check", "doc_id", "text_hash", "begin", "end"])

    spans = f"key bigint, check int, doc_id {doc_type}, text_hash bigint, begin int, end int"
    whole = written(rows.mapInArrow(_mapper(stretches, window, levels), f"name bigint, {spans}"), "repeat-stretches")
    least = written(whole.groupBy("key", "check").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last"), "repeat-sources")
    settled = whole.join(least, ["key", "check"], "left").withColumn("done", F.coalesce(F.col("source") < F.col("doc_id"), F.lit(False)))
    settled = written(settled.select("name", "doc_id", "text_hash", "begin", "end", "done"), "repeat-settled")
    # a name needs the closer look if one of its boundaries is not settled and is not the smallest document of the name
    open_names = (
        settled.groupBy("name").agg(F.max(F.when(~F.col("done"), F.col("doc_id"))).alias("last_open"), F.min("doc_id").alias("lo"))
        .where("last_open > lo").select("name")
    )
    left = bitmap(spark, open_names, bits)

    def windows(doc, row, words, found):
        name, text, lo, hi, off, a, b = found
        at = np.flatnonzero(_in(left.value, name)) if len(name) else np.zeros(0, np.int64)
        size = (hi - lo + 1)[at]
        p = np.repeat(lo[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        t = np.repeat(text[at], size)
        begin = (p - words.first[t]).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array(_signed(a.of(p, p + window))), pa.array((b.of(p, p + window) >> _U(33)).astype(np.int32)),
            pa.array(doc[t].astype(np.int64)), pa.array(row[t].astype(np.int64)), pa.array(begin), pa.array(begin + np.int32(window)),
        ], ["key", "check", "doc_id", "text_hash", "begin", "end"])

    single = written(rows.mapInArrow(_mapper(windows, window, levels), spans), "repeat-windows")
    least = written(single.groupBy("key", "check").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last"), "repeat-sources")
    late = single.join(least, ["key", "check"]).where("source < doc_id")
    hits = settled.where("done").select("doc_id", "text_hash", "begin", "end").union(late.select("doc_id", "text_hash", "begin", "end"))
    # one document's ranges meet here: at most one a word of it
    return hits.groupBy("doc_id", "text_hash").agg(merged(F.sort_array(F.collect_set(F.struct("begin", "end")))).alias("ranges"))


def merged(ranges):
    """Sorted ranges with those that touch joined."""
    empty = F.expr("cast(array() as array<struct<begin:int,end:int>>)")
    state = F.struct(empty.alias("done"), F.lit(0).alias("begin"), F.lit(0).alias("end"))

    def step(s, r):
        apart = r["begin"] > s["end"]
        return F.when(s["end"] == 0, F.struct(s["done"].alias("done"), r["begin"].alias("begin"), r["end"].alias("end"))).when(
            apart, F.struct(F.concat(s["done"], F.array(F.struct(s["begin"].alias("begin"), s["end"].alias("end")))).alias("done"), r["begin"].alias("begin"), r["end"].alias("end"))
        ).otherwise(F.struct(s["done"].alias("done"), s["begin"].alias("begin"), F.greatest(s["end"], r["end"]).alias("end")))

    return F.aggregate(ranges, state, step, lambda s: F.concat(s["done"], F.array(F.struct(s["begin"].alias("begin"), s["end"].alias("end")))))


def kept_text(text: bytes, ranges) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space)."""
    words = text.split()
    removed = 0
    for r in reversed(ranges):
        begin, end = r["begin"], r["end"]
        removed += end - begin
        del words[begin:end]
    return len(words) + removed, removed, b" ".join(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    A null text has no words. Other columns of docs are not carried.
    """
    spark = docs.sparkSession
    ranges = written(repeats(docs.select("doc_id", "text"), window), "repeat-ranges")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    row_key = F.xxhash64("doc_id", "text_hash")
    touched = bitmap(spark, ranges.select(row_key.alias("name")), BITMAP_BITS)

    @F.pandas_udf("boolean")
    def marked(key: pd.Series) -> pd.Series:
        return pd.Series(_in(touched.value, key.to_numpy().view(np.uint64)))

    # texts without a repeat are not moved; the hint keeps one plan at every size
    rows = rows.withColumn("marked", marked(row_key))
    found = rows.where("marked").drop("marked").join(ranges.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges")
    found = found.union(rows.where("not marked").select("doc_id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_text(t, r or ()) for t, r in zip(encoded(batch.column(1)), batch.column(2).to_pylist())]
            cols = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array([g[2].decode() for g in got], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text
    return found.mapInArrow(run, schema)


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


#: Every window as text, the smallest document that it starts in, and the words that later windows cover.
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS txt
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS p FROM w WHERE len(words) >= 50)),
src AS (SELECT txt, min(doc_id) AS source FROM win GROUP BY txt),
cov AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS i FROM win JOIN src USING (txt) WHERE source < doc_id),
gone AS (SELECT doc_id, list(i) AS gone FROM cov GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
    list_filter(list_transform(generate_series(1, len(words)), lambda i: CASE WHEN list_contains(gone, i) THEN NULL ELSE words[i] END), lambda x: x IS NOT NULL) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""
