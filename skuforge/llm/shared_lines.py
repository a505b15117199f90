"""Removal of lines that several documents share, through two Bloom filters.

A line's key is the line stripped and lower-cased. One scan writes the keys of every document as 128-bit
hashes, in blocks of some hundred thousand. Each block asks for its keys: the hash space is cut into
segments, and a segment gets four bytes for each distinct key of a block. The segment keeps two Bloom
filters, one of keys seen once and one of keys seen twice: a key that the first filter knows enters
the second. Its answer is one bit a key. Both filters are sized by the keys that reached the segment, and
segments multiply with the counted lines, so a task's memory is the same at every size and nothing is
broadcast.

Blocks are a bucketed table, so only the answers travel back to them. Only the keys that the second filter
knows are then shuffled, with their documents, for the exact count and the choice of the document that
keeps its lines. A line counts as equal by its 128-bit hash. A false answer of a filter costs a row, never
a result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import SPACES, encoded, mix, small_batches, table
from skuforge.llm.recompress import _in, bitmap
from skuforge.plans.results import shared_folder, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys of a block: what a task holds before it writes.
BLOCK_KEYS = 1 << 18
#: Keys of a segment, on average; a segment's task holds four bytes for each, and the two filters.
SEGMENT_KEYS = 1 << 23
#: Segments at least, so that small inputs use all cores too.
LEAST_SEGMENTS = 64
#: Keys whose documents are found by a broadcast, at most.
HOT_KEYS = 1 << 12
BITS_PER_KEY = 8
PROBES = 3
#: Largest bitmap of documents to be rewritten, in bits; beyond it more documents are moved, none is missed.
TOUCHED_BITS = 1 << 30
_U = np.uint64


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of the line's key; None for a key of fewer code points."""
    key = line.strip(SPACES).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class Bits:
    """A Bloom filter over 32-bit values in `size` bits (a power of two)."""

    def __init__(self, size: int) -> None:
        self.words, self.mask = np.zeros(size // 8, np.uint8), _U(size - 1)

    def places(self, values: np.ndarray) -> np.ndarray:
        """PROBES rows of bit positions."""
        return np.stack([mix(values.astype(_U) + _U(k << 32)) & self.mask for k in range(1, PROBES + 1)])

    def add(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.words, (places >> _U(3)).ravel(), np.uint8(1) << (places & _U(7)).astype(np.uint8).ravel())

    def has(self, places: np.ndarray) -> np.ndarray:
        return ((self.words[places >> _U(3)] >> (places & _U(7)).astype(np.uint8)) & np.uint8(1)).all(axis=0)


def seen_twice(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For every block (distinct values, whether the block itself holds the value twice): which values are
    seen twice over all blocks, false hits included."""
    size = 1 << max(10, int(BITS_PER_KEY * sum(len(v) for v, _ in blocks) - 1).bit_length())
    once, twice = Bits(size), Bits(size)
    for values, repeated in blocks:
        at = once.places(values)
        twice.add(at[:, once.has(at) | repeated])
        once.add(at)
    return [twice.has(twice.places(values)) for values, _ in blocks]


def _blocks(min_chars: int):
    """Documents to blocks: ids, text hashes, number of keys of each document, and the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, hashes, sizes, keys, held = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "block": part << 32 | made, "ids": np.array(ids, np.int64).tobytes(), "hashes": np.array(hashes, np.int64).tobytes(),
                "sizes": np.array(sizes, np.int32).tobytes(), "keys": b"".join(keys)}], pa.schema([
                    ("block", pa.int64()), ("ids", pa.binary()), ("hashes", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())]))

        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2))):
                own = {line_key(line, min_chars) for line in t.split(b"\n")} - {None}
                if own:
                    ids.append(i)
                    hashes.append(h)
                    sizes.append(len(own))
                    keys += sorted(own)
                    held += len(own)
                    if held >= BLOCK_KEYS:
                        yield row()
                        made += 1
                        ids, hashes, sizes, keys, held = [], [], [], [], 0
        if held:
            yield row()
    return run


def _heads(keys: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First 64 bits of every key of a block: distinct ones in order, place of each key, how often."""
    return np.unique(np.frombuffer(keys, ">u8")[0::2].astype(_U), return_inverse=True, return_counts=True)


def _requests(segments: int):
    shift = _U(64 - (segments - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head, _, count = _heads(keys)
                segment = (head >> shift).astype(np.int64)
                first = np.flatnonzero(np.diff(segment, prepend=-1))
                ends = np.append(first[1:], len(head))
                values, repeated = head.astype("<u4"), count > 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(segment[first]), pa.array([block] * len(first), pa.int64()),
                    pa.array([values[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                    pa.array([np.packbits(repeated[a:b]).tobytes() for a, b in zip(first, ends)], pa.binary()),
                ], ["segment", "block", "values", "repeated"])
    return run


def _answer(group: pa.Table) -> pa.Table:
    """One segment: the requests of all blocks through the two filters."""
    group = group.sort_by("block")
    blocks = []
    for v, r in zip(group["values"].to_pylist(), group["repeated"].to_pylist()):
        values = np.frombuffer(v, "<u4")
        blocks.append((values, np.unpackbits(np.frombuffer(r, np.uint8), count=len(values)).astype(bool)))
    bits = [np.packbits(x).tobytes() for x in seen_twice(blocks)]
    return pa.table({"block": group["block"], "segment": group["segment"], "asked": pa.array([len(v) for v, _ in blocks], pa.int32()), "bits": pa.array(bits, pa.binary())})


SUSPECTS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64())])


def _suspects(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """One block and its answers: keys that the filter of twice-seen keys knows, with their documents."""
    answers = answers.sort_by("segment")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(answers["bits"].to_pylist(), answers["asked"].to_pylist())]
    out = []
    for b in blocks.to_pylist():
        sizes = np.frombuffer(b["sizes"], np.int32)
        _, place, _ = _heads(b["keys"])
        at = np.flatnonzero(np.concatenate(bits)[place])
        owner = np.repeat(np.arange(len(sizes)), sizes)[at]
        keys = np.frombuffer(b["keys"], "V16")[at]
        out.append(pa.table([
            pa.array(keys.tolist(), pa.binary()), pa.array(np.frombuffer(b["ids"], np.int64)[owner]), pa.array(np.frombuffer(b["hashes"], np.int64)[owner]),
        ], schema=SUSPECTS))
    return pa.concat_tables(out) if out else SUSPECTS.empty_table()


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """The frame as a written table that is dealt out by the column, without a shuffle."""
    spark, name = df.sparkSession, f"skuforge_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", f"{shared_folder(spark)}/skuforge/{name}").saveAsTable(name)
    return spark.table(name)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """Keys that a document loses: rows (doc_id, text_hash, keys array<binary>), one per document with any.

    docs: doc_id, text. Keys of at least min_chars code points found in at least min_docs documents are lost
    by all but the largest doc_id that holds them. Rows without doc_id or text take no part; rows with one
    doc_id count as one document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    lines = rows.select(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    segments = 1 << (max(LEAST_SEGMENTS, -(-lines // segment_keys)) - 1).bit_length()
    blocks = bucketed(rows.mapInArrow(_blocks(min_chars), "block bigint, ids binary, hashes binary, sizes binary, keys binary"),
                      "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = (
        blocks.select("block", "keys").mapInArrow(_requests(segments), "segment bigint, block bigint, values binary, repeated binary")
        .groupBy("segment").applyInArrow(_answer, "block bigint, segment bigint, asked int, bits binary")
    )
    suspects = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_suspects, "key binary, doc_id bigint, text_hash bigint"), "line-suspects")
    # first each (key, document) once, spread by both, then counts that combine before their shuffle
    shared = written(
        suspects.select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs), "line-shared")
    # keys with at least 1 / HOT_KEYS of all suspects are HOT_KEYS rows at most, and are broadcast; no other key is hot
    is_hot = F.col("n") * F.lit(HOT_KEYS) >= F.lit(suspects.count())
    hot = F.broadcast(shared.where(is_hot).drop("n"))
    cold = suspects.join(hot, "key", "left_anti").join(shared.where(~is_hot).drop("n"), "key")
    lost = suspects.join(hot, "key").select(*suspects.columns, "keeper").union(cold.select(*suspects.columns, "keeper")).where("doc_id < keeper")
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))


def without_lines(text: bytes, keys: set[bytes], min_chars: int = MIN_CHARS) -> tuple[int, int, bytes]:
    """(lines, dropped lines, the other lines)."""
    lines = text.split(b"\n")
    if not keys:
        return len(lines), 0, text
    kept = [line for line in lines if line_key(line, min_chars) not in keys]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_text: bool = True, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept_text.

    A null or empty text is one empty line; rows without doc_id keep all their lines. Other columns of docs
    are not carried.
    """
    spark = docs.sparkSession
    lost = written(dropped_lines(docs.select("doc_id", "text"), min_chars, min_docs, segment_keys), "line-lost")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    row_key = F.xxhash64("doc_id", "text_hash")
    size = min(TOUCHED_BITS, 1 << max(18, (16 * lost.count()).bit_length()))
    touched = bitmap(spark, lost.select(row_key.alias("name")), size)

    @F.pandas_udf("boolean")
    def marked(key: pd.Series) -> pd.Series:
        return pd.Series(_in(touched.value, key.to_numpy().view(np.uint64)))

    # only texts that lose a line are moved
    rows = rows.withColumn("marked", marked(row_key))
    found = rows.where("marked").join(lost.hint("merge"), ["doc_id", "text_hash"], "left").select("doc_id", "text", "keys")
    found = found.union(rows.where("not marked").select("doc_id", "text", F.lit(None).cast("array<binary>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [without_lines(t, set(k or ()), min_chars) for t, k in zip(encoded(batch.column(1)), batch.column(2).to_pylist())]
            cols = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if keep_text:
                cols.append(pa.array([g[2].decode() for g in got], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return found.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string" + ", kept_text string" * keep_text)


def op11_two_bloom_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(table(spark, sf_dir, "documents"), keep_text=False)


OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < s.keeper, false) AS lost FROM k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
