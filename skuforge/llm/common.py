"""Shared helpers: word scanning over byte buffers, 64-bit mixing, Arrow batches, connected components.

Every helper is deterministic: a task that is run again after a lost executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.plans.results import written

#: Rows of an Arrow batch: bounds what one Python worker holds, whatever the mean text length is.
BATCH_ROWS = 1000
#: Bytes of text that numpy works on at a time inside a batch.
CHUNK_BYTES = 1 << 20

SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """The first n odd 64-bit constants of a seeded sequence."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Words:
    """Words of several texts in one byte buffer.

    buf: the bytes; start, end: word bounds in buf; first: index of each text's first word, with the
    total at the end, so that text i has the words first[i]:first[i + 1].
    """

    def __init__(self, texts: list[bytes], separators: bytes = SPACES) -> None:
        is_sep = np.zeros(256, bool)
        is_sep[list(separators)] = True
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes) if texts else np.zeros(0, np.int64)
        sep = is_sep[self.buf]
        change = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if len(sep) and not sep[0]:
            change = np.concatenate([np.zeros(1, np.int64), change])
        self.start, self.end = change[0::2], change[1::2]
        self.first = np.concatenate([np.zeros(1, np.int64), np.searchsorted(self.start, ends)])

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a multilinear sum over its bytes, then mixed."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        factors = stream(int(size.max()), 77)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        byte = self.buf[np.repeat(self.start, size) + at].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(byte * factors[at], np.cumsum(size) - size)
        return mix(sums + size.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `limit` bytes each, or one text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def free(name: str, taken: list[str]) -> str:
    """`name`, with underscores until no column of `taken` has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def table_state(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds; every round is a written table in the shared
    folder, so the lineage stays short and a lost executor costs a task. Joins are between two
    exchanged sides, which lets adaptive execution split a hub's rows. Nodes without edges are absent.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-min")
        e = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        low = written(e.groupBy("a").agg(F.min("b").alias("m")), "cc-min")
        e = written(
            e.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s"))
            .select("s.*").where("a <> b").distinct(), "cc-small")
        now = table_state(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
