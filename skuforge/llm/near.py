"""Near-duplicates by SimHash, confirmed and completed by the Jaccard similarity of word shingles.

Texts are sets of the XXH64 (seed 42) of their lowered five-word shingles; texts with the same set are
one class. Every class has the 64-bit SimHash of its set; classes whose SimHashes differ in at most 3 bits (vantage-point
tree of simhash.py, exact) are candidates first, and those whose sets reach the similarity are linked. The components of these links
need no more comparison inside.

SimHash bits alone lose similar texts, so a prefix filter completes the links. Two sets of similarity >= 4/5 share an element among the first n - ceil(4n/5) + 1 of each, in
any one order of all shingles (prefix filter), so classes that share a prefix shingle are all candidates
that there are. The order puts shingles last that are common in a sample of the documents: the sample
shapes the work only, never the result. A fixed number of SimHash bits cannot do this: pairs of similarity
0.8 and more differ in up to 17 of 64 bits, where pairs by chance are far more.

Candidates fall away by exact bounds before texts move. If a pair's first common shingle stands at places i and j of n
and m, they have at most min(n - i, m - j) in common, and ceil(4 (n + m) / 9) are needed. So of two sets the smaller one needs
the shingle in its first ninth; pages of one template, alike only in the later shingles, are no pairs.
Then the parity bitmaps of both sets are compared: a bit is the parity of the elements that fall on it, so two sets differ
in at least as many elements as their bitmaps in bits, and similar sets differ in at most (n + m) / 9. The bitmap of n elements has n to 2n
bits, a fortieth of the text. What is left is compared by the sets themselves.

There each class meets the smallest class of each of its prefix shingles if SimHash did not link both already; the components of
all links so far need no more comparison inside, so a large group of near copies costs one comparison a member. Then
pairs of different components are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge.llm.common import LOWER, components, encoded, mix, small_batches
from skuforge.llm.recompress import _in, bitmap
from skuforge.llm.simhash import LINK_BITS, SEED, links, majority
from skuforge.plans.results import written

SHINGLE = 5
#: Similarity as a fraction, so that bounds are exact.
SIMILARITY = (4, 5)
SAMPLE_DOCS = 10_000
COMMON = 1 << 17
#: Largest bitmap that keeps rows without a partner from being moved, in bits; beyond it more rows are moved, none is missed.
MARKED_BITS = 1 << 30


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, ascending; a text of fewer words is one shingle, one without words has none."""
    w = text.translate(LOWER).split()
    if not w:
        return np.zeros(0, np.int64)
    grams = [b" ".join(w)] if len(w) < size else map(b" ".join, zip(*[w[i:] for i in range(size)]))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in grams], "<u8").view(np.int64))


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity n) + 1 shingles in order of (count in the sample, hash)."""
    if not len(s):
        return s
    rank = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, counts[at], 0)
    p, q = SIMILARITY
    return s[np.lexsort((s, rank))[:len(s) - -(-p * len(s) // q) + 1]]


def parity(s: np.ndarray) -> bytes:
    """Bitmap of a power of two of bits, at least 64 and len(s): the parity of the elements on each bit."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    at = (mix(s.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the size of the other; at most the elements that the sets differ in."""
    x, y = sorted((x, y), key=len)
    folded = np.bitwise_xor.reduce(np.frombuffer(y, np.uint8).reshape(-1, len(x)), axis=0)
    return int.from_bytes(np.bitwise_xor(folded, np.frombuffer(x, np.uint8)).tobytes(), "little").bit_count()


def sets(docs: DataFrame) -> DataFrame:
    """cls, grams for rows (cls, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t) for t in encoded(batch.column(1))], pa.list_(pa.int64()))], ["cls", "grams"])

    return docs.select("cls", "text").mapInArrow(run, "cls bigint, grams array<bigint>")


def common_shingles(docs: DataFrame, sample: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in two or more documents of a sample, ascending, and their counts."""
    total = docs.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("near")), F.lit(1 << 20)) < min(1.0, sample / max(1, total)) * (1 << 20)
    # equal texts once: copies are one class
    some = docs.where(part).groupBy(F.xxhash64("text").alias("cls")).agg(F.min("text").alias("text"))
    rows = sets(some).select(F.explode("grams").alias("g")).groupBy("g").count().where("count > 1").orderBy(F.desc("count"), "g").limit(limit).toPandas().sort_values("g")
    return rows["g"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def classes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_key, cls (hash of the shingle set), n (its size), bits (its bitmap), fp (its SimHash), grams (its prefix) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in encoded(batch.column(2))]
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls), pa.array([len(s) for s in found], pa.int32()), pa.array([parity(s) for s in found], pa.binary()),
                 pa.array([majority(s.view("<u8")) for s in found], pa.int64()), pa.array([prefix(s, *shared.value) for s in found], pa.list_(pa.int64()))], ["doc_id", "text_key", "cls", "n", "bits", "fp", "grams"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id bigint, text_key string, cls bigint, n int, bits binary, fp bigint, grams array<bigint>")


def marked(rows: DataFrame, key: Column, names: DataFrame) -> DataFrame:
    """Rows whose key is one of `names` (name), and a few more."""
    held = bitmap(rows.sparkSession, names, min(MARKED_BITS, 1 << max(18, (16 * names.count()).bit_length())))

    @F.pandas_udf("boolean")
    def known(keys: pd.Series) -> pd.Series:
        return pd.Series(_in(held.value, keys.to_numpy().view(np.uint64)))

    return rows.where(known(key))


def reachable(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m elements whose first common one has the places i and j can be similar."""
    p, q = SIMILARITY
    return ((p + q) * F.least(n - i, m - j) >= p * (n + m)) & (q * F.least(n, m) >= p * F.greatest(n, m))


def plausible(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that their bitmaps do not rule out."""
    p, q = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            near = [(p + q) * apart(u, v) <= (q - p) * (k + l) for k, l, u, v in zip(n, m, x, y)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(firsts.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("bits").alias("x")), "a")
    both = both.join(firsts.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a bigint, b bigint")


def compared(pairs: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose similarity is reached."""
    p, q = SIMILARITY
    need = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(firsts, "cls").select("cls", "first.doc_id", "first.text_key")
    need, row_key = written(need, "near-need"), F.xxhash64("doc_id", "text_key")
    some = marked(docs.select("doc_id", "text_key", "text"), row_key, need.select(row_key.alias("name")))
    # repeated rows once, by the keys of the join, so that texts are moved once
    texts = some.dropDuplicates(["doc_id", "text_key"]).join(need.hint("shuffle_hash"), ["doc_id", "text_key"])
    grams = written(sets(texts), "near-sets")
    both = pairs.join(grams.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(q * shared >= p * (F.size("x") + F.size("y") - shared)).select("a", "b")


def simhash_pairs(firsts: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """Pairs (a, b) of classes (cls, fp) whose components are those of all SimHashes that differ in at most `bits` bits."""
    points = written(firsts.groupBy("fp").agg(F.min("cls").alias("cls")), "near-simhash-points")
    edges = links(points.select("fp"), bits)
    edges = edges.join(points.select(F.col("fp").alias("a"), F.col("cls").alias("x")), "a").join(points.select(F.col("fp").alias("b"), F.col("cls").alias("y")), "b")
    same = firsts.select("fp", F.col("cls").alias("y")).join(points.select("fp", F.col("cls").alias("x")), "fp").where("x <> y")
    pairs = edges.select("x", "y").union(same.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, sample: int = SAMPLE_DOCS, common: int = COMMON) -> DataFrame:
    """doc_id, text_key, first (struct doc_id, text_key: the smallest of the component) for each row.

    docs: doc_id, not null; text_key, equal for equal texts only; text. Similar texts (SIMILARITY) are
    linked, components of links are groups. Null and blank texts are one class.
    """
    small_batches(docs.sparkSession)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    p, q = SIMILARITY
    rows = written(classes(docs, common_shingles(docs, sample, common)), "near-rows")
    firsts = written(rows.groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min(F.struct("n", "bits", "fp")).alias("of")).select("cls", "first", "of.*"), "near-firsts")
    alike = written(plausible(written(simhash_pairs(firsts), "near-simhash"), firsts), "near-simhash-pairs")
    alike = written(compared(alike, firsts, docs), "near-simhash-links")
    roots = components(alike)
    grams = rows.select("cls", "n", F.posexplode("grams").alias("i", "g"))
    heads = grams.groupBy("g").agg(F.min("cls").alias("head"), F.max("cls").alias("last")).where("head < last").drop("last")
    heads = written(heads, "near-heads")
    # most prefix shingles stand in one class alone and are not moved
    groups = marked(grams, F.col("g"), heads.select(F.col("g").alias("name"))).distinct().join(heads, "g")
    groups = groups.join(roots, groups["cls"] == roots["node"], "left").select("g", "cls", "n", "i", "head", F.coalesce("root", "cls").alias("alike"))
    groups = written(groups, "near-groups")
    of_head = groups.where("cls = head").select("g", F.col("n").alias("m"), F.col("i").alias("j"), F.col("alike").alias("its"))
    stars = groups.where("cls <> head").join(of_head, "g").where("alike <> its").where(reachable(F.col("n"), F.col("i"), F.col("m"), F.col("j")))
    stars = written(stars.select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct(), "near-stars")
    found = written(alike.union(compared(written(plausible(stars, firsts), "near-star-pairs"), firsts, docs)), "near-links")
    roots = components(found)
    named = written(groups.join(roots, groups["cls"] == roots["node"], "left").select("g", "cls", "n", "i", F.coalesce("root", "cls").alias("root")), "near-named")
    mixed = named.join(named.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("g"), "g")
    # of a similar pair the smaller set has its first common shingle in its first ninth (q - p of p + q)
    x, y = mixed.where((p + q) * F.col("i") <= (q - p) * F.col("n")).alias("x"), mixed.alias("y")
    larger = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cls") < F.col("y.cls")))
    rest = x.join(y, F.col("x.g") == F.col("y.g")).where(larger).where("x.root <> y.root").where(reachable(F.col("x.n"), F.col("x.i"), F.col("y.n"), F.col("y.i")))
    rest = rest.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = written(plausible(written(rest, "near-rest"), firsts), "near-rest-pairs")
    if not rest.isEmpty():
        roots = components(written(found.union(compared(rest, firsts, docs)), "near-all-links"))
    named = written(firsts.join(roots, firsts["cls"] == roots["node"], "left").select("cls", "first", F.coalesce("root", "cls").alias("root")), "near-roots")
    least = written(named.groupBy("root").agg(F.min("first").alias("least")), "near-least")
    of = written(named.join(least, "root").select("cls", F.col("least").alias("first")), "near-classes")
    return rows.join(of, "cls").select("doc_id", "text_key", "first")
