"""SimHash near-duplicates, linked exactly through a vantage-point tree.

Fingerprints: majority vote of the XXH64 (seed 42) of lowered three-word shingles. Documents with the
same fingerprint are one point. A vantage-point tree over a bounded sample of the points cuts the
Hamming space into shards: a node's points with distance <= radius lie inside, the others outside.
Every point is a resident of one shard. By the triangle bound two points on different sides of a node
can only be within `links` bits if the inner one lies within `links` of the radius, so such points
also visit the outer side as guests, and guests go on into every branch that the bound leaves open.
Each shard then compares its residents with each other and with its guests, exactly. Shards with many
points are split into blocks of residents and blocks of guests, so no task grows with a cluster, and
a block gives at most one link a point (a spanning forest), never all pairs.

The sample only shapes the tree: every point is routed and every pair within `links` bits is found,
whatever the sample (recall 1 by construction, checked against brute force in the tests).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import LOWER, components, encoded, small_batches, table
from skuforge.plans.results import written

LINK_BITS = 3
SHINGLE = 3
SEED = 42
SHARD_POINTS = 2048
GUEST_POINTS = 1 << 15
SAMPLE_POINTS = 20_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash; 0 without a word."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < size else map(b" ".join, zip(*[w[i:] for i in range(size)]))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, SEED) for g in grams], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp for each row; null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, size) for t in encoded(batch.column(1))], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


class Tree:
    """Vantage-point tree; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int) -> None:
        self.nodes: list[list[int]] = []  # point, radius, inner, outer; a leaf is ~number
        self.leaves = 0
        self.root = self._grow(sample, total / max(1, len(sample)), leaf)

    def _grow(self, sample: np.ndarray, weight: float, leaf: int) -> int:
        if len(sample) * weight <= leaf or len(sample) < 16:
            self.leaves += 1
            return -self.leaves
        # of a few points, the one whose median shell holds the fewest others
        best = None
        for point in sample[:: max(1, len(sample) // 16)][:16]:
            d = np.bitwise_count(sample ^ point)
            radius = int(np.sort(d)[(len(d) - 1) // 2])
            inside = int((d <= radius).sum())
            shell = int((np.abs(d.astype(int) - radius) <= LINK_BITS).sum())
            if 0 < inside < len(sample) and (best is None or shell + abs(2 * inside - len(d)) < best[0]):
                best = (shell + abs(2 * inside - len(d)), point, radius)
        if best is None:
            self.leaves += 1
            return -self.leaves
        d = np.bitwise_count(sample ^ best[1])
        at = len(self.nodes)
        self.nodes.append([int(best[1]), best[2], 0, 0])
        self.nodes[at][2] = self._grow(sample[d <= best[2]], weight, leaf)
        self.nodes[at][3] = self._grow(sample[d > best[2]], weight, leaf)
        return at

    def route(self, fp: np.ndarray, links: int = LINK_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the point, shard, guest flag, for each shard that a point lives in or visits."""
        out, todo = [], [(self.root, np.arange(len(fp)), np.zeros(len(fp), bool))]
        while todo:
            at, who, guest = todo.pop()
            if not len(who):
                continue
            if at < 0:
                out.append((who, np.full(len(who), -1 - at), guest))
                continue
            point, radius, inner, outer = self.nodes[at]
            d = np.bitwise_count(fp[who] ^ np.uint64(point)).astype(int)
            inside, near = d <= radius, d > radius - links
            lives = ~guest
            todo.append((inner, who[(lives & inside) | (guest & (d <= radius + links))], guest[(lives & inside) | (guest & (d <= radius + links))]))
            todo.append((outer, who[~inside | near], (guest | inside)[~inside | near]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the sets of x[i] and y[i]; parent points at roots before and after."""
    while len(x):
        a, b = parent[x], parent[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def forest(lives: np.ndarray, guests: np.ndarray, among: bool, links: int = LINK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of the residents with the guests and, if `among`, each other."""
    points = np.concatenate([lives, guests])
    parent = np.arange(len(points))
    for i in range(0 if among else len(lives), len(points), 1024):
        part = points[i:i + 1024]
        p, q = np.nonzero(np.bitwise_count(part[:, None] ^ lives[None, :]) <= links)
        unite(parent, p + i, q)
    loose = np.flatnonzero(parent != np.arange(len(points)))
    return points[loose].view(np.int64), points[parent[loose]].view(np.int64)


def links(points: DataFrame, bits: int = LINK_BITS, shard_points: int = SHARD_POINTS, sample_points: int = SAMPLE_POINTS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links <= bits.

    points: fp, distinct.
    """
    spark = points.sparkSession
    total = points.count()
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(sample_points).collect()
    tree = spark.sparkContext.broadcast(Tree(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), total, shard_points))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            who, shard, guest = tree.value.route(fp.view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(fp[who]), pa.array(shard.astype(np.int32)), pa.array(guest)], ["fp", "shard", "guest"])

    routed = points.select("fp").mapInArrow(route, "fp bigint, shard int, guest boolean")
    sizes = (
        routed.groupBy("shard").agg(F.count(F.when(~F.col("guest"), 1)).alias("lives"), F.count(F.when(F.col("guest"), 1)).alias("visits")).where("lives > 0")
        .select("shard", F.ceil(F.col("lives") / (2 * shard_points)).cast("int").alias("n"), F.greatest(F.lit(1), F.ceil(F.col("visits") / GUEST_POINTS)).cast("int").alias("m"))
    )
    sizes = written(sizes, "simhash-shards")
    h = F.abs(F.xxhash64("fp") % 1_000_003)
    # resident block i meets the blocks i..n of residents as guests, and all m blocks of guests
    own = F.pmod(h, F.col("n")).cast("int")
    dealt = routed.join(sizes, "shard").select(
        "fp", "shard",
        F.explode(F.when(F.col("guest"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
            i.alias("block"), (F.pmod(h, F.col("m")).cast("int")).alias("other"), F.lit(1).alias("role"))))
            .otherwise(F.concat(
                F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(own.alias("block"), j.alias("other"), F.lit(0).alias("role"))),
                F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i > own), lambda i: F.struct(own.alias("block"), (-i).alias("other"), F.lit(0).alias("role"))),
                F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i < own), lambda i: F.struct(i.alias("block"), (-own).alias("other"), F.lit(1).alias("role"))),
            ))).alias("x")).select("fp", "shard", "x.*")

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        role = rows.column("role").to_numpy()
        a, b = forest(fp[role == 0], fp[role == 1], key[2].as_py() == 0, bits)
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("shard", "block", "other").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, bits: int = LINK_BITS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for each row of docs (doc_id, text).

    Null or blank texts have fingerprint 0 and link like any other; rows with equal ids link through
    their fingerprints only; a null doc_id is never the smallest unless a component has no other.
    """
    fps = written(fingerprints(docs, size), "simhash-fingerprints")
    points = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-points")
    edges = written(links(points, bits), "simhash-links")
    roots = components(edges)
    named = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-roots")
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    classes = written(named.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
