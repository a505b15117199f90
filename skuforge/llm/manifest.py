"""Merkle manifest of a table: one digest for all rows, and a proof for each of them.

Every row is a leaf. Leaves of a group stand in order, every `arity` neighbours become one node, until one
node, the subroot, is left; the subroots of all groups form a tree of the same kind.

Positions come from a range partitioning: the place inside a sorted partition plus the counts of the
partitions before it. Blocks of arity ** LEVELS consecutive nodes of a group are then window partitions,
so a group of any size is spread over many tasks. Inside a block, level L keeps its nodes in the rows
whose position is a multiple of arity ** L: lag and lead by fixed offsets, masked by the slot in the run
and the length of the run, bring the siblings, and the row of the first child hashes the parent. One more
window hands every row the siblings of its ancestors (last value not null). The tops of the blocks are the
nodes of the next step, which is the same again over a table 3 ** 6 times smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuforge.llm.common import table
from skuforge.plans.results import written

ARITY = 3
#: Levels of a step; a window partition holds ARITY ** LEVELS rows at most.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of a row: every value as its UTF-8 length, a colon and the value; `-` for null."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, ...) with pos, the place of each row in its group by `order` (nulls first, bytewise), and n, the group's size."""
    placed = written(
        rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()), "manifest-order")
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("grp", part).agg(F.min("at").alias("least"), F.count("*").alias("size"))
    # a row for each group of a partition
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "part", "least", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy("grp")).alias("n"))
    p, r = placed.withColumn("part", part).alias("p"), runs.alias("r")
    return p.join(r, F.col("p.grp").eqNullSafe(F.col("r.grp")) & (F.col("p.part") == F.col("r.part"))).select(
        *[f"p.{c}" for c in rows.columns], (F.col("base") + F.col("at") - F.col("least")).alias("pos"), "r.n")


def whole(b: int) -> Column:
    """Whole part of pos / b."""
    return F.expr(f"pos div {b}")


def shrunk(b: int) -> Column:
    """Runs of b that n nodes fill."""
    return F.expr(f"(n + {b - 1}) div {b}")


def step(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """nodes (grp, pos, n, node, ...) with block, path (siblings of the ancestors inside the block, from below), and
    top, the digest of the block, in the block's first row."""
    pos, n = F.col("pos"), F.col("n")
    out = nodes.withColumn("block", whole(arity ** levels)).withColumn("d", F.col("node"))
    rows = Window.partitionBy("grp", "block").orderBy("pos")
    for level in range(levels):
        offset = arity ** level
        index = whole(offset)
        slot, count = index % arity, shrunk(offset)
        run = F.least(F.lit(arity).cast("bigint"), count - (index - slot))
        is_node, grows = pos % offset == 0, n > offset
        left = [F.when(slot >= k, F.lag("d", k * offset).over(rows)).otherwise("") for k in range(arity - 1, 0, -1)]
        right = [F.when(slot + k < run, F.lead("d", k * offset).over(rows)).otherwise("") for k in range(1, arity)]
        out = out.withColumn("s", F.when(is_node & grows, F.struct(F.concat(*left).alias("l"), F.concat(*right).alias("r"))))
        parent = F.when(grows, F.when(is_node & (slot == 0), digest(F.col("d"), F.col("s.r")))).otherwise(F.col("d"))
        out = out.withColumn("d", parent).withColumnRenamed("s", f"s{level}")
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.filter(F.array(*[F.last(f"s{level}", ignorenulls=True).over(upto) for level in range(levels)]), lambda s: s.isNotNull())
    top = F.when(pos % (arity ** levels) == 0, F.col("d"))
    return out.select(*nodes.columns, "block", path.alias("path"), top.alias("top"))


def climb(nodes: DataFrame, arity: int, levels: int, extend=None) -> DataFrame:
    """nodes with path up to the group's last node and that node as `subroot`. extend: what joins (grp, subroot) rows
    to further columns (path_on, ...), which are appended to the paths and handed down."""
    low = written(step(nodes, arity, levels), "manifest-step")
    tops = low.where("top is not null").select("grp", F.col("block").alias("pos"), shrunk(arity ** levels).alias("n"), F.col("top").alias("node"))
    most = tops.agg(F.max("n")).first()[0] or 1
    if most > 1:
        up = climb(tops, arity, levels, extend)
    else:
        up = tops.withColumn("path", F.array().cast(PATH)).withColumn("subroot", F.col("node"))
        if extend:
            up = extend(up)
    own = [c for c in up.columns if c not in ("grp", "pos", "n", "node", "path")]
    a, b = low.alias("a"), up.alias("b")
    on = F.col("a.grp").eqNullSafe(F.col("b.grp")) & (F.col("a.block") == F.col("b.pos"))
    return a.join(b, on).select(*[f"a.{c}" for c in nodes.columns], F.concat("a.path", "b.path").alias("path"), *[f"b.{c}" for c in own])


def proofs(leaves: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """leaves: grp, id, node (digest), and any other columns. Adds path (siblings up to the root), subroot and root.

    Leaves of a group ascend by id (null first), rows of one id by digest; groups ascend by grp (null first).
    """
    seat = ranked(leaves, ["id", "node"])

    def across(up: DataFrame) -> DataFrame:
        subroots = written(up, "manifest-subroots")
        groups = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("node"))
        groups = climb(ranked(groups, ["name"]), arity, levels)
        a, b = subroots.alias("a"), groups.alias("b")
        return a.join(b, F.col("a.grp").eqNullSafe(F.col("b.name"))).select(
            "a.grp", "a.pos", "a.n", "a.node", F.concat("a.path", "b.path").alias("path"), "a.subroot", F.col("b.subroot").alias("root"))

    return climb(seat, arity, levels, across)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def verify(docs: DataFrame, claimed: DataFrame, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS,
           arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Proofs of all rows of docs, and whether the same rows as `claimed` has them still fold to the root.

    claimed: docs with the fields as they are to be verified, as one struct column `claim` beside the columns of docs. Returns
    order column, leaf, subroot, root, proof_sha256, folded_root, verified, one row for each row of docs. Any field may
    be null; other columns are not carried; an empty table gives no rows.
    """
    leaves = claimed.select(F.col(group).alias("grp"), F.col(order).alias("id"), leaf([F.col(f) for f in fields]).alias("node"), leaf([F.col(f"claim.{f}") for f in fields]).alias("claimed"))
    got = proofs(leaves, arity, levels)
    return got.select(
        F.col("id").alias(order), F.col("node").alias("leaf"), "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("claimed"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def with_claim(docs: DataFrame, changed: dict[str, Column], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The fields of docs, and beside them as struct `claim` the fields after changes."""
    return docs.select(*fields, F.struct(*[changed.get(f, F.col(f)).alias(f) for f in fields]).alias("claim"))


def op13_window_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents; texts of every second row (by checksum of its id) are tampered with: line breaks deleted."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verify(docs, with_claim(docs, {"text": F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))}))


def _levels(name: str, key: str, nodes: str, walkers: str, levels: int) -> str:
    """CTEs: nodes of each level, and walkers (acc, proof) that meet their siblings there."""
    out = f"{name}0 AS MATERIALIZED ({nodes}), {name}w0 AS MATERIALIZED ({walkers})"
    for k in range(levels):
        out += f""", {name}r{k} AS MATERIALIZED (
  SELECT {key}, pos // 3 AS run, list(node ORDER BY pos) AS kids, max(n) AS n FROM {name}{k} GROUP BY {key}, pos // 3),
{name}{k + 1} AS MATERIALIZED (
  SELECT {key}, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS node, (n + 2) // 3 AS n FROM {name}r{k}),
{name}w{k + 1} AS MATERIALIZED (
  SELECT w.* EXCLUDE (pos, acc, proof), w.pos // 3 AS pos,
    CASE WHEN r.n > 1 THEN sha256(array_to_string(r.kids[1:w.pos % 3], '') || acc || array_to_string(r.kids[w.pos % 3 + 2:], '')) ELSE acc END AS acc,
    CASE WHEN r.n > 1 THEN proof || array_to_string(r.kids[1:w.pos % 3], '') || array_to_string(r.kids[w.pos % 3 + 2:], '') ELSE proof END AS proof
  FROM {name}w{k} w JOIN {name}r{k} r ON w.{key} IS NOT DISTINCT FROM r.{key} AND w.pos // 3 = r.run)"""
    return out


#: Enough levels for 3 ** 13 rows of a source and 3 ** 7 sources.
_DEPTH, _GROUP_DEPTH = 13, 7
_FIELD_SQL = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
OP13_SQL = (
    """WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (
  SELECT *, list_reduce(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295) AS inverted FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT doc_id, source, sha256(""" + " || ".join(_FIELD_SQL.format(f) for f in FIELDS) + """) AS leaf,
    sha256(""" + " || ".join(_FIELD_SQL.format("CASE WHEN inverted % 2 = 1 THEN replace(text, chr(10), '') ELSE text END" if f == "text" else f) for f in FIELDS) + """) AS acc,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
""" + _levels("s", "source", "SELECT source, pos, leaf AS node, n FROM leaves", "SELECT doc_id, source, leaf, pos, acc, '' AS proof FROM leaves", _DEPTH) + f""",
subs AS MATERIALIZED (
  SELECT 0 AS g, source AS name, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s{_DEPTH}),
""" + _levels("g", "g", "SELECT g, pos, subroot AS node, n FROM subs", f"SELECT w.doc_id, w.leaf, 0 AS g, subs.subroot, subs.pos, w.acc, w.proof FROM sw{_DEPTH} w JOIN subs ON w.source IS NOT DISTINCT FROM subs.name", _GROUP_DEPTH) + f"""
SELECT doc_id, leaf, subroot, (SELECT node FROM g{_GROUP_DEPTH}) AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = (SELECT node FROM g{_GROUP_DEPTH}) AS verified
FROM gw{_GROUP_DEPTH}""")
