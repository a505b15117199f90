r"""WARC archives: writing with deduplicated payloads, reading by verified record boundaries.

Writing is native: one text row a record, `\r\n\r\n` between rows. Only the first of records with
equal payloads carries the payload; the others are revisits. The table of repeated payloads has a row
for each payload that occurs twice or more; Spark broadcasts it or not by its size.

Reading splits archives at every occurrence of the version line, in any byte range, so a task knows
only candidates: a version line inside a payload looks like a record start. Each task emits for each
candidate the offset of its successor (from Content-Length), and shortens the chains inside its range:
where a chain that enters at this candidate leaves the range. Pointer jumping over those exits, doubling
the length of the jumps each round, finds where the chain from the file's start enters each range; the
number of rounds is the logarithm of the ranges a file has. A candidate is a record if it lies on that
chain, which the task has encoded as an interval of its forest. Candidates inside payloads are never
reached. Records that a false candidate had cut are put together again from their pieces.

An archive that does not begin with the version line, or whose chain leaves the boundaries, gives the
records up to that point.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import small_batches, table
from skuforge.plans.results import shared_folder, written

MAGIC = "WARC/1.1\r\n"
ID = "urn:page:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_digest, record_type and refers_to.

    Of equal payloads of at least min_bytes bytes the smallest page_id is the response. Null html is an
    empty payload. Rows that share the smallest page_id are all responses; rows without page_id are
    responses that nothing refers to.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumn("payload_digest", base32_sha1(F.col("payload").cast("binary")))
    twice = (
        base.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest", F.octet_length("payload").alias("size"))
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("payload_digest", "size", "first")
    )
    twice = written(twice, "warc-repeated")
    again = F.col("first") < F.col("page_id")
    joined = base.withColumn("size", F.octet_length("payload")).join(twice, ["payload_digest", "size"], "left")
    return joined.select(
        "page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One WARC file a partition under path."""
    r = records(pages, min_bytes)
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(NL + NL))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), "record_type", F.lit(f"{NL}WARC-Record-ID: <{ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(f">{NL}WARC-Date: {DATE}{NL}"), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(NL)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), "payload_digest",
        F.coalesce(F.concat(F.lit(f"{NL}WARC-Profile: {PROFILE}{NL}WARC-Refers-To: <{ID}"), F.col("refers_to").cast("string"), F.lit(">")), F.lit("")),
        F.lit(f"{NL}Content-Type: application/http;msgtype=response{NL}Content-Length: "), size.cast("string"), F.lit(NL + NL))
    r.select(F.concat(head, block).alias("value")).write.mode("errorifexists").option("lineSep", NL + NL).text(path)


FIELDS = "record_id string, record_type string, target_uri string, refers_to string, declared_digest string, payload_bytes bigint, payload_digest string"
FIELD_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_NAMES = (b"warc-record-id", b"warc-type", b"warc-target-uri", b"warc-refers-to", b"warc-payload-digest")


def parse_head(data: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Header fields, where the block begins, its length; None if this is no record header."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    size = fields.get(b"content-length", b"")
    return (fields, end + 4, int(size)) if size.isdigit() and len(size) < 19 else None


def parse_record(data: bytes, with_payload: bool) -> list:
    """Values of FIELDS, and the payload if asked for; data begins after the version line."""
    fields, begin, size = parse_head(data)
    block = data[begin:begin + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    out = [fields.get(n) for n in _NAMES]
    out = [None if v is None else v.decode("utf-8", "replace").strip("<>") for v in out]
    out[4] = out[4] and out[4].removeprefix("sha1:")
    if out[1] == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        out += [int(length[1]) if length else None, out[4]]
        return out + [None] * with_payload
    out += [len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()]
    return out + [payload] * with_payload


def forest_intervals(follows: list[int]) -> tuple[list[int], list[int]]:
    """Interval of each node of a forest in which follows[i] > i is the parent or -1: j is reached from
    i if first[j] <= first[i] <= last[j]."""
    n = len(follows)
    size = [1] * n
    for i in range(n):
        if follows[i] >= 0:
            size[follows[i]] += size[i]
    first, room, top = [0] * n, [0] * n, 0
    for i in range(n - 1, -1, -1):
        p = follows[i]
        if p < 0:
            first[i], top = top, top + size[i]
        else:
            first[i] = room[p]
            room[p] += size[i]
        room[i] = first[i] + 1
    return first, [a + s - 1 for a, s in zip(first, size)]


def candidates(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a candidate: file, block (start of the byte range), seq, at, next and exit (offsets in the
    range's own coordinates), first and last (its interval), whole, the FIELDS if it is whole, and the
    range's length with the candidate that has seq 0."""
    small_batches(spark)
    m = len(MAGIC)
    names = ["file", "block", "seq", "at", "next", "exit", "first", "last", "whole", "length", *FIELD_NAMES] + ["payload"] * with_payload

    def emit(file: str, block: int, rows: list, length: int) -> pa.RecordBatch:
        index = {r[1]: i for i, r in enumerate(rows)}
        follows = [-1 if r[2] is None else index.get(r[2], -1) for r in rows]
        exits = [None] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            if follows[i] >= 0:
                exits[i] = exits[follows[i]]
            elif rows[i][2] is not None and rows[i][2] >= length - m:
                exits[i] = rows[i][2]
        first, last = forest_intervals(follows)
        cols = [[file] * len(rows), [block] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], exits, first, last,
                [r[3] for r in rows], [length if i == 0 else 0 for i in range(len(rows))], *([r[4][k] for r in rows] for k in range(len(FIELD_NAMES) + with_payload))]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, target)], names)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = "file string, block bigint, seq bigint, at bigint, next bigint, exit bigint, first bigint, last bigint, whole boolean, length bigint, " + FIELDS + ", payload binary" * with_payload
    target = [pa.field(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, length, seq = None, [], 0, 0
        for batch in batches:
            for file, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (file, block) != now:
                    if now and rows:
                        yield emit(*now, rows, length)
                    now, rows, length, seq = (file, block), [], 0, 0
                none = [None] * (len(FIELD_NAMES) + with_payload)
                head = None if block == 0 and seq == 0 else parse_head(data)
                follow = None if head is None else length + head[1] + head[2] + 4
                whole = head is not None and head[1] + head[2] + 4 == len(data)
                # what lies before the first version line of a file stands for its start: it has no successor
                rows.append((seq, length - m, follow, whole, parse_record(data, with_payload) if whole else none))
                length += len(data) + m
                seq += 1
        if now and rows:
            yield emit(*now, rows, length)

    return chunks(spark, path).mapInArrow(run, schema)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, block, data: what stands between version lines, in file order within a byte range."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Verified records: file, offset and the FIELDS (and payload)."""
    m = len(MAGIC)
    found = candidates(spark, path, with_payload)
    found = found if with_payload else written(found, "warc-candidates")
    ranges = found.where("seq = 0").select("file", "block", "length")
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("block")  # a row for each byte range of a file
    ranges = written(ranges.withColumn("base", F.sum("length").over(w) - F.col("length")), "warc-ranges")
    most = ranges.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    placed = found.join(ranges.select("file", "block", "base"), ["file", "block"]).withColumn("offset", F.col("at") + F.col("base"))
    # pointer jumping from the start of each file over range exits
    jump = placed.where("exit is not null").select("file", F.col("offset").alias("a"), (F.col("exit") + F.col("base")).alias("b"))
    reached = ranges.where("block = 0").select("file", F.lit(0).cast("bigint").alias("a"))
    if most > 1:
        jump = written(jump, "warc-jumps")
        rounds = math.ceil(math.log2(most))
        for k in range(rounds):
            reached = written(reached.union(reached.join(jump, ["file", "a"]).select("file", F.col("b").alias("a"))).distinct(), "warc-reached")
            if k < rounds - 1:
                far = jump.select("file", F.col("a").alias("b"), F.col("b").alias("c"))
                jump = written(jump.join(far, ["file", "b"]).select("file", "a", F.col("c").alias("b")), "warc-jumps")
    entries = placed.join(reached.select("file", F.col("a").alias("offset")), ["file", "offset"]).where("at >= 0 or block > 0").select("file", "block", F.col("first").alias("entry"))
    on_chain = placed.join(entries, ["file", "block"]).where("first <= entry and entry <= last and next is not null")
    rows = on_chain.where("whole").select("file", "offset", *FIELD_NAMES, *["payload"] * with_payload)
    cut = written(on_chain.where("not whole").select("file", "offset", (F.col("next") + F.col("base")).alias("until")), "warc-cut")
    if cut.isEmpty():
        return rows
    # records with a version line inside: their pieces, read again
    need = placed.select("file", "block", "seq", F.col("offset").alias("piece_at")).join(cut, "file").where("piece_at >= offset and piece_at < until")
    need = written(need.select("file", "block", "seq", "offset", "until", "piece_at"), "warc-pieces")
    again = _numbered(spark, path).join(need, ["file", "block", "seq"])
    whole = again.groupBy("file", "offset", "until").agg(F.array_sort(F.collect_list(F.struct("piece_at", "data"))).alias("pieces"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64() if " bigint" in f else pa.string() for f in FIELDS.split(", ")] + [pa.binary()] * with_payload
        for batch in batches:
            got, keep = [], []
            for i, (offset, until, pieces) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                data = MAGIC.encode().join(p["data"] for p in pieces)
                if len(data) == until - offset - m:  # else the archive ends inside the record
                    keep.append(i)
                    got.append(parse_record(data, with_payload))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *(pa.array([g[k] for g in got], t) for k, t in enumerate(kinds))],
                                             ["file", "offset", *FIELD_NAMES, *["payload"] * with_payload])

    return rows.union(whole.mapInArrow(build, "file string, offset bigint, " + FIELDS + ", payload binary" * with_payload))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq = None, 0
        for batch in batches:
            order = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now, seq = (key, seq + 1) if key == now else (key, 0)
                order.append(seq)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order, pa.int64()), batch.column(2)], ["file", "block", "seq", "data"])

    return chunks(spark, path).mapInArrow(run, "file string, block bigint, seq bigint, data binary")


def op5_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/skuforge/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path)
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(ID) + 1}) as bigint)")
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"),
        (F.col("payload_digest") == F.col("declared_digest")).alias("intact"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h, min(page_id) OVER (PARTITION BY html) AS first,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1), '' ORDER BY i)
     FROM generate_series(0, 31) AS g(i)) AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact
FROM d
"""
