"""CSV records with line breaks in their cells, read range by range, and faulty records kept with a reason.

A line is read by the usual rules: a quote opens a cell only where the cell begins, so an inch mark inside an unquoted cell
is a character like any other. Whether a byte range begins inside a quoted cell is known once all ranges before it
are; each range is therefore a function from "begins outside / inside" to "ends outside / inside". The first scan works
out these functions and the header lines, folding them over the ranges of a file gives the state at the start of
each. The second scan assembles records. What a range begins with in the middle of a record, and the record it ends in
the middle of, go through one small shuffle by file and are put together there; all other records stay where they were read.

If a file ends inside a quoted cell, its last opening quote has no partner: the line with it is a faulty record, and
every later line of the file stands for itself. No line is swallowed, and no task reads more than its range.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.plans.results import written
from skuforge.sources.feed import FeedError, contract_names, duplicate_names

C = F.col
UNBALANCED = "a quote has no partner"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that begins outside or inside of one."""
    if '"' not in line:
        return inside
    at, quoted = 0, inside
    while True:
        if not quoted:
            if line[at:at + 1] == '"':
                at, quoted = at + 1, True
                continue
        else:
            close = line.find('"', at)
            if close < 0:
                return True
            if line[close + 1:close + 2] == '"':
                at = close + 2
                continue
            at, quoted = close + 1, False
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for line, file, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
            yield (file, block), line


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: its header line (first range only), and for a beginning outside and inside of a cell the end, and
    whether the cell that is open at the end was opened here."""
    rows: list[dict] = []
    here, head = None, None
    out, own = [False, True], [False, False]

    def done() -> None:
        if here:
            rows.append({"file": here[0], "block": here[1], "head": head, "out0": out[0], "own0": own[0], "out1": out[1], "own1": own[1]})

    for place, line in _lines(batches):
        if place != here:
            done()
            here, head, out, own = place, None, [False, True], [False, False]
        if place[1] == 0 and head is None:
            if line.strip(" \t\x0b\x0c\r\0"):
                head = line.lstrip("﻿")
            continue
        if '"' in line:
            for k in (0, 1):
                after = ends_inside(line, out[k])
                # a line that both closes and opens makes the cell its own
                own[k] = after and (own[k] if out[k] and not _closes(line) else True)
                out[k] = after
    done()
    kind = pa.schema([("file", pa.string()), ("block", pa.int64()), ("head", pa.string()), ("out0", pa.bool_()), ("own0", pa.bool_()), ("out1", pa.bool_()), ("own1", pa.bool_())])
    yield pa.RecordBatch.from_pylist(rows, kind)


def _closes(line: str) -> bool:
    """Whether a line that begins inside of a cell closes it."""
    at = line.find('"')
    while at >= 0:
        if line[at + 1:at + 2] != '"':
            return True
        at = line.find('"', at + 2)
    return False


def _fold(ranges: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file that do not simply begin and end as usual: start inside, `last` (its open record never ends), `alone` (behind it)."""
    ranges = ranges.sort_values("block")
    inside, opened, out = False, -1, []
    for r in ranges.itertuples():
        out.append([r.file, r.block, inside, False, False])
        end, own = (r.out1, r.own1) if inside else (r.out0, r.own0)
        if end and own:
            opened = r.block
        inside = end
    if inside:
        for row in out:
            row[3], row[4] = row[1] == opened, row[1] > opened
            row[2] = row[2] and not row[4]
    return pd.DataFrame([r for r in out if r[2] or r[3] or r[4]], columns=["file", "block", "inside", "last", "alone"])


def parse(text: str) -> list[str]:
    """Cells of one record."""
    return next(csv.reader(text.split("\n") if "\n" not in text else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]), [])


def fault(cells: list[str], width: int, open_quote: bool) -> str | None:
    if open_quote:
        return UNBALANCED
    return None if len(cells) == width else f"{len(cells)} cells, expected {width}"


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of one or more feed files: row_id (from 1, by file and place), the columns of the feed contract that a file has
    (absent ones and missing cells are '', cells beyond the header go), `problem` (NULL for a sound record) and `record`, the raw text of a
    record with a problem.

    Raises FeedError if there is no line, or if a header lacks a required column or has a name twice. Blank lines are skipped.
    A header is one line; the order of its columns may differ from file to file.
    """
    lines = spark.read.text(path).select("value", C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block"))
    states = written(lines.mapInArrow(_states, "file string, block bigint, head string, out0 boolean, own0 boolean, out1 boolean, own1 boolean"), "record-ranges")
    # of a range without lines nothing is known and nothing is needed
    heads = {r["file"]: r["head"] for r in states.where("head is not null").select("file", "head").collect()}  # a row for each file
    if not heads:
        raise FeedError("the file is empty")
    places: dict[str, tuple[int, list[int]]] = {}
    columns = list(rules.FEED_COLUMNS)
    for file, head in heads.items():
        if head not in places:
            raw = next(csv.reader([head]))
            double = duplicate_names(raw)
            try:
                if double:
                    raise FeedError(f"duplicate columns: {', '.join(double)}")
                names = contract_names(raw)
            except FeedError as problem:
                raise problem if len(heads) == 1 else FeedError(f"{problem} (in {file})") from None
            places[head] = len(names), [names.index(c) if c in names else -1 for c in columns]
    odd = states.groupBy("file").applyInPandas(_fold, "file string, block bigint, inside boolean, last boolean, alone boolean").collect()  # ranges cut inside a cell
    known = spark.sparkContext.broadcast((heads, places, {(r["file"], r["block"]): (r["inside"], r["last"], r["alone"]) for r in odd}))
    kind = "file string, block bigint, n bigint, kind string, cells array<string>, problem string, record string"

    def cells_of(file: str, text: str, open_quote: bool) -> tuple[list[str], str | None]:
        heads, places, _ = known.value
        width, at = places[heads[file]]
        cells = parse(text)
        return [cells[k] if 0 <= k < len(cells) else "" for k in at], fault(cells, width, open_quote)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        here, pending, inside, n, mode = None, [], False, 0, (False, False, False)
        headless = False

        def put(kind: str, text: str, open_quote: bool = False) -> None:
            nonlocal n
            cells, problem = (None, None) if kind != "row" else cells_of(here[0], text, open_quote)
            rows.append({"file": here[0], "block": here[1], "n": n, "kind": kind, "cells": cells, "problem": problem, "record": text if problem or kind != "row" else None})
            n += kind == "row"

        def line_alone(line: str) -> None:
            if line:
                put("row", line, ends_inside(line, False))

        def close() -> None:
            if pending:
                if mode[1]:
                    for x in pending:
                        line_alone(x)
                else:
                    put("head" if headless else "tail", "\n".join(pending))

        for place, line in _lines(batches):
            if place != here:
                close()
                here, n, pending = place, 0, []
                mode = known.value[2].get(place, (False, False, False))
                inside = headless = mode[0]
                skip = place[1] == 0
            if skip:
                skip = not line.strip(" \t\x0b\x0c\r\0")
                continue
            if mode[2]:
                line_alone(line)
            elif not pending and not inside and '"' not in line:
                if line:
                    put("row", line)
            else:
                inside = ends_inside(line, inside)
                pending.append(line)
                if not inside:
                    if headless:
                        put("head", "\n".join(pending))
                    elif len(pending) > 1 or line:
                        put("row", "\n".join(pending))
                    pending, headless = [], False
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        close()
        yield _batch(rows)

    found = written(lines.mapInArrow(assemble, kind), "records")
    # a tail is the start of a record, the heads up to the next tail are its rest; `last` tails were taken apart above
    parts = found.where("kind <> 'row'")
    by_file = Window.partitionBy("file").orderBy("block", "kind")  # of one range the head comes before the tail
    parts = parts.withColumn("start", F.max(F.when(C("kind") == "tail", C("block"))).over(by_file)).withColumn("rows_before", C("n"))
    joined = parts.groupBy("file", "start").agg(
        F.sort_array(F.collect_list(F.struct("block", "kind", "record"))).alias("parts"), F.max(F.when(C("kind") == "tail", C("n"))).alias("n"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                # the tail sorts behind the head of its own range, which belongs to the record before
                text = "\n".join(p["record"] for p in r["parts"])
                cells, problem = cells_of(r["file"], text, False)
                rows.append({"file": r["file"], "block": r["start"], "n": r["n"], "kind": "row", "cells": cells, "problem": problem, "record": text if problem else None})
            yield _batch(rows)

    every = written(found.where("kind = 'row'").union(joined.mapInArrow(finish, kind)), "records-joined")
    counts = every.groupBy("file", "block").agg(F.count("*").alias("size"))
    ranges = written(counts.withColumn("inside", F.sum("size").over(Window.partitionBy("file").orderBy("block")) - C("size")), "record-counts")
    files = ranges.groupBy("file").agg(F.sum("size").alias("all"))
    files = files.select("file", (F.sum("all").over(Window.orderBy("file")) - C("all")).alias("before"))  # a row for each file
    offsets = ranges.join(files, "file").select("file", "block", (C("before") + C("inside")).alias("first"))
    return every.join(offsets, ["file", "block"]).select(
        (C("first") + C("n") + 1).alias("row_id"), *[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(columns)], "problem", "record")


_BATCH = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("kind", pa.string()), ("cells", pa.list_(pa.string())), ("problem", pa.string()), ("record", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _BATCH)


def error_records(rows: DataFrame) -> DataFrame:
    """Records with a problem as error rows: row_id, status, stage, message, record. They never reach the engines."""
    return rows.where(C("problem").isNotNull()).select(
        "row_id", F.lit("error").alias("status"), F.lit("parse").alias("stage"), F.concat(F.lit("malformed record: "), "problem").alias("message"), "record")


def sound_records(rows: DataFrame) -> DataFrame:
    return rows.where(C("problem").isNull()).drop("problem", "record")
