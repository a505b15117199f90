"""Feed and truth files."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuforge import rules
from skuforge.plans.results import written

C = F.col
_FILLED = r"[^\x00-\x20]"
_FILE, _BLOCK = "_metadata.file_path", "_metadata.file_block_start"
#: Where a row stands in the input: its file, and the start of its byte range.
POSITION = ("_file", "_block")


class FeedError(ValueError):
    """A file that is no usable feed."""


class Layout(NamedTuple):
    """Files with one header line; `broken`: lines of theirs end inside a quoted cell."""

    names: list[str]
    broken: bool
    files: list[str]


def feed_schema(columns: Sequence[str] = tuple(rules.FEED_COLUMNS), row_id: bool = False) -> T.StructType:
    """All text, so that part numbers never change their form."""
    fields = [T.StructField("row_id", T.LongType())] if row_id else []
    return T.StructType(fields + [T.StructField(c, T.StringType()) for c in columns])


def missing_columns(columns: Sequence[str]) -> list[str]:
    """Required columns that are absent, in contract order; case and outer blanks do not count."""
    have = {str(c).strip().lower() for c in columns}
    return [c for c in rules.REQUIRED_COLUMNS if c.lower() not in have]


def duplicate_names(columns: Sequence[str | None]) -> list[str]:
    """Names that occur twice, case and outer blanks aside; blank names do not count."""
    names = [str(c).strip().lower() for c in columns if c is not None and str(c).strip()]
    return [n for n in dict.fromkeys(names) if names.count(n) > 1]


def layouts(spark: SparkSession, path: str | list[str]) -> list[Layout]:
    """The header lines of all files under path (the first line of a file that is not blank), with
    their files in order. Files without a line are left out.

    One pass over the lines as text, with one hash aggregate by file: the hash of its first line, and
    whether a line has an odd number of quotes, so that its record goes on in the next line.
    """
    lines = spark.read.text(path).select("value", C(_FILE).alias("file"), C(_BLOCK).alias("block"))
    at = F.when((C("block") == 0) & C("value").rlike(_FILLED), C("at"))
    quotes = F.length("value") - F.length(F.replace(C("value"), F.lit('"'), F.lit("")))
    files = (
        lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file")
        .agg(F.min_by(F.xxhash64("value"), at).alias("head"), F.max(quotes % 2 == 1).alias("broken"))
        .where("head is not null").orderBy("file").collect()  # a row for each file
    )
    found: dict[tuple[int, bool], list[str]] = {}
    for r in files:
        found.setdefault((r["head"], r["broken"]), []).append(r["file"])
    return [Layout(_header(spark, path, names[0]), broken, names) for (_, broken), names in found.items()]


def _header(spark: SparkSession, path: str | list[str], file: str) -> list[str]:
    first = spark.read.text(path).where((C(_FILE) == file) & (C(_BLOCK) == 0) & C("value").rlike(_FILLED)).select("value").first()
    return next(csv.reader([first[0].lstrip("\ufeff")]))


def read_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool | None = None, positions: bool = False,
    checked: Callable[[list[str]], list[str]] | None = None,
) -> DataFrame:
    """CSV with every cell as text; missing cells are ''. Columns go by name: files may have their
    columns in any order, and a column that a file lacks is '' for its rows.

    `multi_line` None: files with line breaks inside cells are read whole, the others are split;
    True or False holds for all files. `positions` adds the columns POSITION. `checked` gets the
    names of each header line and returns those to use, or raises. Raises FeedError for files
    without a line and for duplicate columns.
    """
    found = layouts(spark, path)
    if not found:
        raise FeedError("the file is empty")
    parts = []
    for names, broken, files in found:
        double = duplicate_names(names)
        try:
            if double:
                raise FeedError(f"duplicate columns: {', '.join(double)}")
            names = checked(names) if checked else names
        except FeedError as problem:
            raise problem if len(found) == 1 else FeedError(f"{problem} (in {files[0]})") from None
        names = [n if n.strip() else f"_c{i}" for i, n in enumerate(names)]
        rows = (
            spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
            .options(header=True, quote='"', escape='"', encoding="UTF-8", multiLine=broken if multi_line is None else multi_line).csv(path)
        )
        if len(found) > 1:
            rows = rows.where(C(_FILE).isin(files))
        place = [C(_FILE).alias("_file"), C(_BLOCK).alias("_block")] if positions else []
        parts.append(rows.select(*[C("`" + n.replace("`", "``") + "`") for n in names], *place))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).na.fill("")


def contract_names(names: list[str]) -> list[str]:
    """Header names under their contract names; raises FeedError if a required one is missing."""
    missing = missing_columns(names)
    if missing:
        raise FeedError(f"missing columns: {', '.join(missing)}")
    contract = {c.lower(): c for c in rules.FEED_COLUMNS}
    return [contract.get(c.strip().lower(), c) for c in names]


def read_feed(spark: SparkSession, path: str | list[str], multi_line: bool | None = None, positions: bool = False) -> DataFrame:
    """A checked feed of one or more files with its columns under their contract names; raises
    FeedError if any file's header is unfit. See read_csv for the other arguments."""
    rows = read_csv(spark, path, multi_line, positions, contract_names)
    if rows.isEmpty():
        raise FeedError("the file has no data rows")
    return rows


def check_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (file, columns, problem): what read_feed would say of each file by itself; problem is NULL for a fit header.

    A row for each file; the cells are not read.
    """
    found = []
    for names, _, files in layouts(spark, paths):
        double = duplicate_names(names)
        missing = missing_columns(names)
        problem = f"duplicate columns: {', '.join(double)}" if double else f"missing columns: {', '.join(missing)}" if missing else None
        found += [(f, len(names), problem) for f in files]
    given = spark.read.format("binaryFile").load(paths).select(C("path").alias("file"))
    checked = spark.createDataFrame(found, "file string, columns int, problem string")
    return given.join(checked, F.regexp_replace(given["file"], "^[a-z]+:/*", "/") == F.regexp_replace(checked["file"], "^[a-z]+:/*", "/"), "left").select(
        given["file"], F.coalesce("columns", F.lit(0)).alias("columns"), F.when(C("columns").isNull(), "the file is empty").otherwise(C("problem")).alias("problem"))


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Without rows whose cells are all NULL (as spreadsheets leave them behind); row ids do not count as cells."""
    return df.na.drop("all", subset=[c for c in df.columns if c != "row_id"])


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Numbers rows from 1 in input order: by file and place in it if df is straight from
    `read_feed(..., positions=True)` (whose POSITION columns go), else by partition.

    The rows are written once with their place, so ids do not hang on how a later scan is split or on
    which executors live. Counts of byte ranges give the offsets: summed inside each file, then over
    one row for each file.
    """
    df = df.drop(name)
    columns = [c for c in df.columns if c not in POSITION]
    if len(columns) == len(df.columns):
        df = df.withColumn("_file", F.lit("")).withColumn("_block", F.spark_partition_id().cast("bigint"))
    marked = written(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    inside = Window.partitionBy("_file").orderBy("_block")
    ranges = marked.groupBy(*POSITION).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    ranges = written(ranges.withColumn("_before", F.sum("_n").over(inside) - C("_n")), "numbered-ranges")
    files = ranges.groupBy("_file").agg(F.sum("_n").alias("_all"))
    files = files.select("_file", (F.sum("_all").over(Window.orderBy("_file")) - C("_all")).alias("_start"))
    offsets = ranges.join(files, "_file").select(*POSITION, (C("_start") + C("_before") - C("_from") + 1).alias("_off"))
    return marked.join(offsets, list(POSITION)).select((C("_off") + C("_at")).alias(name), *[C(f"`{c}`") for c in columns])
