"""Delivery files: CSV as spreadsheet programs expect it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.operators.delivery import check_headers, deliverable, to_delivery
from skuforge.plans.pipeline import run
from skuforge.plans.results import written
from skuforge.sources.feed import read_csv, read_feed, with_row_ids

BOM = "\ufeff"


def write_delivery(delivery: DataFrame, path: str, single_file: bool = False) -> None:
    """Writes delivery rows as UTF-8 CSV with byte-order mark, header and CRLF line ends. Parts
    are written in parallel, each a complete file; `single_file` is for small hand-offs only."""
    check_headers(delivery.columns)
    out = delivery.coalesce(1) if single_file else delivery
    first = delivery.columns[0]
    out = out.select(F.col(f"`{first}`").alias(BOM + first), *[F.col(f"`{c}`") for c in delivery.columns[1:]])
    (
        out.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("quote", '"')
        .option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_delivery(spark: SparkSession, path: str) -> DataFrame:
    """Delivery rows as written."""
    return read_csv(spark, path)


def feed_to_delivery(spark: SparkSession, source: str, target: str, **options) -> None:
    """Feed file to delivery file; rows without an enriched record are left out. The results are
    written once in between, so that the 252 columns are cut from finished records."""
    results = written(run(with_row_ids(read_feed(spark, source, positions=True, **options))), "results")
    write_delivery(to_delivery(deliverable(results)), target)


__all__ = ["feed_to_delivery", "read_delivery", "write_delivery"]
