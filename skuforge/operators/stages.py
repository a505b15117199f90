"""Helpers for layered projections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feed rows of a task; a row costs the pipeline about a millisecond.
ROWS_A_TASK = 10_000


def layer(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One projection that adds `columns`.

    A later layer reads the columns of an earlier one by name. Catalyst keeps a projection of its
    own wherever a costly expression has more than one reader, so each regex runs once per row,
    and it drops whatever nobody reads.
    """
    return df.withColumns(columns)


def sealed(df: DataFrame, what: str) -> DataFrame:
    """The frame with a row counter (Dataset.observe) as its last step.

    The counter shows up as `<what>-<id>` in query listeners and in a stream's progress. It also
    keeps filters of the caller above the frame: pushed through a dozen layers they would be
    expanded into expressions that grow with every layer. Column pruning still passes.
    """
    return df.observe(f"{what}-{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))


def spread(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """The rows of a table of few columns, dealt evenly over tasks of rows_a_task rows each.

    A file of some megabytes is one split, whatever its rows cost later on. Counting reads the table once more,
    so this belongs right behind a scan.
    """
    tasks = -(-df.count() // rows_a_task)
    return df.repartition(tasks) if tasks > 1 else df
