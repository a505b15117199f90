"""Results kept by ranges of row ids: pages through a count index, decisions merged into the ranges they touch.

A range is a partition folder, so a page reads the one or two ranges that hold it, however deep it lies, and a
decision rewrites the range of its row and leaves all other files as they are. The index has a row for each range and
status; ranges widen with the largest row id, so there are RANGES of them at most and whatever is collected here is
bounded by that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuforge.operators.serve import apply_decisions
from skuforge.plans.results import written

C = F.col
RANGE_ROWS = 20_000
RANGES = 10_000
#: Range folders that a task writes.
FOLDERS_A_TASK = 16
DECISION = "struct<action:string,comment:string,at:timestamp>"


class RangedResults:
    """Results under `path`; `width` row ids share a range."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.width = int(spark.read.parquet(f"{path}/width").first()[0])
        self.schema = spark.read.parquet(f"{path}/columns").schema

    @classmethod
    def write(cls, results: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> RangedResults:
        """Stores results (row_id, status, ...; a decision column of an earlier state is kept)."""
        top = results.agg(F.max("row_id")).first()[0] or 0
        width = max(range_rows, -(-(top + 1) // RANGES))
        if "decision" not in results.columns:
            results = results.withColumn("decision", F.lit(None).cast(DECISION))
        spark = results.sparkSession
        spark.range(1).select(F.lit(width).alias("width")).write.parquet(f"{path}/width")
        ranged = results.withColumn("id_range", F.expr(f"row_id div {width}"))
        ranged.limit(0).write.parquet(f"{path}/columns")
        _dealt(ranged, top // width + 1).write.partitionBy("id_range").parquet(f"{path}/rows")
        out = cls(spark, path)
        out._count(out.rows()).withColumn("version", F.lit(0)).write.parquet(f"{path}/index")
        return out

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def index(self) -> DataFrame:
        """id_range, status, n: the latest version."""
        every = self._versions()
        return every.where(C("version") == self._version()).drop("version")

    def _versions(self) -> DataFrame:
        return self.spark.read.schema("id_range bigint, status string, n bigint, version int").parquet(f"{self.path}/index")

    def _version(self) -> int | None:
        return self._versions().agg(F.max("version")).first()[0]

    @staticmethod
    def _count(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id_range", "status").agg(F.count("*").alias("n")).repartition(1)

    def _counts(self, status: str) -> DataFrame:
        """Ranges with the rows of a status and the rows before them; at most RANGES rows."""
        own = self.index() if status in ("", "all") else self.index().where(C("status") == status)
        own = own.groupBy("id_range").agg(F.sum("n").alias("n"))
        return own.withColumn("before", F.sum("n").over(Window.orderBy("id_range")) - C("n"))

    def _folders(self, ranges: list[int]) -> DataFrame:
        """The rows of some ranges; no other folder is listed."""
        ranges = [r for r in ranges if r is not None]  # rows without an id are on no page
        if not ranges:
            return self.rows().where("false")
        read = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows")
        return read.parquet(*[f"{self.path}/rows/id_range={r}" for r in ranges]).where(C("id_range").isin(ranges))

    def _of(self, ranges: list[int], status: str) -> DataFrame:
        rows = self._folders(ranges)
        return (rows if status in ("", "all") else rows.where(C("status") == status)).drop("id_range")

    def page(self, page: int = 1, page_size: int = 50, status: str = "all") -> DataFrame:
        """One page in row order, from the ranges that the index names."""
        size = max(1, min(page_size, 500))
        offset = (max(1, page) - 1) * size
        held = self._counts(status).where((C("before") < offset + size) & (C("before") + C("n") > offset)).sort("id_range").collect()
        skip = offset - held[0]["before"] if held else 0
        return self._of([r["id_range"] for r in held], status).orderBy("row_id").offset(skip).limit(size)

    def after(self, row_id: int, page_size: int = 50, status: str = "all") -> DataFrame:
        """The page behind a row, in row order: the same page whatever was added or decided before it."""
        size = max(1, min(page_size, 500))
        own = row_id // self.width
        counts = self._counts(status).where(C("id_range") >= own)
        # rows of later ranges before each of them; the row's own range may have none left
        later = counts.withColumn("ahead", F.sum(F.when(C("id_range") > own, C("n")).otherwise(0)).over(Window.orderBy("id_range")) - F.when(C("id_range") > own, C("n")).otherwise(0))
        held = [r["id_range"] for r in later.where(C("ahead") < size).sort("id_range").collect()]
        return self._of(held, status).where(C("row_id") > row_id).orderBy("row_id").limit(size)

    def info(self, page_size: int = 50, status: str = "all") -> DataFrame:
        """Rows and pages, from the index alone."""
        size = max(1, min(page_size, 500))
        return self._counts(status).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select("total", F.ceil(C("total") / size).alias("pages"))

    def merge(self, decisions: DataFrame) -> list[int]:
        """Merges new decisions (row_id, action, comment, at) into the rows they are about; returns the ranges written anew.

        The rules are those of `apply_decisions`, with the decision a row already has as one more. Merging the same
        decisions again changes nothing. Decisions without a row are left out.
        """
        new = written(decisions.where(C("row_id").isNotNull()).select("row_id", "action", "comment", "at"), "new-decisions")
        asked = [r[0] for r in new.select(F.expr(f"row_id div {self.width}").alias("r")).distinct().join(self.index().select(C("id_range").alias("r")).distinct(), "r", "left_semi").collect()]
        if not asked:
            return []
        rows = self._folders(asked)
        had = rows.where(C("decision").isNotNull()).select("row_id", "decision.*")
        merged = written(apply_decisions(rows.drop("decision"), new.unionByName(had)).withColumn("decision", C("decision").cast(DECISION)), "merged-ranges")
        dealt = _dealt(merged.select(*self.schema.names), len(asked))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id_range").parquet(f"{self.path}/rows")
        # one small file for each version: a file for each range costs more than its rows
        index = self.index().where(~C("id_range").isin(asked)).unionByName(self._count(merged))
        index.withColumn("version", F.lit(self._version() + 1)).repartition(1).write.mode("append").parquet(f"{self.path}/index")
        return sorted(asked)


def _dealt(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows with whole ranges in a task, FOLDERS_A_TASK of them: a folder costs a task more than the bytes in it."""
    return rows.repartition(max(1, -(-ranges // FOLDERS_A_TASK)), "id_range").sortWithinPartitions("id_range", "row_id")
