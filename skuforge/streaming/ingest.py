"""New feed files as a stream: the same row pipeline, no state, exactly-once files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skuforge.operators.kpis import batch_summary
from skuforge.plans.pipeline import run
from skuforge.sources.feed import check_files, contract_names, feed_schema, read_csv, with_row_ids

#: Files of a micro-batch.
BATCH_FILES = 1000


def feed_stream(spark: SparkSession, path: str, fmt: str = "parquet", row_id: bool = True, **options) -> DataFrame:
    """Feed files of a folder as they arrive; the schema is fixed."""
    reader = spark.readStream.format(fmt).schema(feed_schema(row_id=row_id)).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.load(path)


def stream_enrich(feed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Enriches what has arrived since the last run, then stops."""
    return (
        run(feed).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_counters(feed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes the counters of every micro-batch into its own folder; a repeated batch overwrites
    its own counters, so they stay exact after a failure."""

    def count(batch: DataFrame, batch_id: int) -> None:
        summary = batch_summary(run(batch)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        summary.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        feed.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def file_stream(spark: SparkSession, folder: str, batch_files: int = BATCH_FILES) -> DataFrame:
    """Paths of the files of a folder as they arrive; their content is not read here."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", batch_files).load(folder)
    return found.select("path")


def stream_feed_files(spark: SparkSession, folder: str, target: str, checkpoint: str, batch_files: int = BATCH_FILES) -> StreamingQuery:
    """Feed files of a folder to results and counters, once through the pipeline.

    Every micro-batch checks the header of each of its files and reads the fit ones by column name, numbers the rows on from
    the batches before it, enriches them once into `target`/rows/batch=N and counts that table into `target`/counters/batch=N;
    unfit files go to `target`/rejected/batch=N with their problem. A batch that is repeated after a failure overwrites its own
    folders with the same rows: ids hang on the counters of earlier batches and on the order of files and lines alone.
    """

    def batch(paths: DataFrame, batch_id: int) -> None:
        session = paths.sparkSession
        files = sorted(r["path"] for r in paths.collect())  # batch_files at most
        if not files:
            return
        checked = check_files(session, files).collect()
        bad = [(r["file"], r["problem"]) for r in checked if r["problem"]]
        good = sorted(r["file"] for r in checked if not r["problem"])
        session.createDataFrame(bad, "file string, problem string").write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
        out = f"{target}/rows/batch={batch_id}"
        start = 0
        if batch_id:
            before = session.read.schema("processed bigint, batch int").option("basePath", f"{target}/counters").parquet(f"{target}/counters")
            start = before.where(F.col("batch") < batch_id).agg(F.sum("processed")).first()[0] or 0
        if good:
            rows = with_row_ids(read_csv_rows(session, good))
        else:
            rows = session.createDataFrame([], feed_schema(row_id=True))
        run(rows.withColumn("row_id", F.col("row_id") + F.lit(start))).write.mode("overwrite").parquet(out)
        summary = batch_summary(session.read.parquet(out))
        summary.write.mode("overwrite").parquet(f"{target}/counters/batch={batch_id}")

    found = file_stream(spark, folder, batch_files)
    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_csv_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows of files whose headers are fit, with their place; files without data rows add none."""
    return read_csv(spark, files, positions=True, checked=contract_names)
