"""Feed rows dealt over tasks."""

from pyspark.sql import functions as F

from skuforge.operators import stages
from skuforge.plans import catalog_queries as cq
from skuforge.sources import sample_feed


def parts(spark, folder, n):
    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("bolt").alias("p_name"), F.lit(3).alias("p_size"))
    folder.mkdir(exist_ok=True)
    rows.toPandas().to_parquet(folder / "part.parquet")
    return str(folder)


def test_a_small_file_of_many_rows_is_many_tasks(spark, tmp_path):
    folder = parts(spark, tmp_path, 45_000)
    rows = sample_feed.feed(spark, folder)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) == 5 and max(sizes) < 2 * stages.ROWS_A_TASK
    assert rows.agg(F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (45_000, 1, 45_000)
    assert stages.spread(spark.range(10)).count() == 10 and stages.spread(spark.range(0)).count() == 0


def test_a_part_stream_is_many_tasks(spark, tmp_path):
    folder = parts(spark, tmp_path / "in", 2_000)
    out = str(tmp_path / "out")
    stream = cq._part_stream(spark, folder).select("row_id", F.spark_partition_id().alias("task"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).agg(F.count_distinct("row_id"), F.count_distinct("task") > 4).first()[:] == (2_000, True)


def test_scored_pairs_are_dealt_by_rows(spark, monkeypatch):
    fields = ("manufacturer_name", "brand_name", "invoice_desc", "mobile_desc", "short_desc")
    rows = spark.range(25_000).select(F.col("id").alias("row_id"), F.struct(*[F.lit(f).alias(f) for f in fields]).alias("enriched"))
    labels = spark.range(25_000).select((F.col("id") * 10).alias("truth_id"), *[F.lit("x").alias(c) for c in ("MANUFACTURER_NAME", "BRAND_NAME", "SHORT_DESC")])
    monkeypatch.setattr(cq, "results", lambda *_: rows)
    monkeypatch.setattr(cq, "truth", lambda *_: labels)
    found = cq.scored_pairs(spark, "").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.sum("row_index").alias("ids")).collect()
    assert len(found) == 3 and max(r["rows"] for r in found) < 1.1 * stages.ROWS_A_TASK
    assert (sum(r["rows"] for r in found), sum(r["ids"] for r in found)) == (25_000, sum(range(25_000)))
