"""Benchmark: prints one JSON line with seconds per query.

The feed is one row per order line (lineitem joined to part). `enrich` runs the whole row pipeline
and writes the results table; `enrich_warm` runs it again without writing. The other queries read
the results table, as they would in production.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from skuforge.operators import delivery, kpis, serve, truth  # noqa: E402
from skuforge.plans.catalog_queries import truth_rows  # noqa: E402
from skuforge.plans.pipeline import run, tune  # noqa: E402
from skuforge.sources.sample_feed import line_feed  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    folder = tempfile.mkdtemp(prefix="skuforge-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("skuforge-bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "32m").config("spark.checkpoint.dir", folder).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.time()
        out = action()
        times[name] = round(time.time() - start, 3)
        return out

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    # lines are spread evenly before the CPU-heavy part: the tables are few small files
    feed = line_feed(spark, sf_dir).repartition(cpus * 4)
    feed.write.parquet(f"{folder}/feed")
    feed = spark.read.parquet(f"{folder}/feed")
    rows = feed.count()

    timed("enrich", lambda: run(feed).write.parquet(f"{folder}/results"))
    timed("enrich_warm", lambda: noop(run(feed)))
    results = spark.read.parquet(f"{folder}/results")
    timed("kpis", lambda: kpis.kpis(results).collect())
    timed("reason_counts", lambda: kpis.reason_counts(results).collect())
    timed("top_classpaths", lambda: kpis.top_classpaths(results).collect())
    timed("delivery_row", lambda: noop(delivery.to_delivery(delivery.deliverable(results))))
    timed("review_queue", lambda: noop(serve.review_queue(results)))
    timed("results_page", lambda: serve.page(results, 3, 100, "review").collect())
    labelled = truth_rows(results)
    labelled.write.parquet(f"{folder}/truth")
    labelled = spark.read.parquet(f"{folder}/truth")
    timed("truth_benchmark", lambda: truth.truth_benchmark(results, labelled).collect())
    spark.stop()

    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "feed_rows": rows, "rows_per_sec": {"enrich_cold": round(rows / times["enrich"]), "enrich_warm": round(rows / times["enrich_warm"])},
    }))


if __name__ == "__main__":
    main()
