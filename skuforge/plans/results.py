"""The results table: enrich once, query many times.

Result columns are deep expression trees. A filter on one of them would be pushed below the
projections and evaluated a second time, so everything that filters, joins or counts results reads
a written table instead. The table lives in the folder the cluster shares
(`spark.checkpoint.dir`); losing an executor costs a task, never the table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, from `spark.checkpoint.dir`.

    A session of one machine without the setting (tests) gets a folder of its own; on a cluster a
    machine-local folder would lose rows, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="skuforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skuforge/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
