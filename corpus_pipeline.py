"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame; docs are the rows that the stage before kept, written
as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm import contamination, near, pieces, quality, surrogates
from skuforge.llm.common import free, small_batches, table
from skuforge.plans.results import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and blank texts are among them. Other columns, of any name, stay as they are."""
    name = free("quality", docs.columns)
    return quality.judged(docs, table(spark, sf_dir, "labels"), name=name).where(F.col(name)["kept"]).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more) the row with the
    smallest doc_id, and of these the smallest text key, stays, once. Rows without doc_id stay; null and blank
    texts are one group. SimHash names the first candidates; pairs that its bits would lose are added by a prefix filter, see near.py."""
    key = free("text_key", docs.columns)
    copies = free("copies", [*docs.columns, key])
    keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = near.near_duplicates(keyed.where("doc_id is not null").select("doc_id", F.col(key).alias("text_key"), "text"))
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    found = written(found.where(first).groupBy("doc_id", F.col("text_key").alias(key)).agg(F.count("*").alias(copies)), "pipeline-first")
    kept = keyed.join(found, ["doc_id", key])
    # of rows equal in id and text the smallest in a fixed order of the other columns
    every = [F.col(f"`{c}`") for c in docs.columns]
    repeated = kept.where(F.col(copies) > 1).groupBy("doc_id", key).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("row"))
    return kept.where(F.col(copies) == 1).select(*every).union(repeated.select("row.*")).union(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans go; documents that are mostly benchmark text go as a whole."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymised(docs).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts, digests and sampled segmentations of every document that is left."""
    small_batches(spark)
    return pieces.digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii_surrogates", personal_data_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: Stages 1, 2 and 5 rest on hashes and samples that SQL cannot express; tests compare run() with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
