"""Results in ranges: pages, keyset pages and merged decisions against plain ones."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from skuforge.operators import serve
from skuforge.plans.ranged import RangedResults
from skuforge.plans.results import shared_folder

IDS = [*range(1, 400), *range(1200, 1500), 5000, 5001, 9999]


@pytest.fixture()
def plain(spark):
    rows = [(i, ["success", "review", "review", "error"][i * 7 % 4], f"m{i}", (i % 3 == 0, [])) for i in IDS]
    return spark.createDataFrame(rows, "row_id long, status string, mpn string, review struct<needs_review:boolean,reasons:array<string>>")


@pytest.fixture()
def store(spark, plain):
    return RangedResults.write(plain, f"{shared_folder(spark)}/ranged-{uuid.uuid4().hex}", 100)


def ids(df):
    return [r["row_id"] for r in df.collect()]


@pytest.mark.parametrize("status", ["all", "review", "error", "none"])
def test_pages_equal_plain_pages(plain, store, status):
    for number in (0, 1, 2, 5, 9, 40):
        assert ids(store.page(number, 30, status)) == ids(serve.page(plain, number, 30, status))
    for row in (0, 1, 99, 100, 398, 399, 700, 1499, 5000, 9999, 20000):
        assert ids(store.after(row, 30, status)) == ids(serve.by_status(plain, status).where(F.col("row_id") > row).orderBy("row_id").limit(30))
    assert store.info(30, status).collect() == serve.page_info(plain, 30, status).collect()


def test_deep_page_reads_few_ranges(store):
    for rows in (store.page(22, 30), store.after(1490, 10)):
        scan = rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert "id_range" in scan and scan.count("id_range#") <= 3


def files(store):
    return {os.path.join(d, f) for d, _, names in os.walk(store.path.removeprefix("file://") + "/rows") for f in names if f.endswith(".parquet")}


def decisions(spark, rows):
    return spark.createDataFrame(rows, "row_id long, action string, comment string, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_merge_writes_only_touched_ranges(spark, plain, store):
    before = files(store)
    one = [(3, "approve", "a", "2026-01-02"), (3, "reject", "b", "2026-01-01"), (1203, "reject", "r", "2026-01-01"), (7, "noise", "x", "2026-01-05"), (777, "approve", "no such row", "2026-01-01"),
           (88888, "approve", "no such range", "2026-01-01"), (None, "approve", "", "2026-01-01")]
    assert store.merge(decisions(spark, one)) == [0, 12]
    after = files(store)
    gone = {f.split("id_range=")[1].split("/")[0] for f in before - after}
    assert gone == {"0", "12"} and len(before & after) == len(before) - 2
    two = [(3, "override", "older", "2025-12-31"), (1203, "mark_reviewed", "m", "2026-02-01"), (6, "reject", "t", "2026-01-01"), (6, "approve", "t", "2026-01-01")]
    store.merge(decisions(spark, two))
    want = serve.apply_decisions(plain, decisions(spark, [r for r in one if r[0] is not None] + two))
    pick = ["row_id", "status", "mpn", "review", F.col("decision.action").alias("action"), F.col("decision.comment").alias("comment"), F.col("decision.at").alias("at")]
    state = sorted(map(tuple, store.rows().select(*pick).collect()), key=lambda r: r[0])
    assert state == sorted(map(tuple, want.select(*pick).collect()), key=lambda r: r[0])
    # the same decisions once more
    store.merge(decisions(spark, two))
    assert sorted(map(tuple, store.rows().select(*pick).collect()), key=lambda r: r[0]) == state
    assert store.merge(decisions(spark, [])) == []
    assert ids(store.page(2, 30)) == ids(serve.page(plain, 2, 30))


def test_empty_results(spark, plain):
    store = RangedResults.write(plain.where("false"), f"{shared_folder(spark)}/ranged-{uuid.uuid4().hex}")
    assert ids(store.page(1)) == [] and ids(store.after(0)) == [] and store.info().first()["total"] == 0


def test_folders_are_dealt_over_tasks_and_the_index_is_one_file(spark, plain):
    """A range folder each 10 ids: many tasks write them, and the index needs no folder for each range."""
    store = RangedResults.write(plain, f"{shared_folder(spark)}/ranged-{uuid.uuid4().hex}", 10)
    root = store.path.removeprefix("file://")
    ranges = {d.split("id_range=")[1] for d in os.listdir(f"{root}/rows") if d.startswith("id_range=")}
    writers = {f.split("part-")[1].split("-")[0] for d, _, names in os.walk(f"{root}/rows") for f in names if f.endswith(".parquet")}
    assert len(ranges) > 70 and len(writers) > 8
    assert store.merge(decisions(spark, [(3, "approve", "a", "2026-01-02"), (1203, "reject", "r", "2026-01-01")])) == [0, 120]
    assert len([f for _, _, names in os.walk(f"{root}/index") for f in names if f.endswith(".parquet")]) == 2
    assert store.info().collect() == serve.page_info(plain).collect()
    assert ids(store.after(390, 20)) == ids(plain.where("row_id > 390").orderBy("row_id").limit(20))
