"""Delivery contract, KPIs, truth comparison, serving, streaming."""

import csv
import glob
import io

import pytest
from pyspark.sql import functions as F

from conftest import CASES
from skuforge import rules
from skuforge.operators import delivery, kpis, serve, truth
from skuforge.operators.quality import overflow_warnings
from skuforge.sources.delivery_file import read_delivery, write_delivery
from skuforge.streaming import ingest

C = F.col
N_RECORDS = len(CASES) - 4


def test_contract():
    assert len(rules.DELIVERY_COLUMNS) == 252 == len(set(rules.DELIVERY_COLUMNS))
    good = list(rules.DELIVERY_COLUMNS)
    assert delivery.header_errors(good) == []
    assert "column order differs at index 0" in delivery.header_errors(good[1:2] + good[:1] + good[2:])[0]
    assert delivery.header_errors(good[1:]) == ["expected 252 columns, got 251", "missing columns: ['MFR URL']"]
    assert "unexpected columns: ['X']" in delivery.header_errors(good + ["X"])
    with pytest.raises(delivery.DeliveryError):
        delivery.check_headers(good[:-1])


def test_delivery_rows_and_csv(spark, results, tmp_path):
    rows = delivery.to_delivery(delivery.deliverable(results))
    assert rows.columns == rules.DELIVERY_COLUMNS
    gate = delivery.row_gate(rows).first()
    assert (gate["row_count"], gate["null_cells"]) == (N_RECORDS, 0)
    write_delivery(rows, str(tmp_path / "out"), single_file=True)
    payload = open(glob.glob(str(tmp_path / "out" / "part-*.csv"))[0], "rb").read()
    assert payload.startswith(b"\xef\xbb\xbf") and b"\r\n" in payload
    parsed = list(csv.DictReader(io.StringIO(payload.decode("utf-8-sig"), newline="")))
    golden = next(r for r in parsed if r["Mfg_Part_Num"] == "PDSH4816AF")
    assert list(golden) == rules.DELIVERY_COLUMNS
    assert golden["BRAND_NAME"] == "FRIGIDAIRE®" and golden["ATTRIBUTE_LABEL 5"] == "Installation Type"
    assert golden["ATTRIBUTE_LABEL 6"] == "" and golden["ITEM_FEATURES_3"].startswith("Engineered") and golden["Warranty"] == ""
    back = read_delivery(spark, str(tmp_path / "out"))
    assert back.count() == N_RECORDS and back.columns == rules.DELIVERY_COLUMNS


def test_overflow_texts(spark):
    df = spark.range(1).select(
        F.array_repeat(F.lit("f"), 25).alias("features"),
        F.array_repeat(F.struct(F.lit("l").alias("label"), F.lit("v").alias("value"), F.lit("").alias("uom")), 60).alias("attributes"),
    )
    assert df.select(overflow_warnings()).first()[0] == [
        "feature overflow: 25 features extracted, only first 20 exported",
        "attribute overflow: 60 attributes extracted, only first 50 exported",
    ]


def graded(spark, rows):
    return spark.createDataFrame(
        rows, "row_id long, status string, confidence double, enriched struct<classpath:string>, validation struct<invoice_char_pass:boolean,"
        "invoice_caps:boolean,schema_mobile_pass:boolean,mobile_target_pass:boolean,schema_valid:boolean,attribute_count:int>,"
        "review struct<needs_review:boolean,reasons:array<string>,categories:array<string>>"
    )


def test_histogram_edges(spark):
    scores = [0, 59, 60, 79, 80, 89, 90, 99, 100, 59.5]
    df = graded(spark, [(i, "success", float(s), None, None, (False, [], [])) for i, s in enumerate(scores)])
    assert [(r["bucket"], r["count"]) for r in kpis.confidence_histogram(df).collect()] == [
        ("0-59", 2), ("60-79", 2), ("80-89", 2), ("90-99", 2), ("100", 1)]


def test_kpi_denominators_and_empty(spark):
    ok, bad = (True, True, True, True, True, 3), (False, False, False, False, False, 0)
    df = graded(spark, [
        (1, "success", 100.0, ("A > B",), ok, (False, [], [])), (2, "review", 60.0, ("General Hardware",), ok, (True, ["x classpath y", "z"], ["generic_taxonomy"])),
        (3, "error", 0.0, None, bad, (True, ["schema stage failed: q"], ["processing_error"])),
    ])
    k = kpis.kpis(df).first()
    assert (k["total"], k["success"], k["review"], k["errors"]) == (3, 1, 1, 1)
    assert k["success_rate"] == 33.33 and k["avg_confidence"] == 53.33 and k["classpath_specific_rate"] == 33.33 and k["attribute_coverage"] == 66.67
    assert {r["reason"]: r["count"] for r in kpis.reason_counts(df).collect()} == {"Generic taxonomy fallback": 1, "z": 1, "Processing error": 1}
    assert {r["category"]: r["count"] for r in kpis.category_counts(df).collect()}["all"] == 2
    empty = kpis.kpis(df.where("row_id < 0")).first()
    assert empty["total"] == 0 and empty["success_rate"] == 0.0 and empty["avg_confidence"] == 0.0


def truth_frame(spark, rows):
    columns = ["truth_id", "Mfg_Part_Num", *rules.SCORED_FIELDS]
    schema = "truth_id long, " + ", ".join(f"`{c}` string" for c in columns[1:])
    return spark.createDataFrame([tuple(r.get(c, "" if c != "truth_id" else i) for c in columns) for i, r in enumerate(rows)], schema)


def test_truth_benchmark(spark, results):
    labelled = truth_frame(spark, [
        {"Mfg_Part_Num": "pdsh4816af", "BRAND_NAME": "wrong"},
        {"Mfg_Part_Num": " PDSH4816AF ", "BRAND_NAME": "Frigidaire", "Classpath": "Appliances & Consumer Electronics>Kitchen Appliances>Built-In Dishwashers", "UNSPSC": "1"},
        {"Mfg_Part_Num": ""}, {"Mfg_Part_Num": "nobody"},
    ])
    rows = {r["field"]: r for r in truth.truth_benchmark(results, labelled).collect()}
    one = rows["BRAND_NAME"]
    assert (one["ground_truth_rows"], one["matched_rows"], one["compared"]) == (2, 1, 1)
    assert (one["exact_match_rate"], one["normalized_match_rate"]) == (0.0, 100.0)
    assert rows["Classpath"]["normalized_match_rate"] == 100.0 and rows["UNSPSC"]["normalized_match_rate"] == 0.0
    assert rows["SHORT_DESC"]["compared"] == 0 and one["overall_normalized_match_rate"] == 66.67
    assert truth.truth_benchmark(results, labelled.where("truth_id = 3")).count() == 0
    detail = truth.row_detail(results, labelled, 1).first()
    assert detail["truth"]["BRAND_NAME"] == "wrong"  # the first copy, while the benchmark takes the last
    diff = {(r["panel"], r["label"]): r for r in serve.three_way_diff(truth.row_detail(results, labelled, 1)).collect()}
    assert diff["truth", "BRAND_NAME"]["changed"] and not diff["generated", "MANUFACTURER_PART_NUMBER"]["changed"]


def test_row_scores(spark):
    columns = "MANUFACTURER_NAME string, BRAND_NAME string, INVOICE_DESC string, MOBILE_DESC string, SHORT_DESC string"
    pairs = spark.createDataFrame(
        [(0, ("Acme", "A®", "", "", "b a"), ("ACME", "A®", "INV", "m" * 60, "a b")), (1, ("Acme", "A®", "", "", "x"), ("Other", "A", "inv" * 20, "m", ""))],
        f"row_index long, gt struct<{columns.replace(' string', ':string').replace(', ', ',')}>, pred struct<{columns.replace(' string', ':string').replace(', ', ',')}>",
    )
    good, bad = sorted(truth.score_rows(pairs).collect(), key=lambda r: r["row_index"])
    assert good["confidence_score"] == 100.0 and not good["needs_human_review"]
    assert bad["confidence_score"] == 0.0 and len(bad["audit_issues"]) == 4 and bad["needs_human_review"]
    assert truth.score_summary(truth.score_rows(pairs)).first()["mfg_accuracy_pct"] == 50.0


def test_decisions(spark, results):
    queued = {r["row_id"] for r in serve.review_queue(results).collect()}
    a, b, c = sorted(queued)[:3]
    log = spark.createDataFrame(
        [(a, "approve", "", 1), (a, "reject", "late", 2), (b, "reject", "", 1), (c, "override", "", 1)], "row_id long, action string, comment string, t int"
    ).select("row_id", "action", "comment", F.timestamp_seconds("t").alias("at"))
    after = serve.apply_decisions(results, log)
    assert {r["row_id"] for r in serve.review_queue(after).collect()} == queued - {a, c}
    assert after.where(C("row_id") == a).first()["decision"]["action"] == "reject"
    assert after.count() == len(CASES)


def test_pages(results):
    assert [r["row_id"] for r in serve.page(results, 2, 5).collect()] == [6, 7, 8, 9, 10]
    assert serve.page(results, 0, 0).count() == 1
    assert serve.search(results, "DISHWASHER").count() == 1
    info = serve.page_info(results, 5).first()
    assert info["total"] == len(CASES) and info["pages"] == -(-len(CASES) // 5)


def test_stream_equals_batch(spark, results, tmp_path):
    feed = results.select("row_id", *[C("raw")[c].alias(c) for c in rules.REQUIRED_COLUMNS])
    feed.repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.feed_stream(spark, str(tmp_path / "in"))
        ingest.stream_enrich(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted((r["row_id"], r["status"], r["enriched"] and r["enriched"]["mobile_desc"]) for r in df.collect())
    assert key(out) == key(results)
