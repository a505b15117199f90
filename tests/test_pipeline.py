"""Row pipeline: golden row, extraction regressions, required fields, invariants."""

from conftest import CASES
from pyspark.sql import functions as F

from skuforge.operators.quality import grade
from skuforge.plans.pipeline import RECORD, run


def attrs(row):
    return {a["label"]: (a["value"], a["uom"]) for a in row["enriched"]["attributes"]}


def test_golden_row(by_name):
    row = by_name["golden"]
    e = row["enriched"]
    assert row["status"] == "success" and row["confidence"] == 100.0 and row["review"]["reasons"] == []
    assert row["normalized"]["CLEAN_DESC"] == "PDSH4816AF Dishwasher SS"
    assert (e["manufacturer_name"], e["brand_name"]) == ("Rheem Manufacturing", "FRIGIDAIRE®")
    assert e["classpath"] == "Appliances & Consumer Electronics > Kitchen Appliances > Built-In Dishwashers"
    assert (e["unspsc"], e["product_name"]) == ("52141505", "Dishwasher")
    assert list(attrs(row)) == ["Material", "Product Type", "Application", "Power Source", "Installation Type"]
    assert e["features"] == [
        "Stainless Steel construction", "Electric powered operation", "Engineered for Built-In Dishwashers applications",
    ]
    assert e["invoice_desc"] == "FRIGIDAIRE DISHWASH SS PDSH4816AF"
    assert e["mobile_desc"] == "Rheem Manufacturing FRIGIDAIRE®, Dishwasher, Stainless Steel, PDSH4816AF"
    assert e["short_desc"] == "FRIGIDAIRE® PDSH4816AF Dishwasher"
    assert e["retail_desc"] == (
        "FRIGIDAIRE Dishwasher (MPN: PDSH4816AF) featuring Material: Stainless Steel, Power Source: Electric, Installation Type: Built-In."
    )
    assert e["mfr_url"] == "https://www.frigidaire.com/products/PDSH4816AF"


def test_fractions_stay_whole(by_name):
    assert attrs(by_name["belt"])["Width"] == ("1/2", "in") and attrs(by_name["belt"])["Length"] == ("18", "in")
    assert attrs(by_name["coupling"])["Diameter / Size"] == ("3/8", "in")
    assert attrs(by_name["rod"])["Width"] == ("5/16", "in")
    assert attrs(by_name["spindle"])["Arbor / Spindle Size"] == ("1-1/4", "in")
    assert attrs(by_name["decimals"])["Width"] == ("0.375", "in")
    assert attrs(by_name["half"])["Diameter / Size"] == ("0.5", "in")


def test_sizes(by_name):
    disc = attrs(by_name["disc"])
    assert disc["Diameter / Length"] == ("5", "in") and disc["Thickness"] == (".045", "in")
    assert disc["Arbor / Shank Size"] == ("7/8", "in") and disc["Package Quantity"] == ("10", "")
    flap = attrs(by_name["flap"])
    assert flap["Diameter"] == ("4-1/2", "in") and flap["Arbor / Shank Size"] == ("7/8", "in") and flap["Grit Grade"] == ("80GRIT", "")


def test_fastener_rules(by_name):
    graded = attrs(by_name["class"])
    assert graded["Thread Size"] == ("#8", "") and graded["Finish / Coating"] == ("Zinc Plated", "")
    screw = attrs(by_name["gauge"])
    assert screw["Thread Size"] == ("#8", "") and screw["Fastener Length"] == ("2", "in")
    assert screw["Head Type"] == ("Bugle", "") and screw["Drive Type"] == ("Phillips", "")
    assert screw["Finish / Coating"] == ("Black Phosphate", "")


def test_anvil_before_open_head(by_name):
    a = attrs(by_name["open_head"])
    assert a["Anvil / Retainer Type"] == ("Pin Detent", "") and "Head Style" not in a


def test_fitting_renames_material_and_decking_adds_one(by_name):
    a = attrs(by_name["trex_fitting"])
    assert a["Body Material"] == ("Steel", "") and a["Material"] == ("Composite", "") and a["Board Type"] == ("Fascia Board", "")
    assert a["Length"] == ("16", "ft") and a["Thickness"] == ("1", "in")


def test_resolution(by_name):
    assert by_name["masked"]["enriched"]["brand_name"] == "Acme Supply"  # the placeholder hides Bosch
    assert by_name["fuzzy"]["enriched"]["manufacturer_name"] == "Mirka Abrasives, Inc."
    assert by_name["belt"]["enriched"]["brand_name"] == "Diablo®"


def test_urls(by_name):
    assert by_name["unknown"]["enriched"]["mfr_url"] == "" and by_name["unknown"]["enriched"]["ref_urls"] == []
    urls = by_name["disc"]["enriched"]["ref_urls"]
    assert urls == [f"https://www.milwaukeetool.com/{p}49-94-0013" for p in ("search?q=", "documentation/")]
    assert by_name["star"]["enriched"]["mfr_url"].endswith("/products/A%2AB~C+D")


def test_outer_whitespace_goes(by_name):
    e = by_name["tabs"]["enriched"]
    assert (e["mfg_part_num"], e["part_desc_raw"], e["manufacturer_name"]) == ("QQ13", "Gas range", "Acme")


def test_blank_required_fields(by_name):
    for name, missing in (
        ("blank_mpn", "Mfg_Part_Num"), ("blank_desc", "Part_Desc"), ("blank_maker", "Part_Manuf"),
        ("all_blank", "Mfg_Part_Num, Part_Desc, Part_Manuf"),
    ):
        row = by_name[name]
        assert row["status"] == "review" and row["confidence"] == 0.0 and row["enriched"] is None
        assert row["review"]["reasons"] == [f"Required field is missing or blank: {missing}"]
        assert row["review"]["categories"] == ["missing_required_field"]


def test_invariants(results):
    assert results.count() == len(CASES)
    for row in results.collect():
        assert row["review"]["needs_review"] == bool(row["review"]["reasons"])
        assert (row["status"] == "success") == (not row["review"]["needs_review"])
        if row["enriched"]:
            e = row["enriched"]
            assert 0 < len(e["invoice_desc"]) <= 40 and e["invoice_desc"] == e["invoice_desc"].upper()
            assert len(e["mobile_desc"]) <= 80 and len(e["features"]) <= 20
            assert len({a["label"] for a in e["attributes"]}) == len(e["attributes"])


def test_schema_violation_is_an_error_row(results):
    records = results.where(F.col("enriched").isNotNull()).select("row_id", *[F.col("enriched")[c].alias(c) for c in RECORD])
    broken = records.withColumn("mobile_desc", F.when(F.col("row_id") == 1, F.repeat(F.lit("m"), 86)).otherwise(F.col("mobile_desc")))
    rows = {r["row_id"]: r for r in grade(broken).select("row_id", "status", "review", "error").collect()}
    assert rows[1]["status"] == "error" and rows[1]["error"]["stage"] == "schema"
    assert rows[1]["review"]["categories"] == ["processing_error"]
    assert all(r["status"] != "error" for i, r in rows.items() if i != 1)


def test_filters_stay_above_the_pipeline(spark):
    feed = spark.createDataFrame([(1, "a", "b", "", "", "", "c")], "row_id long, Mfg_Part_Num string, Part_Desc string, E1_Brand string, Unilog_Brand string, DIB_Brand string, Part_Manuf string")
    plan = run(feed).where("status = 'review'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Filter (status") and plan.count("levenshtein") < 60
