"""Read access to a results table: filter, search, page, review queue, decisions, diff.

These run on a written results table (see plans.results), so a query reads only the columns it
shows and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import flatten_text, text

C = F.col
CLEARING = ["approve", "mark_reviewed", "override"]
ACTIONS = ["approve", "reject", "override", "mark_reviewed"]


def by_status(results: DataFrame, status: str = "all") -> DataFrame:
    return results if status in ("", "all") else results.where(C("status") == status)


def search(results: DataFrame, needle: str = "") -> DataFrame:
    """Rows with the text in part number, brand, product, classpath or description."""
    if not needle:
        return results
    record = [text(C("enriched")[f]) for f in ("mfg_part_num", "brand_name", "product_name", "classpath")]
    hay = F.lower(F.concat_ws(" ", *record, C("raw")["Mfg_Part_Num"], C("raw")["Part_Desc"]))
    return results.where(hay.contains(needle.lower()))


def page(results: DataFrame, page: int = 1, page_size: int = 50, status: str = "all", needle: str = "") -> DataFrame:
    """One page in row order."""
    size = max(1, min(page_size, 500))
    rows = search(by_status(results, status), needle)
    return rows.orderBy("row_id").offset((max(1, page) - 1) * size).limit(size)


def page_info(results: DataFrame, page_size: int = 50, status: str = "all", needle: str = "") -> DataFrame:
    """Rows and pages behind page()."""
    size = max(1, min(page_size, 500))
    one = search(by_status(results, status), needle).agg(F.count(F.lit(1)).alias("total"))
    return one.select("total", F.ceil(C("total") / size).alias("pages"))


def by_id(results: DataFrame, row_id: int) -> DataFrame:
    return results.where(C("row_id") == row_id)


def review_queue(results: DataFrame, category: str = "all") -> DataFrame:
    """Compact list of the rows that need a person; error rows stay listed."""
    rows = results.where(C("review")["needs_review"] | (C("status") == "error"))
    if category != "all":
        rows = rows.where(F.array_contains(C("review")["categories"], category))
    decision = [C("decision")] if "decision" in results.columns else []
    return rows.select(
        "row_id", "mpn", "part_desc", "brand_name", C("confidence").alias("confidence_score"), "status",
        C("review")["reasons"].alias("reasons"), C("review")["categories"].alias("categories"), *decision,
    )


def new_decision(df: DataFrame, action: Column | str, comment: Column | str = "") -> DataFrame:
    """Rows for the decisions table (row_id, action, comment, at) for all rows of `df`."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("row_id", as_col(action).alias("action"), as_col(comment).alias("comment"), F.current_timestamp().alias("at"))


def apply_decisions(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results with their latest decision. Approve, override and mark_reviewed clear the review
    flag for good; a reject leaves it as it is. `decisions` is append-only; its rows are merged
    per result row before the join. Rows with another action are no decisions; of decisions at the
    same time the one whose action, then comment, sorts last counts."""
    latest = decisions.where(C("action").isin(ACTIONS)).groupBy("row_id").agg(
        F.max_by(F.struct("action", "comment", "at"), F.struct("at", "action", "comment")).alias("decision"),
        F.bool_or(C("action").isin(CLEARING)).alias("_cleared"),
    )
    review = C("review").withField("needs_review", C("review")["needs_review"] & ~F.coalesce(C("_cleared"), F.lit(False)))
    return results.join(latest, "row_id", "left").withColumn("review", review).drop("_cleared")


def length_budget(records: DataFrame) -> DataFrame:
    """Per record and channel: length and whether it keeps the display limit."""
    out = []
    for column, limit in rules.CHANNEL_LIMITS.items():
        out += [
            F.length(text(C(column))).cast("bigint").alias(f"{column}_len"),
            (F.length(text(C(column))) <= limit).alias(f"{column}_ok"),
        ]
    return records.select("row_id", *out)


def three_way_diff(detail: DataFrame) -> DataFrame:
    """Raw, generated and truth values of result rows (with a nullable `truth` struct) as lines of
    (row_id, panel, label, value, changed)."""
    raw, rec, truth = C("raw"), C("enriched"), C("truth")

    def same(a: Column, b: Column) -> Column:
        return flatten_text(a) == flatten_text(b)

    def line(panel: str, label: str, value: Column, changed: Column | None = None) -> Column:
        flag = F.lit(False) if changed is None else changed
        return F.struct(
            F.lit(panel).alias("panel"), F.lit(label).alias("label"), text(value).alias("value"), flag.alias("changed")
        )

    lines = [line("raw", c, raw[c]) for c in rules.REQUIRED_COLUMNS]
    for label, field, source in (
        ("MANUFACTURER_PART_NUMBER", "mfg_part_num", "Mfg_Part_Num"), ("MANUFACTURER_NAME", "manufacturer_name", "Part_Manuf"),
        ("BRAND_NAME", "brand_name", "E1_Brand"),
    ):
        lines.append(line("generated", label, rec[field], ~same(rec[field], raw[source])))
    for label, field in (("SERIES", "series"), ("Product Name", "product_name"), ("Classpath", "classpath"), ("UNSPSC", "unspsc")):
        lines.append(line("generated", label, rec[field], text(rec[field]) != ""))
    lines.append(line("generated", "Confidence", F.format_string("%.1f", C("confidence"))))
    has = truth.isNotNull()
    fields = {f.name for f in detail.schema["truth"].dataType.fields}
    for label, field in (
        ("MANUFACTURER_PART_NUMBER", None), ("MANUFACTURER_NAME", "manufacturer_name"), ("BRAND_NAME", "brand_name"),
        ("SERIES", None), ("Product Name", "product_name"), ("Classpath", "classpath"), ("UNSPSC", "unspsc"),
    ):
        value = truth.getField(label) if label in fields else F.lit("")
        changed = None if field is None else ~same(value, rec[field])
        lines.append(F.when(has, line("truth", label, value, changed)))
    return detail.select("row_id", F.explode_outer(F.array(*lines)).alias("l")).where(C("l").isNotNull()).select("row_id", "l.*")
