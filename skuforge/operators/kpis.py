"""Quality figures over result rows. Every block is one hash aggregate with partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import is_upper, ladder, text

C = F.col
STATUSES = ["success", "review", "error"]
# Closed confidence buckets.
BUCKETS = [(0, 59), (60, 79), (80, 89), (90, 99), (100, 100)]


def pct(part: Column, total: Column) -> Column:
    """Percentage with two decimals, halves to even; 0 without rows."""
    return F.coalesce(F.bround(F.try_divide(part, total) * 100, 2), F.lit(0.0))


def mean2(c: Column) -> Column:
    return F.coalesce(F.bround(F.avg(c), 2), F.lit(0.0))


def kpis(results: DataFrame) -> DataFrame:
    """One row with counts, rates over all rows and averages."""
    v = C("validation")
    classpath = F.when(C("enriched").isNotNull(), text(C("enriched")["classpath"])).otherwise("")
    specific = (classpath != "") & ~classpath.contains(rules.GENERIC_MARK)
    counts = {
        "success": C("status") == "success", "errors": C("status") == "error",
        "invoice_char": v["invoice_char_pass"], "invoice_caps": v["invoice_caps"],
        "schema_mobile": v["schema_mobile_pass"], "mobile_target": v["mobile_target_pass"],
        "schema_ok": v["schema_valid"], "specific": specific, "with_attributes": v["attribute_count"] > 0,
    }
    one = results.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(cond).alias(name) for name, cond in counts.items()],
        mean2(C("confidence")).alias("avg_confidence"),
        mean2(v["attribute_count"]).alias("avg_attributes"),
    )
    total = C("total")
    rates = {
        "success_rate": "success", "invoice_char_pass": "invoice_char", "invoice_caps_pass": "invoice_caps",
        "schema_mobile_pass": "schema_mobile", "mobile_target_60_80_pass": "mobile_target",
        "schema_pass_rate": "schema_ok", "classpath_specific_rate": "specific", "attribute_coverage": "with_attributes",
    }
    return one.select(
        "total", "success", (total - C("success") - C("errors")).alias("review"), "errors",
        *[pct(C(part), total).alias(name) for name, part in rates.items()],
        "avg_confidence", "avg_attributes",
    )


def confidence_histogram(results: DataFrame) -> DataFrame:
    """Rows per confidence bucket, empty buckets included."""
    names = [f"{a}-{b}" if a != b else f"{a}" for a, b in BUCKETS]
    one = results.agg(*[F.count_if(C("confidence").between(a, b)).alias(f"b{i}") for i, (a, b) in enumerate(BUCKETS)])
    return _unpivot(one, [(n, f"b{i}") for i, n in enumerate(names)], "bucket", "count")


def status_distribution(results: DataFrame) -> DataFrame:
    one = results.agg(*[F.count_if(C("status") == s).alias(s) for s in STATUSES])
    return _unpivot(one, [(s, s) for s in STATUSES], "status", "count")


def _unpivot(one: DataFrame, pairs: list[tuple[str, str]], key: str, value: str) -> DataFrame:
    """The columns of a one-row frame as rows."""
    structs = [F.struct(F.lit(n).alias(key), C(c).alias(value)) for n, c in pairs]
    return one.select(F.inline(F.array(*structs)))


def reason_bucket(reason: Column) -> Column:
    low = F.lower(reason)
    return ladder(
        [
            (reason.contains("INVOICE_DESC exceeds"), "Invoice description over 40 characters"),
            (reason.contains("not uppercase"), "Invoice description not uppercase"),
            (reason.contains("MOBILE_DESC"), "Mobile description outside target window"),
            (reason.contains("No technical attributes") | low.contains("no attributes"), "No technical attributes extracted"),
            (low.contains("classpath"), "Generic taxonomy fallback"),
            (low.contains("failed"), "Processing error"),
            (low.contains("schema"), "Schema validation failure"),
        ],
        reason,
    )


def reason_counts(results: DataFrame) -> DataFrame:
    """Review reasons with parameters collapsed, most frequent first, ties by text."""
    # explode_outer: a plain explode would copy the reasons' whole expression into a filter below
    reasons = results.select(F.explode_outer(C("review")["reasons"]).alias("reason")).where(C("reason").isNotNull())
    counted = reasons.groupBy(reason_bucket(C("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "reason")


def top_reasons(results: DataFrame, k: int = 8) -> DataFrame:
    return reason_counts(results).limit(k)


def top_classpaths(results: DataFrame, k: int = 8) -> DataFrame:
    """Most frequent classpaths of the enriched rows."""
    rows = results.select(C("enriched")["classpath"].alias("classpath"))
    counted = rows.groupBy("classpath").agg(F.count(F.lit(1)).alias("count")).where(C("classpath").isNotNull())
    return counted.orderBy(F.desc("count"), "classpath").limit(k)


def category_counts(results: DataFrame) -> DataFrame:
    """Queued rows per review category, empty categories included."""
    queued = C("review")["needs_review"] | (C("status") == "error")
    hit = [F.count_if(queued & F.array_contains(C("review")["categories"], c)).alias(c) for c in rules.REVIEW_CATEGORIES]
    one = results.agg(F.count_if(queued).alias("all"), *hit)
    return _unpivot(one, [(c, c) for c in ["all", *rules.REVIEW_CATEGORIES]], "category", "count")


def engine_kpis(records: DataFrame) -> DataFrame:
    """Figures of the engine's own scorecard (its mobile window is 50 to 85 characters)."""
    invoice, mobile = text(C("invoice_desc")), F.length(text(C("mobile_desc")))
    one = records.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.length(invoice).between(1, rules.INVOICE_MAX)).alias("short"),
        F.count_if(is_upper(invoice)).alias("caps"),
        F.count_if(mobile.between(50, rules.MOBILE_MAX)).alias("mobile"),
        mean2(C("confidence_score")).alias("avg_confidence_score"),
        F.count_if(C("needs_review")).alias("needs_review_count"),
    )
    total = C("total_records")
    return one.select(
        "total_records",
        pct(C("short"), total).alias("invoice_char_limit_pass_rate"),
        pct(C("caps"), total).alias("invoice_all_caps_pass_rate"),
        pct(C("mobile"), total).alias("mobile_desc_compliance_rate"),
        "avg_confidence_score",
        "needs_review_count",
        pct(C("needs_review_count"), total).alias("needs_review_percentage"),
        F.when(F.try_divide(C("short"), total) >= 0.98, "WINNER").when(total > 0, "NEEDS_TUNING").alias("overall_status"),
    )


# Scorecard line, KPI behind it, target.
SCORECARD = [
    ("Invoice Desc (<=40 chars)", "invoice_char_pass", 100), ("Invoice Desc (ALL CAPS)", "invoice_caps_pass", 100),
    ("Mobile Desc (schema <=85)", "schema_mobile_pass", 90), ("Mobile Desc (target 60-80)", "mobile_target_60_80_pass", 90),
    ("Schema validation", "schema_pass_rate", 100), ("Specific classpath (non-generic)", "classpath_specific_rate", 95),
    ("Attribute coverage", "attribute_coverage", 90),
]


def scorecard(results: DataFrame) -> DataFrame:
    """The KPI block as report lines with a verdict, and the delivery width."""
    one = kpis(results)
    lines = [(name, C(column), float(target)) for name, column, target in SCORECARD]
    lines.append(("Delivery columns", F.lit(float(len(rules.DELIVERY_COLUMNS))), 252.0))
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("metric"), value.alias("value"), F.lit(target).alias("target"),
                        F.when(value >= target, "PASS").otherwise("CHECK").alias("verdict"),
                    )
                    for name, value, target in lines
                ]
            )
        )
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Counters of one batch and its final state."""
    counts = {s: F.count_if(C("status") == s) for s in STATUSES}
    one = results.agg(
        F.count(F.lit(1)).alias("processed"), counts["success"].alias("success"), counts["review"].alias("review"),
        counts["error"].alias("errors"),
    )
    return one.select(
        "processed", "success", "review", "errors", F.lit(100).cast("bigint").alias("progress"),
        F.when((C("review") > 0) | (C("errors") > 0), "completed_with_review").otherwise("completed").alias("status"),
    )
