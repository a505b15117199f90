"""Comparison with labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.similarity import text_similarity
from skuforge.functions.text import normalize_text, strip, text
from skuforge.operators.kpis import pct
from skuforge.sources.feed import with_row_ids

C = F.col


def match_key(c: Column) -> Column:
    return F.upper(strip(text(c)))


def truth_by_key(truth: DataFrame, order: str, last: bool = True) -> DataFrame:
    """One truth row per part number: of several the last (or first) in `order`, a number that no two rows share.

    Only the number of the winner goes through the aggregate (a hash aggregate, merged before its shuffle, so many copies
    of one key cost nothing); the row itself is fetched by it, and only the columns that somebody reads.
    """
    columns = [c for c in truth.columns if c != order]
    keyed = truth.select(
        match_key(C("Mfg_Part_Num")).alias("truth_key"), C(order).cast("bigint").alias("_order"),
        F.struct(*[C(f"`{c}`") for c in columns]).alias("truth"),
    ).where(C("truth_key") != "")
    pick = F.max if last else F.min
    winner = keyed.groupBy("truth_key").agg(pick("_order").alias("_order"))
    return keyed.join(winner, ["truth_key", "_order"], "left_semi").select("truth_key", "truth")


def truth_join(results: DataFrame, truth: DataFrame, order: str = "truth_id") -> DataFrame:
    """Enriched results with their truth row (last duplicate wins). Which side is broadcast, if
    any, is left to Spark, which knows the sizes when it gets there and splits hot keys."""
    rows = results.where(C("enriched").isNotNull())
    keyed = rows.withColumn("truth_key", match_key(C("enriched")["mfg_part_num"]))
    return keyed.join(truth_by_key(truth, order), "truth_key")


def row_detail(results: DataFrame, truth: DataFrame, row_id: int, order: str = "truth_id") -> DataFrame:
    """One result row with its first truth row, if any. Truth rows of other keys are left out before anything else."""
    row = results.where(C("row_id") == row_id).withColumn(
        "truth_key", F.when(C("enriched").isNotNull(), match_key(C("enriched")["mfg_part_num"]))
    )
    own = truth.join(row.select("truth_key").limit(1), match_key(C("Mfg_Part_Num")) == C("truth_key"), "left_semi")
    return row.join(truth_by_key(own, order, last=False), "truth_key", "left")


def truth_benchmark(results: DataFrame, truth: DataFrame, order: str = "truth_id") -> DataFrame:
    """Per field: rows compared, exact and normalised match rate; plus the overall rate, the
    number of truth rows and of matched rows. Empty if nothing matched."""
    joined = truth_join(results, truth.select("Mfg_Part_Num", order, *rules.SCORED_FIELDS), order)
    counts = []
    for i, field in enumerate(rules.SCORED_FIELDS):
        want = text(C("truth").getField(field))
        got = text(C("enriched").getField(rules.DELIVERY_FIELDS[field]))
        exact = (want != "") & (want == got)
        counts += [
            F.count_if(want != "").alias(f"n{i}"), F.count_if(exact).alias(f"e{i}"),
            F.count_if(exact | ((want != "") & (normalize_text(want) == normalize_text(got)))).alias(f"m{i}"),
        ]
    one = joined.agg(F.count(F.lit(1)).alias("matched_rows"), *counts)
    keys = truth.select(match_key(C("Mfg_Part_Num")).alias("k")).where(C("k") != "")
    total = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("ground_truth_rows"))
    one = one.withColumn("ground_truth_rows", total.scalar())
    n = range(len(rules.SCORED_FIELDS))
    scored = sum((F.when(C(f"n{i}") > 0, 1).otherwise(0) for i in n), F.lit(0))
    rates = sum((F.when(C(f"n{i}") > 0, pct(C(f"m{i}"), C(f"n{i}"))).otherwise(0.0) for i in n), F.lit(0.0))
    lines = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"), C(f"n{i}").alias("compared"),
                pct(C(f"e{i}"), C(f"n{i}")).alias("exact_match_rate"),
                pct(C(f"m{i}"), C(f"n{i}")).alias("normalized_match_rate"),
            )
            for i, field in enumerate(rules.SCORED_FIELDS)
        ]
    )
    return one.where(C("matched_rows") > 0).select(
        "ground_truth_rows", "matched_rows",
        F.coalesce(F.bround(F.try_divide(rates, scored), 2), F.lit(0.0)).alias("overall_normalized_match_rate"),
        F.inline(lines),
    )


def zip_join(predicted: DataFrame, truth: DataFrame, key: str = "row_index") -> DataFrame:
    """Row i of one side with row i of the other, as structs; as long as the shorter side."""
    p = predicted.select(key, F.struct(*[C(f"`{c}`") for c in predicted.columns if c != key]).alias("pred"))
    t = truth.select(key, F.struct(*[C(f"`{c}`") for c in truth.columns if c != key]).alias("gt"))
    return p.join(t, key)


def zip_rows(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Row i of one frame with row i of the other, counted from 1 in their order, as structs; as long as the shorter side.

    Neither side needs a key: ordinals come from the counts of partitions, and both sides are dealt out by them.
    """
    return zip_join(with_row_ids(predicted, "row_index"), with_row_ids(truth, "row_index"))


def score_rows(pairs: DataFrame) -> DataFrame:
    """Scores each (pred, gt) pair of delivery-shaped structs."""

    def of(side: str, field: str) -> Column:
        return strip(text(C(side).getField(field)))

    df = pairs.select(
        "*",
        *[of(s, f).alias(f"_{s}_{f}") for s in ("gt", "pred") for f in ("MANUFACTURER_NAME", "BRAND_NAME", "SHORT_DESC")],
        of("pred", "INVOICE_DESC").alias("_inv"),
        of("pred", "MOBILE_DESC").alias("_mob"),
    )
    gt_m, pr_m = C("_gt_MANUFACTURER_NAME"), C("_pred_MANUFACTURER_NAME")
    gt_b, pr_b = C("_gt_BRAND_NAME"), C("_pred_BRAND_NAME")
    inv, mob = F.length("_inv"), F.length("_mob")
    df = df.select(
        "*",
        (F.lower(gt_m) == F.lower(pr_m)).alias("mfg_match"),
        (gt_b == pr_b).alias("brand_match"),
        (inv <= rules.INVOICE_MAX).alias("invoice_desc_len_valid"),
        (C("_inv") == F.upper("_inv")).alias("invoice_desc_caps_valid"),
        mob.between(rules.MOBILE_LOW, rules.MOBILE_HIGH).alias("mobile_desc_len_valid"),
        text_similarity(C("_gt_SHORT_DESC"), C("_pred_SHORT_DESC")).alias("short_desc_similarity"),
    )

    def differs(what: str, want: Column, got: Column) -> Column:
        return F.concat(F.lit(f"{what} mismatch: expected '"), want, F.lit("', got '"), got, F.lit("'"))

    issues = F.array_compact(
        F.array(
            F.when(~C("mfg_match") & (gt_m != ""), differs("Manufacturer", gt_m, pr_m)),
            F.when(~C("brand_match") & (gt_b != ""), differs("Brand", gt_b, pr_b)),
            F.when(inv > rules.INVOICE_MAX, F.concat(F.lit("INVOICE_DESC exceeds 40 chars ("), inv.cast("string"), F.lit(" chars)"))),
            F.when(
                (mob > 0) & ~C("mobile_desc_len_valid"),
                F.concat(F.lit("MOBILE_DESC outside 60-80 char range ("), mob.cast("string"), F.lit(" chars)")),
            ),
        )
    )

    def points(cond: Column, weight: float) -> Column:
        return F.when(cond, 100.0 * weight).otherwise(0.0)

    score = (
        points(C("mfg_match"), 0.25) + points(C("brand_match"), 0.25)
        + points(C("invoice_desc_len_valid") & C("invoice_desc_caps_valid"), 0.15)
        + points(C("mobile_desc_len_valid"), 0.15) + C("short_desc_similarity") * 0.20
    )
    return df.select(
        "row_index", "mfg_match", "brand_match", "invoice_desc_len_valid", "invoice_desc_caps_valid",
        "mobile_desc_len_valid", "short_desc_similarity",
        F.bround(score, 2).alias("confidence_score"),
        ((score < 75.0) | (F.size(issues) > 0)).alias("needs_human_review"),
        issues.alias("audit_issues"),
    )


def score_summary(rows: DataFrame) -> DataFrame:
    """The nine summary figures over scored rows."""
    one = rows.agg(
        F.count(F.lit(1)).alias("total_evaluated"),
        F.count_if("mfg_match").alias("m"), F.count_if("brand_match").alias("b"),
        F.count_if(C("invoice_desc_len_valid") & C("invoice_desc_caps_valid")).alias("i"),
        F.count_if("mobile_desc_len_valid").alias("o"),
        F.sum("short_desc_similarity").alias("s"), F.sum("confidence_score").alias("c"),
        F.count_if("needs_human_review").alias("needs_human_review_count"),
    ).where(C("total_evaluated") > 0)
    n = C("total_evaluated")
    return one.select(
        "total_evaluated", pct(C("m"), n).alias("mfg_accuracy_pct"), pct(C("b"), n).alias("brand_accuracy_pct"),
        pct(C("i"), n).alias("invoice_desc_compliance_pct"), pct(C("o"), n).alias("mobile_desc_compliance_pct"),
        F.bround(C("s") / n, 2).alias("short_desc_avg_similarity_pct"),
        F.bround(C("c") / n, 2).alias("avg_confidence_score_pct"),
        "needs_human_review_count", pct(C("needs_human_review_count"), n).alias("review_rate_pct"),
    )
