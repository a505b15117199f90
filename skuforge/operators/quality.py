"""Confidence, schema check, validation flags and review routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import UNICODE, distinct_filled, is_generic, is_upper, strip, text
from skuforge.operators.stages import layer

C = F.col
NO_ATTRIBUTES = "No technical attributes could be extracted from description"
GENERIC = "Uncertain category / generic classpath fallback"
NOT_UPPER = "INVOICE_DESC is not uppercase"
SPARSE = "Low-context description missing explicit product noun; manual verification recommended"
REQUIRED_TEXT = [
    "mfg_part_num", "part_desc_raw", "manufacturer_name", "brand_name", "classpath", "product_name",
    "invoice_desc", "mobile_desc", "short_desc", "long_desc1", "retail_desc",
]


def _chars(before: str, n: Column, after: str) -> Column:
    return F.concat(F.lit(before), n.cast("string"), F.lit(after))


def invoice_too_long(n: Column) -> Column:
    return _chars("INVOICE_DESC exceeds 40 characters (", n, " chars)")


def confidence(df: DataFrame, raw_desc: Column) -> DataFrame:
    """Adds confidence_score, needs_review and review_reasons: 100 minus a penalty per finding."""
    keep = df.columns
    invoice, mobile = text(C("invoice_desc")), text(C("mobile_desc"))
    df = layer(
        df,
        {
            "_q_inv": F.length(invoice), "_q_mob": F.length(mobile),
            "_q_low": F.lower(strip(text(raw_desc))),
        },
    )
    nouns = UNICODE + r"\b(" + "|".join(rules.PRODUCT_NOUNS) + r")\b"
    inv, mob, low = C("_q_inv"), C("_q_mob"), C("_q_low")
    findings = [
        (inv > rules.INVOICE_MAX, 20, invoice_too_long(inv)),
        ((invoice != "") & ~is_upper(invoice), 10, F.lit(NOT_UPPER)),
        (~mob.between(rules.MOBILE_LOW, rules.MOBILE_HIGH), 10,
         _chars("MOBILE_DESC length (", mob, " chars) outside optimal 60-80 window")),
        (F.coalesce(F.size(C("attributes")), F.lit(0)) == 0, 25, F.lit(NO_ATTRIBUTES)),
        (is_generic(C("classpath")), 15, F.lit(GENERIC)),
        ((low != "") & (F.length(low) < 30) & ~low.rlike(nouns), 25, F.lit(SPARSE)),
    ]
    df = layer(df, {f"_q{i}": cond for i, (cond, _, _) in enumerate(findings)})
    lost = sum((F.when(C(f"_q{i}"), p).otherwise(0) for i, (_, p, _) in enumerate(findings)), F.lit(0))
    df = layer(df, {"_q_score": F.greatest(F.lit(0.0), F.lit(100.0) - lost)})
    reasons = distinct_filled(*[F.when(C(f"_q{i}"), r) for i, (_, _, r) in enumerate(findings)])
    return df.select(
        *keep,
        C("_q_score").alias("confidence_score"),
        (C("_q_score") < rules.CONFIDENCE_FLOOR).alias("needs_review"),
        reasons.alias("review_reasons"),
    )


def schema_errors() -> Column:
    """Violations of the record schema."""
    missing = [F.when(C(c).isNull(), F.lit(f"{c}: required")) for c in REQUIRED_TEXT]
    limits = [
        F.when(F.length(C(c)) > n, F.lit(f"{c}: at most {n} characters"))
        for c, n in (("invoice_desc", rules.INVOICE_MAX), ("mobile_desc", rules.MOBILE_MAX))
    ]
    return distinct_filled(*missing, *limits)


def overflow_warnings() -> Column:
    """What the delivery format has no slot for."""
    out = []
    for name, column, slots in (
        ("feature", "features", rules.FEATURE_SLOTS), ("attribute", "attributes", rules.ATTRIBUTE_SLOTS)
    ):
        n = F.size(C(column))
        message = F.concat(
            F.lit(f"{name} overflow: "), n.cast("string"), F.lit(f" {name}s extracted, only first {slots} exported")
        )
        out.append(F.when(n > slots, message))
    return distinct_filled(*out)


def validation_flags(errors: Column | None = None) -> Column:
    """Struct with every quality rule that can be checked on one record."""
    invoice, mobile = text(C("invoice_desc")), text(C("mobile_desc"))
    inv, mob = F.length(invoice), F.length(mobile)
    char_pass = (inv > 0) & (inv <= rules.INVOICE_MAX)
    errors = F.array().cast("array<string>") if errors is None else errors
    return F.struct(
        (F.size(errors) == 0).alias("schema_valid"),
        errors.alias("schema_errors"),
        inv.alias("invoice_len"),
        char_pass.alias("invoice_char_pass"),
        is_upper(invoice).alias("invoice_caps"),
        (char_pass & is_upper(invoice)).alias("invoice_pass"),
        mob.alias("mobile_len"),
        ((mob > 0) & (mob <= rules.MOBILE_MAX)).alias("schema_mobile_pass"),
        mob.between(rules.MOBILE_LOW, rules.MOBILE_HIGH).alias("mobile_target_pass"),
        F.coalesce(F.size(C("attributes")), F.lit(0)).alias("attribute_count"),
        F.coalesce(F.size(C("features")), F.lit(0)).alias("feature_count"),
        is_generic(C("classpath")).alias("generic_classpath"),
        overflow_warnings().alias("export_warnings"),
    )


# Flags of a row that never got an enriched record.
NO_RECORD = """named_struct('schema_valid', false, 'schema_errors', cast(array() as array<string>), 'invoice_len', 0,
'invoice_char_pass', false, 'invoice_caps', false, 'invoice_pass', false, 'mobile_len', 0, 'schema_mobile_pass', false,
'mobile_target_pass', false, 'attribute_count', 0, 'feature_count', 0, 'generic_classpath', true,
'export_warnings', cast(array() as array<string>))"""


def review_reasons(v: Column) -> Column:
    """Reasons of the engine, then our own, each once."""
    own = distinct_filled(
        F.when(C("needs_review") & (F.size(C("review_reasons")) == 0), F.lit("Flagged for review by the enrichment engine")),
        F.when(~v["invoice_char_pass"], invoice_too_long(v["invoice_len"])),
        F.when(~v["invoice_caps"], F.lit(NOT_UPPER)),
        F.when(
            ~v["mobile_target_pass"],
            _chars("MOBILE_DESC length (", v["mobile_len"], " chars) outside target 60-80 window"),
        ),
        F.when(v["attribute_count"] == 0, F.lit(NO_ATTRIBUTES)),
        F.when(v["generic_classpath"], F.lit(GENERIC)),
    )
    return F.array_distinct(F.concat(C("review_reasons"), own))


def review_categories(v: Column) -> Column:
    checks = {
        "low_confidence": C("confidence_score") < rules.CONFIDENCE_FLOOR,
        "schema_failure": ~v["schema_valid"],
        "no_attributes": v["attribute_count"] == 0,
        "generic_taxonomy": v["generic_classpath"],
        "description_issue": ~v["invoice_pass"] | ~v["mobile_target_pass"],
        "export_issue": F.size(v["export_warnings"]) > 0,
    }
    return distinct_filled(*[F.when(cond, F.lit(name)) for name, cond in checks.items()])


def grade(df: DataFrame, missing: Column | None = None) -> DataFrame:
    """Adds status, validation, review and error to enriched records.

    `missing` (names of blank required fields) sends a row to review without a record; a record
    that breaks the schema becomes an error row. Both stay in the output, so the row count never
    changes.
    """
    keep = df.columns
    none = F.array().cast("array<string>")
    df = layer(df, {"_g_missing": none if missing is None else missing})
    lost = F.size(C("_g_missing")) > 0
    df = layer(df, {"_g_errors": F.when(lost, none).otherwise(schema_errors())})
    broken = F.size(C("_g_errors")) > 0
    no_record = F.expr(NO_RECORD)
    df = layer(
        df,
        {
            "validation": F.when(lost | broken, no_record).otherwise(validation_flags()),
            "error": F.when(
                broken,
                F.struct(
                    F.lit("STAGE_FAILED").alias("code"),
                    F.array_join(C("_g_errors"), "; ").alias("message"),
                    F.lit("schema").alias("stage"),
                ),
            ),
        },
    )
    v = C("validation")
    df = layer(
        df,
        {
            "_g_reasons": F.when(
                lost,
                F.array(F.concat(F.lit("Required field is missing or blank: "), F.array_join(C("_g_missing"), ", "))),
            )
            .when(broken, F.array(F.concat(F.lit("schema stage failed: "), C("error")["message"])))
            .otherwise(review_reasons(v)),
            "_g_cats": F.when(lost, F.array(F.lit("missing_required_field")))
            .when(broken, F.array(F.lit("processing_error")))
            .otherwise(review_categories(v)),
        },
    )
    review = F.size(C("_g_reasons")) > 0
    return df.select(
        *keep,
        F.when(broken, "error").when(review, "review").otherwise("success").alias("status"),
        v,
        F.struct(
            review.alias("needs_review"), C("_g_reasons").alias("reasons"), C("_g_cats").alias("categories")
        ).alias("review"),
        C("error"),
    )
