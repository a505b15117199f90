"""The whole row pipeline: feed -> normalised -> enriched -> graded.

It is one narrow stage (no shuffle, no join, no Python per row), so it scales with the number of
input splits and the same code runs on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import first_filled, strip, text
from skuforge.operators.attributes import SCALARS, extract_attributes
from skuforge.operators.catalog import CatalogTables
from skuforge.operators.describe import DESCRIPTIONS, brand_context, describe, features
from skuforge.operators.normalize import NORMALIZED, missing_fields, normalize
from skuforge.operators.provenance import provenance_urls
from skuforge.operators.quality import confidence, grade
from skuforge.operators.stages import layer, sealed
from skuforge.operators.taxonomy import classify

C = F.col
RECORD = [
    "mfg_part_num", "part_desc_raw", "manufacturer_name", "brand_name", "series", "classpath", "unspsc",
    "product_name", "attributes", "features", *DESCRIPTIONS, "mfr_url", "ref_urls", "confidence_score",
    "needs_review", "review_reasons",
]


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the pipeline relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _pick(df: DataFrame, *names: str) -> Column:
    """First of the named columns that has any text; absent columns are skipped."""
    return first_filled(*[C(n) for n in names if n in df.columns])


def coalesce_inputs(df: DataFrame) -> dict[str, Column]:
    """Inputs of the engine under any of their accepted names."""
    brand = _pick(df, "E1_Brand", "raw_brand")
    return {
        "_e_mpn": strip(_pick(df, "Mfg_Part_Num", "mfg_part_num")),
        "_e_desc": strip(_pick(df, "Part_Desc", "part_desc", "part_desc_raw")),
        "_e_mfg": strip(_pick(df, "MANUFACTURER_NAME", "Part_Manuf", "manufacturer_name")),
        "_e_brand": strip(first_filled(_pick(df, "BRAND_NAME", "brand_name"), brand)),
    }


def describe_inputs(df: DataFrame, keep: Sequence[str], when: Column | None = None) -> DataFrame:
    """Frame with the four engine inputs; rows where `when` is false get NULL text, which makes
    every later expression return at once."""
    picked = coalesce_inputs(df)
    if when is not None:
        picked = {k: F.when(when, v) for k, v in picked.items()}
    return df.select(*keep, *[v.alias(k) for k, v in picked.items()])


def classified(df: DataFrame) -> DataFrame:
    df = layer(
        df,
        {
            "mfg_part_num": C("_e_mpn"), "part_desc_raw": C("_e_desc"), "manufacturer_name": C("_e_mfg"),
            "brand_name": F.when(C("_e_mfg").isNotNull(), brand_context(C("_e_brand"), C("_e_mfg"))),
        },
    ).drop("_e_mpn", "_e_desc", "_e_mfg", "_e_brand")
    return classify(df, C("part_desc_raw"), C("mfg_part_num"), C("manufacturer_name"))


def extracted(df: DataFrame) -> DataFrame:
    return extract_attributes(df, C("part_desc_raw"), C("mfg_part_num"), C("manufacturer_name"))


def enrich(df: DataFrame, keep: Sequence[str] | None = None, when: Column | None = None) -> DataFrame:
    """Adds the 21 record fields to a normalised (or raw) frame. `keep` are the input columns to
    carry along; by default all that do not clash with a record field (names are compared without
    case)."""
    names = {n.lower() for n in RECORD}
    keep = [c for c in df.columns if c.lower() not in names] if keep is None else list(keep)
    out = extracted(classified(describe_inputs(df, keep, when)))
    out = features(out, values=C("label_values"))
    out = describe(out)
    out = confidence(out, C("part_desc_raw"))
    out = provenance_urls(out, C("manufacturer_name"), C("mfg_part_num"), C("brand_name"))
    return sealed(out.select(*keep, *RECORD), "enrich")


def run(
    feed: DataFrame, catalog: Sequence[rules.CatalogRow] | CatalogTables = rules.CATALOG, row_id: str = "row_id"
) -> DataFrame:
    """Feed to result rows: row_id, status, the raw, normalized and enriched records, validation,
    review and error. Every input row gives exactly one result row. With catalog tables the
    manufacturers are resolved by joins; everything else stays one narrow stage."""
    raw = [c for c in rules.FEED_COLUMNS if c in feed.columns]
    df = feed.select(row_id, *[text(C(f"`{c}`")).alias(c) for c in raw])
    df = layer(df, {"missing": missing_fields()})
    df = normalize(df, catalog)
    df = layer(df, {"raw": F.struct(*[C(f"`{c}`") for c in raw])})
    ok = F.size(C("missing")) == 0
    df = layer(df, {"normalized": F.when(ok, F.struct(*NORMALIZED))})
    df = enrich(df, keep=[row_id, "raw", "normalized", "missing"], when=ok)
    df = grade(df, C("missing"))
    record = F.when(F.size(C("missing")) == 0, F.struct(*RECORD))
    out = df.select(
        C(row_id).alias("row_id"),
        "status",
        C("raw")["Mfg_Part_Num"].alias("mpn"),
        C("raw")["Part_Desc"].alias("part_desc"),
        *[F.when(C("error").isNull(), text(C(c))).otherwise("").alias(c) for c in ("brand_name", "product_name", "classpath")],
        F.when((F.size(C("missing")) > 0) | C("error").isNotNull(), 0.0).otherwise(C("confidence_score")).alias("confidence"),
        "raw", "normalized", record.alias("enriched"), "validation", "review", "error",
    )
    return sealed(out, "run")


__all__ = ["RECORD", "SCALARS", "classified", "coalesce_inputs", "enrich", "extracted", "run", "tune"]
