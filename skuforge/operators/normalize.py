"""Row normalisation: clean text, canonical manufacturer and brand, standard dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import (
    clean_placeholder, distinct_filled, drop_code, drop_remark, first_filled, plain_quotes, strip, text,
)
from skuforge.functions.units import std_dimensions
from skuforge.operators.catalog import CatalogTables, resolve_tables
from skuforge.operators.resolve import resolve
from skuforge.operators.stages import layer, sealed

NORMALIZED = [
    "CLEAN_DESC", "MANUFACTURER_NAME", "BRAND_NAME", "MANUFACTURER_PART_NUMBER",
    "STANDARDIZED_DIMENSIONS", "STAGE1_STATUS",
]


def pick_brand() -> Column:
    """First brand column with any text; placeholders are sorted out only afterwards, so a
    placeholder in an earlier column hides a brand in a later one."""
    return clean_placeholder(first_filled(F.col("Unilog_Brand"), F.col("E1_Brand"), F.col("DIB_Brand")))


def missing_fields() -> Column:
    """Names of the required fields that are blank, in contract order."""
    return distinct_filled(*[F.when(strip(text(F.col(c))) == "", F.lit(c)) for c in rules.REQUIRED_VALUES])


def normalize(df: DataFrame, catalog: Sequence[rules.CatalogRow] | CatalogTables = rules.CATALOG) -> DataFrame:
    """Adds the six normalised columns to a feed. A short catalog becomes part of the plan; catalog tables are joined."""
    keep = df.columns
    df = layer(
        df,
        {
            "_n_desc": plain_quotes(F.col("Part_Desc")), "_n_raw": clean_placeholder(F.col("Part_Manuf")),
            "MANUFACTURER_PART_NUMBER": strip(text(F.col("Mfg_Part_Num"))), "_n_brand": pick_brand(),
        },
    )
    df = layer(df, {"CLEAN_DESC": drop_remark(F.col("_n_desc")), "_n_sup": drop_code(F.col("_n_raw"))})
    how = resolve_tables if isinstance(catalog, CatalogTables) else resolve
    df = how(df, F.col("_n_sup"), F.col("CLEAN_DESC"), F.col("MANUFACTURER_PART_NUMBER"), F.col("_n_brand"), catalog)
    df = layer(
        df, {"STANDARDIZED_DIMENSIONS": std_dimensions(F.col("CLEAN_DESC")), "STAGE1_STATUS": F.lit("NORMALIZED")}
    )
    return sealed(df.select(*keep, *NORMALIZED), "normalize")
