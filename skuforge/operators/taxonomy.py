"""Classification into the product taxonomy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import first_rank, literal_array, text
from skuforge.operators.resolve import deciding_keywords
from skuforge.operators.stages import layer
from skuforge.rules import TaxonomyRule


def rule_position(low: str, taxonomy: Sequence[TaxonomyRule] = rules.TAXONOMY) -> Column:
    """Position of the first rule with a keyword anywhere in the lower-case text, else the
    position behind the last rule."""
    table = {kw: i for i, kws in enumerate(deciding_keywords([r.keywords for r in taxonomy])) for kw in kws}
    return F.coalesce(F.expr(first_rank(low, table)), F.lit(len(taxonomy)))


def classify(
    df: DataFrame,
    desc: Column,
    mpn: Column,
    manufacturer: Column,
    taxonomy: Sequence[TaxonomyRule] = rules.TAXONOMY,
    fallback: TaxonomyRule = rules.FALLBACK_RULE,
) -> DataFrame:
    """Adds classpath, unspsc and product_name."""
    keep = df.columns
    low = F.lower(F.concat(text(desc), F.lit(" "), text(mpn), F.lit(" "), text(manufacturer)))
    df = layer(df, {"_t_low": low})
    df = layer(df, {"_t_pos": F.when(F.col("_t_low").isNotNull(), rule_position("_t_low", taxonomy))})
    leaves = [*taxonomy, fallback]
    pos = F.col("_t_pos")
    return df.select(
        *keep,
        F.get(literal_array([r.classpath for r in leaves]), pos).alias("classpath"),
        F.get(literal_array([r.unspsc for r in leaves]), pos).alias("unspsc"),
        F.get(literal_array([r.product_name for r in leaves]), pos).alias("product_name"),
    )
