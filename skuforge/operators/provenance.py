"""Links to the manufacturer's own site."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import any_of, first_rank, ladder, literal_array, no_marks, squeeze, strip, text
from skuforge.operators.stages import layer

C = F.col


def _bare(c: Column) -> Column:
    """Name without a parenthesised code, marks and extra blanks."""
    return squeeze(no_marks(F.substring_index(text(c), "(", 1)))


def hay(manufacturer: Column, brand: Column) -> Column:
    """Lower-case text the fragments are searched in."""
    return F.lower(F.concat(_bare(manufacturer), F.lit(" "), _bare(brand)))


def match_domain(name: str, domains: Mapping[str, str] = rules.DOMAINS) -> Column:
    """Domain of the longest known fragment in the column `name` (see hay), '' if none."""
    ordered = sorted(domains, key=len, reverse=True)
    rank = first_rank(name, {k: i for i, k in enumerate(ordered)})
    return text(F.get(literal_array([domains[k] for k in ordered]), F.expr(rank)))


def quote_plus(c: Column) -> Column:
    """Form encoding; Spark's url_encode differs from the contract in two characters."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def exclude_shops(urls: Column) -> Column:
    """Without links to shops, five at most."""
    ok = F.filter(urls, lambda u: ~any_of(F.lower(u).contains(bad) for bad in rules.SHOP_DOMAINS))
    return F.slice(ok, 1, rules.REF_URL_SLOTS)


def provenance_urls(
    df: DataFrame, manufacturer: Column, mpn: Column, brand: Column, domains: Mapping[str, str] = rules.DOMAINS
) -> DataFrame:
    """Adds mfr_url and ref_urls; both stay empty for makers without a known domain."""
    keep = df.columns
    named = F.when(_bare(brand) != "", brand).otherwise(manufacturer)
    df = layer(df, {"_u_hay": hay(manufacturer, named), "_u_mpn": quote_plus(strip(text(mpn)))})
    df = layer(df, {"_u_dom": match_domain("_u_hay", domains)})
    site = F.concat(F.lit("https://www."), C("_u_dom"))
    key = C("_u_mpn")
    refs = F.when(
        key != "", F.array(F.concat(site, F.lit("/search?q="), key), F.concat(site, F.lit("/documentation/"), key))
    ).otherwise(F.array(F.concat(site, F.lit("/catalog"))))
    return df.select(
        *keep,
        ladder([(C("_u_dom") == "", ""), (key != "", F.concat(site, F.lit("/products/"), key))], site).alias("mfr_url"),
        F.when(C("_u_dom") == "", F.array().cast("array<string>")).otherwise(exclude_shops(refs)).alias("ref_urls"),
    )
