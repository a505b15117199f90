"""Manufacturer and brand resolution.

The catalog is a short ordered list, so every step turns into an expression over literals that
yields the position of a catalog row; the first step with an answer wins. There is no join and no
shuffle, whatever the share of one supplier in the feed is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.similarity import best_match, token_sort
from skuforge.functions.text import (
    clean_placeholder, drop_code, drop_remark, first_rank, ladder, literal_array, lookup, no_marks, plain_quotes,
    strip, text,
)
from skuforge.operators.stages import layer
from skuforge.rules import CatalogRow

UNKNOWN = ("Unknown Manufacturer", "Unknown Brand")


def deciding_keywords(groups: Sequence[Sequence[str]]) -> list[list[str]]:
    """Keywords that can decide an ordered substring search: one that contains another keyword of
    its own or of an earlier group never does, so it is left out of the plan."""
    out: list[list[str]] = []
    seen: list[str] = []
    for group in groups:
        kept: list[str] = []
        for kw in sorted(group, key=len):
            if not any(k in kw for k in seen) and not any(k in kw for k in kept):
                kept.append(kw)
        seen += kept
        out.append(kept)
    return out


def _first_by(catalog: Sequence[CatalogRow], key) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, row in enumerate(catalog):
        out.setdefault(key(row), i)
    return out


def alias_row(brand: Column, catalog: Sequence[CatalogRow]) -> Column:
    """Step 1: a brand spelling we know."""
    by_brand = _first_by(catalog, lambda r: r.brand)
    table = {alias: by_brand[b] for alias, b in rules.BRAND_ALIASES.items() if b in by_brand}
    return lookup(strip(no_marks(F.lower(brand))), table)


def distributor_row(supplier: Column, mpn: Column, desc: Column, catalog: Sequence[CatalogRow]) -> Column:
    """Step 2: a distributor's part number or text that tells the real manufacturer."""
    by_name = _first_by(catalog, lambda r: r.manufacturer)
    low = F.lower(supplier)
    cases = [
        (low.contains(dist) & (mpn.startswith(prefix) | desc.contains(prefix.lower())), by_name[target])
        for dist, prefix, target in rules.DISTRIBUTORS
        if target in by_name
    ]
    return ladder(cases) if cases else F.lit(None).cast("int")


def keyword_row(mpn_and_desc: str, catalog: Sequence[CatalogRow]) -> Column:
    """Step 3: a catalog keyword anywhere in the description or the part number (a column with
    both in lower case, a line break between them)."""
    table = {kw: i for i, kws in enumerate(deciding_keywords([row.keywords for row in catalog])) for kw in kws}
    return F.expr(first_rank(mpn_and_desc, table)) if table else F.lit(None).cast("int")


def exact_row(supplier: Column, catalog: Sequence[CatalogRow]) -> Column:
    """Step 4a: the manufacturer's name, case aside."""
    return lookup(F.lower(supplier), _first_by(catalog, lambda r: r.manufacturer.lower()))


def with_fuzzy_row(
    df: DataFrame, supplier: Column, out: str, catalog: Sequence[CatalogRow] = rules.CATALOG
) -> DataFrame:
    """Step 4b: adds the row of the most similar manufacturer, NULL if none is similar enough."""
    keep = df.columns
    first = _first_by(catalog, lambda r: r.manufacturer)
    df = layer(df, {"_z_sorted": token_sort(supplier)})
    df = layer(df, {"_z_chars": F.split(F.col("_z_sorted"), "")})
    df = layer(df, {"_z_best": best_match("_z_sorted", "_z_chars", list(first), rules.FUZZY_FLOOR)})
    best = F.col("_z_best")
    hit = F.when(best["sim"] >= rules.FUZZY_FLOOR, -best["rank"])
    return df.select(*keep, F.get(literal_array(list(first.values())), hit).alias(out))


def resolve(
    df: DataFrame,
    supplier: Column,
    desc: Column,
    mpn: Column,
    brand: Column,
    catalog: Sequence[CatalogRow] = rules.CATALOG,
    out: tuple[str, str] = ("MANUFACTURER_NAME", "BRAND_NAME"),
) -> DataFrame:
    """Adds the canonical manufacturer and brand. Inputs may be raw; they are cleaned here."""
    keep = df.columns
    df = layer(
        df,
        {
            "_r_raw": clean_placeholder(supplier), "_r_brand": clean_placeholder(brand),
            "_r_quoted": plain_quotes(desc), "_r_mpn": F.upper(strip(text(mpn))),
        },
    )
    df = layer(
        df, {"_r_sup": drop_code(F.col("_r_raw")), "_r_desc": F.lower(drop_remark(F.col("_r_quoted")))}
    )
    sup, brd, dsc, num = (F.col(c) for c in ("_r_sup", "_r_brand", "_r_desc", "_r_mpn"))
    df = layer(df, {"_r_both": F.concat(dsc, F.lit("\n"), F.lower(num))})
    known = F.coalesce(
        alias_row(brd, catalog),
        distributor_row(sup, num, dsc, catalog),
        keyword_row("_r_both", catalog),
        exact_row(sup, catalog),
    )
    df = layer(df, {"_r_known": known})
    # only what is still open is sorted, split and compared
    df = with_fuzzy_row(df, F.when(F.col("_r_known").isNull(), sup), "_r_fuzzy", catalog)
    df = layer(df, {"_r_row": F.coalesce(F.col("_r_known"), F.col("_r_fuzzy"))})
    pos = F.col("_r_row")
    return df.select(
        *keep,
        F.coalesce(F.get(literal_array([r.manufacturer for r in catalog]), pos), sup, F.lit(UNKNOWN[0])).alias(out[0]),
        F.coalesce(F.get(literal_array([r.brand for r in catalog]), pos), sup, F.lit(UNKNOWN[1])).alias(out[1]),
    )


def resolve_two_arg(df: DataFrame, supplier: Column, desc_or_brand: Column, **kw) -> DataFrame:
    """Short form: one text serves as description and as brand, no part number."""
    return resolve(
        df, supplier, desc_or_brand, F.lit(""), desc_or_brand, out=("manufacturer_name", "brand_name"), **kw
    )
