"""A manufacturer catalog, its rule tables and a supplier feed with spelling changes, derived from the given tables.

Every customer is a manufacturer whose name is spelled out of its key and market segment; every part is a feed row
of one of them, written as it is, in capitals, with words in another order, with letters missing or added, or as a distributor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.operators.catalog import CatalogTables
from skuforge.operators.stages import spread

C = F.col
SYLLABLES = ["ba", "ce", "di", "fo", "gu", "ka", "le", "mi", "no", "pu"]


def spelled(key: str) -> Column:
    """The digits of a number, at least four, as syllables."""
    table = ", ".join(f"'{s}'" for s in SYLLABLES)
    return F.expr(f"array_join(transform(split(lpad(cast({key} as string), greatest(4, length(cast({key} as string))), '0'), ''), d -> element_at(array({table}), int(d) + 1)), '')")


def capital(c: str) -> Column:
    return F.expr(f"concat(upper(substr({c}, 1, 1)), lower(substr({c}, 2)))")


def makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pri, stem, manufacturer, brand; one row per customer."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select("*", spelled("c_custkey").alias("stem"), spelled("c_custkey * 7919 % 10007").alias("second")).select(
        C("c_custkey").alias("pri"), "stem", F.concat_ws(" ", capital("stem"), capital("second"), capital("c_mktsegment")).alias("manufacturer"),
        F.concat(F.upper("stem"), F.lit("®")).alias("brand"))


def tables(spark: SparkSession, sf_dir: str) -> CatalogTables:
    rows = makers(spark, sf_dir)
    catalog = rows.select("pri", "manufacturer", "brand", F.array(F.concat("stem", F.lit("-x")), F.concat(F.lit("no. "), "stem")).alias("keywords"))
    aliases = rows.where("pri % 3 = 0").select(F.concat("stem", F.lit(" inc")).alias("alias"), "brand")
    distributors = rows.where("pri % 50 = 7").select("pri", F.concat(F.lit("depot "), "stem").alias("distributor"), F.concat(F.lit("Z"), (C("pri") % 10).cast("string")).alias("prefix"), "manufacturer")
    return CatalogTables(catalog, aliases, distributors)


def changed(name: str, k: str) -> Column:
    """A name as the k-th kind of supplier spells it."""
    return F.expr(f"""case {k} % 8 when 0 then {name} when 1 then upper({name}) when 2 then array_join(reverse(split({name}, ' ')), ' ')
      when 3 then concat(substr({name}, 1, 2), substr({name}, 4)) when 4 then concat(substr({name}, 1, 5), 'qq', substr({name}, 6), ' Co')
      when 5 then concat(substr({name}, 1, 3), substr({name}, 7)) when 6 then concat('  ', replace({name}, ' ', '  '), ' (A1)') else concat('The ', translate({name}, 'aeiou', 'eioua')) end""")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name: of all customers and suppliers, with spelling changes."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(spelled("s_suppkey * 7 + 1"), F.lit(" Trading "), F.lower("s_name")).alias("name"), C("s_suppkey").alias("k"))
    own = makers(spark, sf_dir).select(C("manufacturer").alias("name"), C("pri").alias("k"))
    return own.union(supplier).select(changed("name", "k").alias("name")).distinct()


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id and the six required feed columns, one row per part."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"))
    rows = part.join(makers(spark, sf_dir), (C("p_partkey") * 11) % 100 == C("pri"))
    k = C("p_partkey")
    supplier = F.when(k % 50 == 9, "").when(k % 19 == 3, F.concat(F.lit("Depot "), "stem")).otherwise(changed("manufacturer", "p_partkey"))
    return rows.select(
        (k + 1).alias("row_id"), F.concat(F.lit("Z"), (k % 10).cast("string"), F.when(k % 23 == 0, F.concat(F.upper("stem"), F.lit("-X"))).otherwise(k.cast("string"))).alias("Mfg_Part_Num"),
        F.concat_ws(" ", "p_name", F.when(k % 17 == 2, F.concat(F.lit("No. "), "stem"))).alias("Part_Desc"),
        F.when(k % 13 == 4, F.concat("stem", F.lit(" Inc"))).otherwise("").alias("E1_Brand"), F.lit("").alias("Unilog_Brand"), F.lit("-- No DIB Brand --").alias("DIB_Brand"),
        supplier.alias("Part_Manuf"))
