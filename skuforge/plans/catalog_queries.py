"""The registered queries: every operator over the given tables, with its check in DuckDB SQL.

`QUERIES` maps a name to a function of (spark, sf_dir); `ORACLES` maps most of the names to SQL.
Frames that many queries share are built once per session. Queries that filter, join or count
results read a written results table (see plans.results).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions import similarity, units
from skuforge.functions import text as tx
from skuforge.operators import attributes as at
from skuforge.operators import catalog as ct
from skuforge.operators import delivery as dl
from skuforge.operators import describe as ds
from skuforge.operators import kpis as kp
from skuforge.operators import provenance as pv
from skuforge.operators import quality as qa
from skuforge.operators import resolve as rs
from skuforge.operators import serve as sv
from skuforge.operators import truth as tr
from skuforge.operators.normalize import missing_fields, normalize, pick_brand
from skuforge.operators.stages import layer, spread
from skuforge.operators.taxonomy import classify
from skuforge.oracle import catalog_sql as oc
from skuforge.oracle import sql as o
from skuforge.plans import pipeline as pl
from skuforge.plans.ranged import RangedResults
from skuforge.plans.results import shared_folder, written
from skuforge.sources import delivery_file, sample_catalog, sample_feed
from skuforge.sources import feed as fd
from skuforge.sources import records as rc
from skuforge.streaming import ingest

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_FRAMES: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn

    return register


def shared(stage: str) -> Callable[[Query], Query]:
    """A frame that is built once per session and folder."""

    def wrap(fn: Query) -> Query:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, stage)
            if key not in _FRAMES:
                _FRAMES[key] = fn(pl.tune(spark), sf_dir)
            return _FRAMES[key]

        return build

    return wrap


def text_list(c: Column) -> Column:
    return F.array_join(c, "|")


def res(final: str) -> str:
    return o.with_stages("res", final)


# ------------------------------------------------------------------------------------------ frames
@shared("feed")
def feed(spark, sf_dir):
    return sample_feed.feed(spark, sf_dir)


@shared("valid")
def valid(spark, sf_dir):
    """Feed rows with all required fields."""
    return feed(spark, sf_dir).where(F.size(missing_fields()) == 0)


@shared("normalized")
def normalized(spark, sf_dir):
    return normalize(valid(spark, sf_dir))


@shared("classified")
def classified(spark, sf_dir):
    return pl.classified(pl.describe_inputs(normalized(spark, sf_dir), ["row_id"]))


@shared("ruled")
def ruled(spark, sf_dir):
    return at.with_rules(classified(spark, sf_dir), C("part_desc_raw"), C("mfg_part_num"), C("manufacturer_name"))


@shared("extracted")
def extracted(spark, sf_dir):
    return pl.extracted(classified(spark, sf_dir))


@shared("featured")
def featured(spark, sf_dir):
    return ds.features(extracted(spark, sf_dir), values=C("label_values"))


@shared("described")
def described(spark, sf_dir):
    return ds.describe(featured(spark, sf_dir))


@shared("records")
def records(spark, sf_dir):
    return pl.enrich(normalized(spark, sf_dir), keep=["row_id"])


@shared("results")
def results(spark, sf_dir):
    return written(pl.run(feed(spark, sf_dir)), "results")


@shared("truth")
def truth(spark, sf_dir):
    return truth_rows(results(spark, sf_dir))


def truth_rows(rows: DataFrame) -> DataFrame:
    """A labelled row for every part: part number in lower case, manufacturer in upper case, brand
    without marks. Every fifth part number matches, the others carry a suffix; every 25th part is
    there twice, with different values."""
    base = rows.where(C("enriched").isNotNull())
    copies = F.when(C("row_id") % 25 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    base = base.select("*", F.explode(copies).alias("copy"))
    e = C("enriched")
    second = C("copy") == 1
    return base.select(
        (C("row_id") * 10 + C("copy")).alias("truth_id"),
        F.lower(F.concat(e["mfg_part_num"], F.when(C("row_id") % 5 == 0, "").otherwise("-X"))).alias("Mfg_Part_Num"),
        F.upper(e["mfg_part_num"]).alias("MANUFACTURER_PART_NUMBER"),
        F.upper(e["manufacturer_name"]).alias("MANUFACTURER_NAME"),
        F.when(second, "Other Brand").otherwise(tx.no_marks(e["brand_name"])).alias("BRAND_NAME"),
        F.replace(e["classpath"], F.lit(" > "), F.lit(">")).alias("Classpath"),
        e["unspsc"].alias("UNSPSC"),
        F.when(C("row_id") % 2 == 0, e["product_name"]).otherwise("").alias("Product Name"),
        e["invoice_desc"].alias("INVOICE_DESC"),
        F.when(second, "").otherwise(e["mobile_desc"]).alias("MOBILE_DESC"),
        F.concat(e["short_desc"], F.lit(" New")).alias("SHORT_DESC"),
        F.lit("").alias("LONG_DESC1"),
        F.lower(e["retail_desc"]).alias("RETAIL_DESC"),
    )


TRUTH = f"""truth as (select row_id * 10 + copy as truth_id, lower(m1 || case when row_id % 5 = 0 then '' else '-X' end) as t_mpn, upper(m1) as t_mpn2, upper(mfg) as t_mfg,
case when copy = 1 then 'Other Brand' else {o.marks('bctx')} end as t_brand, replace(classpath, ' > ', '>') as t_classpath, unspsc as t_unspsc,
case when row_id % 2 = 0 then product_name else '' end as t_product, invoice_desc as t_invoice,
case when copy = 1 then '' else mobile_desc end as t_mobile, short_desc || ' New' as t_short, '' as t_long, lower(retail_desc) as t_retail
from (select *, unnest(case when row_id % 25 = 0 then [0, 1] else [0] end) as copy from res where ok))"""


def res_truth(final: str, more: str = "") -> str:
    return o.with_stages("res", ", " + TRUTH + more + "\n" + final)


# ------------------------------------------------------------------------------------------ sources
FEED_TEXT = rules.FEED_COLUMNS


@query("scan_feed", o.with_stages("feed", "select row_id, " + ", ".join(f'"{c}"' for c in FEED_TEXT) + " from feed"))
def scan_feed(spark, sf_dir):
    """Feed files of two column orders, read back by name."""
    rows = fd.read_feed(spark, feed_files(spark, sf_dir))
    return rows.select(C("row_id").cast("bigint").alias("row_id"), *[C(f"`{c}`") for c in FEED_TEXT])


def write_feed(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("escape", '"').option("emptyValue", "").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def feed_files(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with the feed as CSV; the files of every other row have their columns the other way round."""
    path = f"{shared_folder(spark)}/skuforge/feed-csv-{uuid.uuid4().hex}"
    source = feed(spark, sf_dir)
    for k, columns in enumerate((source.columns, source.columns[::-1])):
        write_feed(source.where(C("row_id") % 2 == k).select(*[C(f"`{c}`") for c in columns]), path)
    return path


@query("check_columns", "select count(*) as rows_checked, '' as missing from part")
def check_columns(spark, sf_dir):
    rows = feed(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("rows_checked")).withColumn("missing", F.lit(", ".join(fd.missing_columns(rows.columns))))


_VARIANTS = [("fit", None), ("no-maker", "missing columns: Part_Manuf"), ("no-ids", "missing columns: Mfg_Part_Num, DIB_Brand"), ("twice", "duplicate columns: part_desc"), ("blank", "the file is empty")]


@query("check_feed_files", "select v as variant, case v " + " ".join(f"when '{v}' then {'null' if p is None else repr(p)}" for v, p in _VARIANTS)
       + " end as problem, case when v = 'fit' then (select count(*) from part where p_partkey % 4 = 0) end as rows_read from (select unnest(["
       + ", ".join(f"'{v}'" for v, _ in _VARIANTS) + "]) as v)")
def check_feed_files(spark, sf_dir):
    """Feeds with absent and repeated columns and without a line: what the header check says of each, and the rows of the fit one."""
    base = f"{shared_folder(spark)}/skuforge/feed-variants-{uuid.uuid4().hex}"
    rows = feed(spark, sf_dir).where(C("row_id") % 4 == 1).drop("row_id").coalesce(1)
    write_feed(rows, f"{base}/fit")
    write_feed(rows.drop("Part_Manuf"), f"{base}/no-maker")
    write_feed(rows.drop("Mfg_Part_Num", "DIB_Brand"), f"{base}/no-ids")
    lines = rows.select(F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(C(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"')) for c in rules.REQUIRED_COLUMNS], F.lit("x")).alias("value"))
    head = spark.createDataFrame([(0, ",".join([*rules.REQUIRED_COLUMNS, " PART_DESC "]))], "at int, value string")
    head.union(lines.select(F.lit(1).alias("at"), "value")).repartition(1).sortWithinPartitions("at").select("value").write.text(f"{base}/twice")
    spark.createDataFrame([(" ",)], "value string").coalesce(1).write.text(f"{base}/blank")
    said = fd.check_files(spark, f"{base}/*").select(F.regexp_extract("file", "/([a-z-]+)/part-[^/]*$", 1).alias("variant"), "problem")
    read = fd.read_feed(spark, f"{base}/fit").agg(F.count(F.lit(1)).alias("rows_read")).select(F.lit("fit").alias("variant"), "rows_read")
    return said.join(read, "variant", "left")


_FAULTS = """from (select row_number() over (order by p_partkey) as row_id, p_partkey as k, p_name, p_size from part)"""
_FAULT = """case when k % 11 = 3 then 'malformed record: 2 cells, expected 6' when k % 11 = 5 then 'malformed record: 8 cells, expected 6' end"""


@query("feed_faults", f"""select row_id, case when k % 11 in (3, 5) then 'error' else 'sound' end as status, {_FAULT} as message, case when k % 11 = 3 then p_name when k % 11 = 7 then p_name || chr(10) || 'size "' || p_size || '"' else p_name || ' 5"' end as part_desc,
case when k % 11 in (3, 5) then length(case k % 11 when 3 then 'P' || k || ',' || p_name else 'P' || k || ',' || p_name || ' 5",,,,maker,x,y' end) end as record_length {_FAULTS}""")
def feed_faults(spark, sf_dir):
    """A feed with short and long records, line breaks inside cells and inch marks in bare cells, read range by range."""
    k, name = C("p_partkey"), C("p_name")
    number = F.concat(F.lit("P"), k.cast("string"))
    line = F.when(k % 11 == 3, F.concat_ws(",", number, name)).when(k % 11 == 5, F.concat(number, F.lit(","), name, F.lit(' 5",,,,maker,x,y'))).when(
        k % 11 == 7, F.concat(number, F.lit(',"'), name, F.lit('\nsize ""'), C("p_size").cast("string"), F.lit('""",,,,maker'))).otherwise(F.concat(number, F.lit(","), name, F.lit(' 5",,,,maker')))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("at"), line.alias("value"))
    path = f"{shared_folder(spark)}/skuforge/feed-faults-{uuid.uuid4().hex}"
    head = spark.createDataFrame([(-1, ",".join(rules.REQUIRED_COLUMNS))], "at long, value string")
    head.union(part).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    rows = rc.read_records(spark, path)
    bad = rc.error_records(rows).select("row_id", "status", "message", F.length("record").alias("record_length"))
    return rows.select("row_id", C("Part_Desc").alias("part_desc")).join(bad, "row_id", "left").withColumn("status", F.coalesce("status", F.lit("sound"))).withColumn("record_length", C("record_length").cast("bigint"))


@query("blank_rows", "select p_partkey + 1 as row_id, p_name as \"Part_Desc\" from part where p_partkey % 7 <> 3")
def blank_rows(spark, sf_dir):
    """Rows without any cell, as spreadsheets leave them behind, are skipped."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    has = C("p_partkey") % 7 != 3
    cells = [F.when(has, C("p_name")).alias("Part_Desc"), F.when(has & (C("p_size") > 10), C("p_brand")).alias("E1_Brand")]
    return fd.drop_blank_rows(part.select((C("p_partkey") + 1).alias("row_id"), *cells)).select("row_id", "Part_Desc")


@query("duplicate_headers", "select lower(trim(p_name)) as name, count(*) as uses from part where trim(p_name) <> '' group by 1 having count(*) > 1")
def duplicate_headers(spark, sf_dir):
    """The duplicate-name rule as an aggregate, on part names as header cells."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lower(tx.strip(C("p_name"))).alias("name"))
    return names.where(C("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("uses")).where(C("uses") > 1)


@query("scan_truth", res_truth("select truth_id, t_mpn as mpn, t_brand as brand, t_classpath as classpath from truth"))
def scan_truth(spark, sf_dir):
    path = f"{shared_folder(spark)}/skuforge/truth-csv-{uuid.uuid4().hex}"
    truth(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    rows = fd.read_csv(spark, path)
    return rows.select(
        C("truth_id").cast("bigint").alias("truth_id"), C("Mfg_Part_Num").alias("mpn"), C("BRAND_NAME").alias("brand"),
        C("Classpath").alias("classpath"),
    )


@query("row_ids", "select row_number() over (order by p_partkey) as line, (p_partkey + 1)::bigint as row_id from part")
def row_ids(spark, sf_dir):
    """Lines of several files of unequal size (few rows in the first folder), numbered in input order."""
    base = f"{shared_folder(spark)}/skuforge/feed-parts-{uuid.uuid4().hex}"
    rows = feed(spark, sf_dir)
    for folder, part in (("0-few", C("row_id") <= 20), ("1-rest", C("row_id") > 20)):
        write_feed(rows.where(part).repartitionByRange(3, "row_id").sortWithinPartitions("row_id"), f"{base}/{folder}")
    numbered = fd.with_row_ids(fd.read_feed(spark, f"{base}/*", positions=True), "line")
    return numbered.select("line", C("row_id").cast("bigint").alias("row_id"))


ENRICHED = ["manufacturer_name", "brand_name", "series", "classpath", "unspsc", "product_name", *ds.DESCRIPTIONS, "mfr_url"]
_SQL_NAME = {"manufacturer_name": "mfg", "brand_name": "bctx", "mfg_part_num": "m1"}


@query("enrich", res(
    "select row_id, status, confidence, m1 as mfg_part_num, " + ", ".join(f"{_SQL_NAME.get(c, c)} as {c}" for c in ENRICHED)
    + ", array_to_string(list_transform(attributes, lambda a: a.label || '=' || a.value || ' ' || a.uom), '|') as attributes"
    ", array_to_string(features, '|') as features, array_to_string(ref_urls, '|') as ref_urls, array_to_string(reasons, '|') as reasons from res"
))
def enrich(spark, sf_dir):
    """The whole row pipeline over the whole feed."""
    return flat_results(pl.run(feed(spark, sf_dir)))


def flat_results(rows: DataFrame) -> DataFrame:
    e = C("enriched")
    attributes = F.transform(e["attributes"], lambda a: F.concat(a["label"], F.lit("="), a["value"], F.lit(" "), a["uom"]))
    return rows.select(
        "row_id", "status", "confidence", e["mfg_part_num"].alias("mfg_part_num"), *[e[c].alias(c) for c in ENRICHED],
        text_list(attributes).alias("attributes"), text_list(e["features"]).alias("features"),
        text_list(e["ref_urls"]).alias("ref_urls"), text_list(C("review")["reasons"]).alias("reasons"),
    )


_DELIVERED = ["MFR URL", "Ref URL 1", "Ref URL 2", "PART_NUMBER", "SKU - MY_PART_NUMBER", "Mfg_Part_Num", "BRAND_NAME", "Classpath", "MOBILE_DESC",
              "ITEM_FEATURES_1", "ITEM_FEATURES_2", "ITEM_FEATURES_7", "ITEM_FEATURES_20", "Product Name", "UNSPSC", "Warranty"]
_DELIVERED += [f"ATTRIBUTE_{p} {i}" for i in (1, 2, 3, 8, 50) for p in ("LABEL", "VALUE", "UOM")]


def _delivered_sql() -> str:
    def expr(c: str) -> str:
        fixed = {"MFR URL": "mfr_url", "Ref URL 1": "coalesce(ref_urls[1], '')", "Ref URL 2": "coalesce(ref_urls[2], '')",
                 "PART_NUMBER": "(row_id - 1)::varchar", "SKU - MY_PART_NUMBER": "(row_id - 1)::varchar", "Mfg_Part_Num": '"Mfg_Part_Num"',
                 "BRAND_NAME": "bctx", "Classpath": "classpath", "MOBILE_DESC": "mobile_desc", "Product Name": "product_name", "UNSPSC": "unspsc",
                 "Warranty": "''"}
        if c in fixed:
            return fixed[c]
        if c.startswith("ITEM"):
            return f"coalesce(features[{c.rsplit('_', 1)[1]}], '')"
        part, i = c.removeprefix("ATTRIBUTE_").split(" ")
        return f"coalesce(attributes[{i}].{part.lower()}, '')"

    return "select row_id, " + ", ".join(f'{expr(c)} as "{c}"' for c in _DELIVERED) + " from res where ok"


@query("delivery_row", res(_delivered_sql()))
def delivery_row(spark, sf_dir):
    rows = dl.to_delivery(dl.deliverable(results(spark, sf_dir)), keep=["row_id"])
    return rows.select("row_id", *[C(f"`{c}`") for c in _DELIVERED])


@query("delivery_cells", res(
    "select count(*) as row_count, 252::bigint as column_count, sum((mfr_url <> '')::int + least(len(ref_urls), 5) + least(len(features), 20) + "
    "list_sum(list_transform(attributes, lambda a: 2 + (a.uom <> '')::int))::bigint + "
    "11 + (unspsc <> '')::int + 7 + (\"E1_Brand\" <> '')::int + (\"Unilog_Brand\" <> '')::int + (\"DIB_Brand\" <> '')::int)::bigint as filled_cells from res where ok"))
def delivery_cells(spark, sf_dir):
    """All 252 columns at once: how many cells of the delivery table carry text."""
    rows = dl.to_delivery(dl.deliverable(results(spark, sf_dir)))
    per_row = sum(((C(f"`{c}`") != "").cast("bigint") for c in rows.columns), F.lit(0).cast("bigint"))
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(rows.columns)).cast("bigint").alias("column_count"),
                    F.sum(per_row).alias("filled_cells"))


def _written_delivery(spark, sf_dir, name):
    path = f"{shared_folder(spark)}/skuforge/{name}-{sf_dir.strip('/').replace('/', '-')}"
    return path


_BACK = ["Mfg_Part_Num", "Part_Desc", "BRAND_NAME", "MOBILE_DESC", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 1"]
_BACK_SQL = res(
    "select \"Mfg_Part_Num\", trim(\"Part_Desc\") as \"Part_Desc\", bctx as \"BRAND_NAME\", mobile_desc as \"MOBILE_DESC\", attributes[1].label as \"ATTRIBUTE_LABEL 1\", "
    "attributes[1].value as \"ATTRIBUTE_VALUE 1\" from res where ok"
)


@query("write_delivery", _BACK_SQL)
def write_delivery(spark, sf_dir):
    """Delivery CSV written and read back."""
    path = _written_delivery(spark, sf_dir, "delivery")
    delivery_file.write_delivery(dl.to_delivery(dl.deliverable(results(spark, sf_dir))), path)
    return delivery_file.read_delivery(spark, path).select(*[C(f"`{c}`") for c in _BACK])


@query("feed_to_delivery", _BACK_SQL)
def feed_to_delivery(spark, sf_dir):
    """Feed CSV to delivery CSV in one call."""
    target = _written_delivery(spark, sf_dir, "delivery2")
    delivery_file.feed_to_delivery(spark, feed_files(spark, sf_dir), target)
    return delivery_file.read_delivery(spark, target).select(*[C(f"`{c}`") for c in _BACK])


# ------------------------------------------------------------------------------------------ cleaning
def on_feed(name: str, check: str, **columns: Callable[[], Column]) -> None:
    """A query that adds expressions to the feed."""

    def run(spark, sf_dir):
        return feed(spark, sf_dir).select("row_id", *[build().alias(k) for k, build in columns.items()])

    query(name, o.with_stages("n1", check))(run)


on_feed("clean_placeholder", f"select row_id, {o.placeholder('\"E1_Brand\"')} as e1, {o.placeholder('\"Unilog_Brand\"')} as unilog from n1",
        e1=lambda: tx.clean_placeholder(C("E1_Brand")), unilog=lambda: tx.clean_placeholder(C("Unilog_Brand")))
on_feed("clean_supplier", f"select row_id, s1 as once, {o.supplier('s1')} as twice from n1",
        once=lambda: tx.clean_supplier(C("Part_Manuf")), twice=lambda: tx.clean_supplier(tx.clean_supplier(C("Part_Manuf"))))
on_feed("clean_desc", "select row_id, d1 as clean from n1", clean=lambda: tx.clean_desc(C("Part_Desc")))
on_feed("pick_brand", "select row_id, b1 as brand from n1", brand=lambda: pick_brand())
on_feed("required_fields", "select row_id, array_to_string(missing, ', ') as missing from n1", missing=lambda: F.array_join(missing_fields(), ", "))
on_feed("normalize_text", r"""select row_id, trim(regexp_replace(replace(replace(lower("Part_Desc"), '®', ''), '™', ''), '[^a-z0-9]+', ' ', 'g')) as plain from n1""",
        plain=lambda: tx.normalize_text(C("Part_Desc")))


@query("coalesce_inputs", o.with_stages("feed", f"""select row_id, {o.strip('"Mfg_Part_Num"')} as mpn, {o.strip('"Part_Desc"')} as "desc",
{o.strip('"Part_Manuf"')} as mfg, {o.strip('"E1_Brand"')} as brand from feed"""))
def coalesce_inputs(spark, sf_dir):
    rows = feed(spark, sf_dir)
    picked = pl.coalesce_inputs(rows)
    return rows.select("row_id", picked["_e_mpn"].alias("mpn"), picked["_e_desc"].alias("desc"), picked["_e_mfg"].alias("mfg"), picked["_e_brand"].alias("brand"))


@query("error_rows", res("""select row_id, case when length(short_desc) > 40 then 'error' else status end as status,
case when length(short_desc) > 40 then 'invoice_desc: at most 40 characters' end as message from (select *, case when len(list_distinct(list_concat(reasons,
case when short_desc = upper(short_desc) and short_desc <> lower(short_desc) then [] else ['x'] end))) > 0 then 'review' else 'success' end as st from res)
where ok""").replace("else status end as status", "else st end as status"))
def error_rows(spark, sf_dir):
    """Records whose invoice text is replaced by the (longer, mixed case) short text: those over
    the limit become error rows, the others are graded as usual."""
    rows = written(records(spark, sf_dir), "records").withColumn("invoice_desc", C("short_desc"))
    return qa.grade(rows).select("row_id", "status", C("error")["message"].alias("message"))


# ------------------------------------------------------------------------------------------ units
_VALUES = "case k % 6 when 0 then n::varchar when 1 then (n * 0.25)::decimal(12,4)::varchar when 2 then (n * k * 0.015625)::decimal(14,6)::varchar " \
    "when 3 then (n * 0.045)::decimal(12,3)::varchar when 4 then p_name else '' end"
_UNITS = [*list(rules.UNITS), "IN.", " Volts ", "Widgets", "FEET", ""]
_TOKENS = "case k % 6 when 0 then n::varchar || '-1/' || (k % 7)::varchar when 1 then n::varchar || '/16' when 2 then '.' || n::varchar when 3 then (n * 0.25)::decimal(12,2)::varchar " \
    "when 4 then p_name else n::varchar end"
_AFTERS = ["' x 4", ' "x', "ft long", " feet", "in.", " IN", "", "x5", "    f"]


def _k() -> tuple[Column, Column]:
    return C("p_partkey"), C("p_size")


def value_text() -> Column:
    k, n = _k()
    dec = lambda c, p, s: c.cast(f"decimal({p},{s})").cast("string")
    return (
        F.when(k % 6 == 0, n.cast("string")).when(k % 6 == 1, dec(n * F.lit(0.25), 12, 4))
        .when(k % 6 == 2, dec(n * k * F.lit(0.015625), 14, 6)).when(k % 6 == 3, dec(n * F.expr("0.045"), 12, 3))
        .when(k % 6 == 4, C("p_name")).otherwise("")
    )


def token_text() -> Column:
    k, n = _k()
    s = n.cast("string")
    return (
        F.when(k % 6 == 0, F.concat(s, F.lit("-1/"), (k % 7).cast("string"))).when(k % 6 == 1, F.concat(s, F.lit("/16")))
        .when(k % 6 == 2, F.concat(F.lit("."), s)).when(k % 6 == 3, (n * F.expr("0.25")).cast("decimal(12,2)").cast("string"))
        .when(k % 6 == 4, C("p_name")).otherwise(s)
    )


def pick_text(items: list[str]) -> Column:
    return F.get(tx.literal_array(items), (C("p_partkey") % len(items)).cast("int"))


def _pick_sql(items: list[str]) -> str:
    return "list_extract([" + ", ".join(o.q(i) for i in items) + f"], (k % {len(items)})::int + 1)"


def _units_sql(final: str) -> str:
    fractions = o.values([(i + 1, o.q(f)) for i, f in enumerate(rules.fraction_table(64))])
    f16 = o.values([(i + 1, o.q(f)) for i, f in enumerate(rules.fraction_table(16))])
    unit = o.values([(o.q(k), o.q(v)) for k, v in rules.UNITS.items()])
    num = r"regexp_full_match(trim({}), '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?')"
    whole = "(case when d < 0 then ceil(d) else floor(d) end)"
    frac = (
        f"case when d = floor(d) then d::bigint::varchar when fr is not null and {whole} > 0 then {whole}::bigint::varchar || '-' || fr "
        "when fr is not null then fr else rtrim(rtrim(printf('%.4f', d), '0'), '.') end"
    )
    return f"""with fr(i, f) as {fractions}, f16(i, f) as {f16}, un(w, u) as {unit},
p as (select p_partkey as k, p_size as n, p_name from part),
a as (select k, {_VALUES} as v, {_pick_sql(_UNITS)} as u, {_TOKENS} as tok, {_pick_sql(_AFTERS)} as aft from p),
b as (select *, case when {num.format('v')} then trim(v)::double end as d, coalesce((select min(un.u) from un where un.w = lower(trim(a.u))), trim(u)) as std from a),
c as (select *, (select min(f) from fr where abs(round(d - {whole}, 6) - i / 64.0) < 0.0005) as fr,
(select min(f) from f16 where abs((d - {whole}) - i / 16.0) < 0.001) as fr16 from b),
e as (select *, case when d is null then trim(v) else {frac} end as tf,
case when d is null then trim(v) when d = floor(d) then d::bigint::varchar else regexp_replace(d::decimal(30,12)::varchar, '\\.?0+$', '') end as rate from c)
{final}"""


def on_units(name: str, final: str, **columns: Callable[[], Column]) -> None:
    def run(spark, sf_dir):
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        base = part.select(
            C("p_partkey").alias("k"), value_text().alias("v"), pick_text(_UNITS).alias("u"), token_text().alias("tok"), pick_text(_AFTERS).alias("aft")
        )
        return base.select("k", *[build().alias(c) for c, build in columns.items()])

    query(name, _units_sql(final))(run)


on_units("trade_fraction", "select k, tf as out from e", out=lambda: units.trade_fraction(C("v")))
on_units("standardize_uom", "select k, std as out from e", out=lambda: units.standardize_uom(C("u")))
on_units("format_measurement", "select k, case when v = '' then '' else case when u = '' or std in ('in', 'ft', 'yd') then tf else rate end || case when u = '' or std = '' then '' else ' ' || std end end as out from e",
         out=lambda: units.format_measurement(C("v"), C("u")))
on_units("fraction_16ths", "select k, case when fr16 is not null and floor(d) > 0 then floor(d)::bigint::varchar || '-' || fr16 when fr16 is not null then fr16 else v end as out from e",
         out=lambda: units.fraction_16ths(C("v")))
on_units("fraction_to_double", r"""select k, case when regexp_full_match(tok, '\d+-\d+/\d+') then split_part(tok, '-', 1)::double + split_part(split_part(tok, '-', 2), '/', 1)::double / nullif(split_part(tok, '/', 2)::double, 0)
when contains(tok, '/') then split_part(tok, '/', 1)::double / nullif(split_part(tok, '/', 2)::double, 0) else try_cast(tok as double) end as out from e""",
         out=lambda: units.fraction_to_double(C("tok")))
on_units("peek_uom", """select k, case when starts_with(ltrim(aft), '''') then 'ft' when starts_with(ltrim(aft), '"') then 'in'
when starts_with(lower(ltrim(aft)), 'ft') or starts_with(lower(ltrim(aft)), 'feet') then 'ft' when starts_with(lower(ltrim(aft)), 'in') then 'in' else '?' end as out from e""",
         out=lambda: units.peek_uom(C("aft"), "?"))
on_units("normalize_uom", r"""select k, case when wd = '' then coalesce((select min(un.u) from un where un.w = lower(trim(vu))), trim(vu)) else x || ' ' || coalesce((select min(un.u) from un where un.w = lower(wd)), wd) end as out
from (select *, case when d2 is null then num when coalesce((select min(un.u) from un where un.w = lower(wd)), wd) in ('in', 'ft', 'yd') then
case when d2 = floor(d2) then d2::bigint::varchar when f2 is not null and floor(d2) > 0 then floor(d2)::bigint::varchar || '-' || f2 when f2 is not null then f2 else rtrim(rtrim(printf('%.4f', d2), '0'), '.') end
when d2 = floor(d2) then d2::bigint::varchar else regexp_replace(d2::decimal(30,12)::varchar, '\.?0+$', '') end as x
from (select *, (select min(f) from fr where abs(round(d2 - floor(d2), 6) - i / 64.0) < 0.0005) as f2
from (select *, try_cast(nullif(num, '') as double) as d2 from (select k, v || u as vu, regexp_extract(trim(v || u), '^([\d./-]+)\s*([A-Za-z°"''/]+)$', 1) as num, regexp_extract(trim(v || u), '^([\d./-]+)\s*([A-Za-z°"''/]+)$', 2) as wd from e))))""",
         out=lambda: units.normalize_uom(F.concat(C("v"), C("u"))))
on_feed("std_dimensions", r"""select row_id, case when regexp_matches(d1, '[xX]') then array_to_string(list_transform(regexp_split_to_array(trim(d1), '\s*[xX]\s*'), lambda p:
case when ends_with(trim(p), '"') or ends_with(trim(p), 'in') then trim(rtrim(trim(p), '"in')) || ' in'
when ends_with(trim(p), '''') or ends_with(trim(p), 'ft') then trim(rtrim(trim(p), '''ft')) || ' ft'
when ends_with(trim(p), 'mm') then trim(substr(trim(p), 1, length(trim(p)) - 2)) || ' mm'
when regexp_full_match(trim(p), '[\d./-]+') then trim(p) || ' in' else trim(p) end), ' x ') else trim(d1) end as dims from n1""",
        dims=lambda: units.std_dimensions(tx.clean_desc(C("Part_Desc"))))


# ------------------------------------------------------------------------------------------ resolve
def on_keys(name: str, final: str, build: Callable[[DataFrame], DataFrame], upto: str = "n3") -> None:
    """Resolution steps on the cleaned keys of the whole feed."""

    def run(spark, sf_dir):
        keys = feed(spark, sf_dir).select(
            "row_id", tx.clean_supplier(tx.clean_supplier(C("Part_Manuf"))).alias("sup"), pick_brand().alias("brand"),
            F.lower(tx.clean_desc(tx.clean_desc(C("Part_Desc")))).alias("dsc"), F.upper(tx.strip(C("Mfg_Part_Num"))).alias("num"),
        )
        return build(keys)

    query(name, o.with_stages(upto, final))(run)


def _brand(c: Column) -> Column:
    return F.get(tx.literal_array([r.brand for r in rules.CATALOG]), c)


on_keys("brand_alias", "select row_id, (select brand from cat where pri = p1) as brand from n3",
        lambda df: df.select("row_id", _brand(rs.alias_row(C("brand"), rules.CATALOG)).alias("brand")))
on_keys("distributor_override", "select row_id, p2::int as row from n3",
        lambda df: df.select("row_id", rs.distributor_row(C("sup"), C("num"), C("dsc"), rules.CATALOG).alias("row")))
on_keys("brand_keyword", "select row_id, p3::int as row from n3",
        lambda df: df.select("row_id", F.concat(C("dsc"), F.lit("\n"), F.lower("num")).alias("both")).select("row_id", rs.keyword_row("both", rules.CATALOG).alias("row")))
on_keys("mfg_exact", "select row_id, p4::int as row from n3",
        lambda df: df.select("row_id", rs.exact_row(C("sup"), rules.CATALOG).alias("row")))
on_keys("mfg_fuzzy", "select row_id, p5::int as row from n3",
        lambda df: rs.with_fuzzy_row(df, C("sup"), "row").select("row_id", "row"))


@query("token_sort_ratio", o.with_stages("fz", """select sup, pri::int as pri, round_even(100.0 * sim, 6) as score from fz_lcs"""))
def token_sort_ratio(spark, sf_dir):
    """Similarity of every cleaned supplier name of the feed with every manufacturer."""
    names = feed(spark, sf_dir).select(tx.clean_supplier(tx.clean_supplier(C("Part_Manuf"))).alias("sup")).distinct().where(C("sup").isNotNull())
    first = rs._first_by(rules.CATALOG, lambda r: r.manufacturer)
    catalog = F.array(*[F.struct(F.lit(i).alias("pri"), F.lit(m).alias("name")) for m, i in first.items()])
    pairs = names.select("sup", F.explode(catalog).alias("c"))
    return pairs.select("sup", C("c.pri").alias("pri"), F.bround(similarity.token_sort_ratio(C("sup"), C("c.name")), 6).alias("score"))


@query("mfg_fuzzy_join", oc.MFG_FUZZY_JOIN)
def mfg_fuzzy_join(spark, sf_dir):
    """The most similar of thousands of manufacturers for every customer and supplier name with spelling changes."""
    catalog = sample_catalog.makers(spark, sf_dir).select("pri", C("manufacturer").alias("name"))
    found = ct.most_similar(sample_catalog.names(spark, sf_dir), catalog)
    return found.select("name", "pri", F.bround(C("sim") * 100, 6).alias("score"))


@query("custom_catalog", oc.CUSTOM_CATALOG)
def custom_catalog(spark, sf_dir):
    """A feed resolved against a catalog, aliases and distributors that are tables of thousands of rows."""
    rows = normalize(sample_catalog.feed(spark, sf_dir), sample_catalog.tables(spark, sf_dir))
    return rows.select("row_id", C("MANUFACTURER_NAME").alias("mfg"), C("BRAND_NAME").alias("brand"))


@query("fixed_catalog_tables", o.with_stages("n4", "select row_id, mfg, brand from n4"))
def fixed_catalog_tables(spark, sf_dir):
    """The built-in catalog and rule tables as frames: the same answers as `resolve_brand`."""
    rows = normalize(feed(spark, sf_dir), ct.catalog_tables(spark))
    return rows.select("row_id", C("MANUFACTURER_NAME").alias("mfg"), C("BRAND_NAME").alias("brand"))


@query("resolve_brand", o.with_stages("n4", "select row_id, mfg, brand from n4"))
def resolve_brand(spark, sf_dir):
    return normalize(feed(spark, sf_dir)).select("row_id", C("MANUFACTURER_NAME").alias("mfg"), C("BRAND_NAME").alias("brand"))


@query("resolve_two_arg", o.with_stages("n4", f"""select row_id, coalesce((select mfg from cat where pri = p), s1, 'Unknown Manufacturer') as mfg, coalesce((select brand from cat where pri = p), s1, 'Unknown Brand') as brand
from (select n3.row_id, n3.s1, coalesce((select min(cat.pri) from alias join cat on cat.brand = alias.brand where alias.word = trim({o.marks('lower(b1)')})),
(select arg_min(c.pri, (dist.pri, c.pri)) from dist join cat c on c.mfg = dist.mfg where contains(lower(n3.s1), dist.dist) and contains(lower(coalesce(b1, '')), lower(dist.pre))),
(select min(kw.pri) from kw where contains(lower(coalesce(b1, '')), kw.word)), (select min(cat.pri) from cat where lower(cat.mfg) = lower(s1)),
(select min(fz_pri) from fz where fz.sup = n3.s1 and fz_sim >= 0.7 - 1e-12)) as p from n3)"""))
def resolve_two_arg(spark, sf_dir):
    rows = feed(spark, sf_dir).select("row_id", "Part_Manuf", pick_brand().alias("b"))
    out = rs.resolve_two_arg(rows, C("Part_Manuf"), C("b"))
    return out.select("row_id", C("manufacturer_name").alias("mfg"), C("brand_name").alias("brand"))


@query("normalize", o.with_stages("n4", "select row_id, d1 as clean_desc, mfg, brand, m1 as mpn, 'NORMALIZED' as stage1_status from n4"))
def normalize_query(spark, sf_dir):
    return normalize(feed(spark, sf_dir)).select(
        "row_id", C("CLEAN_DESC").alias("clean_desc"), C("MANUFACTURER_NAME").alias("mfg"), C("BRAND_NAME").alias("brand"),
        C("MANUFACTURER_PART_NUMBER").alias("mpn"), C("STAGE1_STATUS").alias("stage1_status"),
    )


@query("match_domain", res("select row_id, split_part(split_part(mfr_url, 'https://www.', 2), '/', 1) as domain from res where ok"))
def match_domain(spark, sf_dir):
    rows = classified(spark, sf_dir).select("row_id", pv.hay(C("manufacturer_name"), C("brand_name")).alias("hay"))
    return rows.select("row_id", pv.match_domain("hay").alias("domain"))


# ------------------------------------------------------------------------------------------ taxonomy
@query("classify", o.with_stages("e3", "select row_id, classpath, unspsc, product_name from e3"))
def classify_query(spark, sf_dir):
    return classified(spark, sf_dir).select("row_id", "classpath", "unspsc", "product_name")


@query("classify_raw", o.with_stages("tkw", f"""select p_partkey as k, coalesce(t.product_name, 'Hardware Component') as product_name from
(select p_partkey, (select min(tkw.pri) from tkw where contains(lower(p_type || ' ' || p_name || ' ' || p_brand), tkw.word)) as pri from part) p
left join tax t on t.pri = p.pri"""))
def classify_raw(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return classify(part, C("p_type"), C("p_name"), C("p_brand")).select(C("p_partkey").alias("k"), "product_name")


@query("classpath_leaf", o.with_stages("e3", f"select row_id, {o.leaf('classpath')} as leaf from e3"))
def classpath_leaf(spark, sf_dir):
    return classified(spark, sf_dir).select("row_id", tx.leaf(C("classpath")).alias("leaf"))


@query("generic_classpath", o.with_stages("e3", "select row_id, classpath = '' or contains(classpath, 'General Hardware') as generic from e3"))
def generic_classpath(spark, sf_dir):
    return classified(spark, sf_dir).select("row_id", tx.is_generic(C("classpath")).alias("generic"))


# ------------------------------------------------------------------------------------------ attributes
def attribute_lines(df: DataFrame) -> DataFrame:
    lines = df.select("row_id", F.posexplode_outer("attributes").alias("pos", "a")).where(C("a").isNotNull())
    return lines.select("row_id", (C("pos") + 1).alias("slot"), "a.label", "a.value", "a.uom")


def _lines_sql(rule: str | None) -> str:
    return o.with_stages("x4", f"""select row_id, i::int as slot, l[i].label as label, l[i].value as value, l[i].uom as uom
from (select row_id, l, unnest(range(1, len(l) + 1)) as i from (select row_id, {o.attributes(rule)} as l from x4))""")


def _rule_query(rule: str | None) -> Query:
    def run(spark, sf_dir):
        rows = ruled(spark, sf_dir).select("row_id", at.slot_array(rule).alias("_slots"))
        return attribute_lines(rows.select("row_id", at.filled_slots().alias("attributes")))

    return run


for _rule in at.RULES:
    query(f"attr_{_rule}", _lines_sql(_rule))(_rule_query(_rule))
query("attributes", _lines_sql(None))(_rule_query(None))


def _flag_query(column: str) -> Query:
    return lambda spark, sf_dir: ruled(spark, sf_dir).select("row_id", C(column).alias("flag"))


for _name, _column, _sql in (("attr_F39", "k_abrasive", "abr"), ("attr_F41", "k_fitting", "fit"), ("attr_F43", "k_fastener", "fas")):
    query(_name, o.with_stages("x4", f"select row_id, {_sql} as flag from x4"))(_flag_query(_column))


@query("attr_F37", o.with_stages("ft", "select row_id, array_to_string(detected, '|') as detected from ft"))
def detected(spark, sf_dir):
    return extracted(spark, sf_dir).select("row_id", text_list(C("detected_features")).alias("detected"))


@query("attr_F48", o.with_stages("att", """select row_id, series, mount as mount_type, material, finish, volt as voltage, case when vah1 = '' then amp0 else '' end as amperage,
sound as sound_level, pack as package_qty, case when press <> '' then 'Class ' || press else '' end as pressure_class, conn as connection_type,
flow as flow_rate, diameter, thickness, width, dlen as length, depth as depth_with_door_open from att"""))
def facts(spark, sf_dir):
    dims = ("diameter", "thickness", "width", "length", "depth_with_door_open")
    return extracted(spark, sf_dir).select("row_id", *at.SCALARS, *[C("dimensions")[d].alias(d) for d in dims])


# ------------------------------------------------------------------------------------------ describe
def on_described(name: str, column: str) -> None:
    query(name, o.with_stages("d9_", f"select row_id, {column} from d9_"))(
        lambda spark, sf_dir: described(spark, sf_dir).select("row_id", column)
    )


for _name, _column in (
    ("invoice_desc", "invoice_desc"), ("mobile_desc", "mobile_desc"), ("short_desc", "short_desc"), ("long_desc", "long_desc1"),
    ("retail_desc", "retail_desc"), ("marketing_desc", "marketing_description"),
):
    on_described(_name, _column)


@query("descriptions", o.with_stages("d9_", "select row_id, " + ", ".join(ds.DESCRIPTIONS) + " from d9_"))
def descriptions(spark, sf_dir):
    return described(spark, sf_dir).select("row_id", *ds.DESCRIPTIONS)


@query("abbreviate", "select p_partkey as k, array_to_string(list_transform(string_split(trim(regexp_replace(p_type || ' inches ' || p_name || ' Stainless built-in', '\\s+', ' ', 'g')), ' '), "
       "lambda w: case upper(w) " + " ".join(f"when {o.q(a)} then {o.q(b)}" for a, b in rules.ABBREVIATIONS.items()) + " else w end), ' ') as short from part")
def abbreviate(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.concat(C("p_type"), F.lit(" inches "), C("p_name"), F.lit(" Stainless built-in"))
    return part.select(C("p_partkey").alias("k"), ds.abbreviate(words).alias("short"))


@query("features", o.with_stages("ft", "select row_id, array_to_string(synthesized, '|') as features from ft"))
def features(spark, sf_dir):
    """Bullets from the attribute array alone (the pipeline takes the same values from columns)."""
    rows = ds.features(written(extracted(spark, sf_dir), "extracted"))
    return rows.select("row_id", text_list(C("synthesized")).alias("features"))


@query("merged_features", o.with_stages("ff", "select row_id, array_to_string(features, '|') as features from ff"))
def merged_features(spark, sf_dir):
    return featured(spark, sf_dir).select("row_id", text_list(C("features")).alias("features"))


@query("spec_phrase", o.with_stages("att", "select row_id, coalesce(list_filter(attributes, lambda a: a.label not in ('Product Type', 'Application'))[1].value || case when list_filter(attributes, lambda a: a.label not in ('Product Type', 'Application'))[1].uom <> '' then ' ' || list_filter(attributes, lambda a: a.label not in ('Product Type', 'Application'))[1].uom else '' end, '') as phrase from att"))
def spec_phrase(spark, sf_dir):
    return extracted(spark, sf_dir).select("row_id", ds.spec_phrase(C("attributes"), "Product Type", "Application").alias("phrase"))


@query("provenance_urls", res("select row_id, mfr_url, array_to_string(ref_urls, '|') as ref_urls from res where ok"))
def provenance_urls(spark, sf_dir):
    rows = pv.provenance_urls(classified(spark, sf_dir), C("manufacturer_name"), C("mfg_part_num"), C("brand_name"))
    return rows.select("row_id", "mfr_url", text_list(C("ref_urls")).alias("ref_urls"))


@query("exclude_retail", f"""select page_id, array_to_string((list_filter([url, 'https://www.amazon.com/' || page_id::varchar, replace(url, 'example', 'Walmart')],
lambda u: not {o.any_in('lower(u)', rules.SHOP_DOMAINS)}))[1:5], '|') as urls from pages""")
def exclude_retail(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = F.array(C("url"), F.concat(F.lit("https://www.amazon.com/"), C("page_id").cast("string")), F.replace(C("url"), F.lit("example"), F.lit("Walmart")))
    return pages.select("page_id", text_list(pv.exclude_shops(urls)).alias("urls"))


# ------------------------------------------------------------------------------------------ quality
@query("confidence", res("select row_id, score as confidence_score, score < 80 as needs_review, array_to_string(r1, '|') as reasons from res where ok"))
def confidence(spark, sf_dir):
    return records(spark, sf_dir).select("row_id", "confidence_score", "needs_review", text_list(C("review_reasons")).alias("reasons"))


@query("schema_check", res("select row_id, length(invoice_desc) <= 40 and length(mobile_desc) <= 85 as schema_valid from res where ok"))
def schema_check(spark, sf_dir):
    return records(spark, sf_dir).select("row_id", (F.size(qa.schema_errors()) == 0).alias("schema_valid"))


@query("validation_flags", res("""select row_id, length(invoice_desc)::int as invoice_len, v_char as invoice_char_pass, v_caps as invoice_caps,
v_char and v_caps as invoice_pass, length(mobile_desc)::int as mobile_len, v_85 as schema_mobile_pass, v_mob as mobile_target_pass,
len(attributes)::int as attribute_count, len(features)::int as feature_count, v_gen as generic_classpath from res where ok"""))
def validation_flags(spark, sf_dir):
    rows = records(spark, sf_dir).select("row_id", qa.validation_flags().alias("v"))
    names = ["invoice_len", "invoice_char_pass", "invoice_caps", "invoice_pass", "mobile_len", "schema_mobile_pass", "mobile_target_pass",
             "attribute_count", "feature_count", "generic_classpath"]
    return rows.select("row_id", *[C("v")[n].alias(n) for n in names])


@query("review_reasons", res("select row_id, array_to_string(reasons, '|') as reasons from res"))
def review_reasons(spark, sf_dir):
    return results(spark, sf_dir).select("row_id", text_list(C("review")["reasons"]).alias("reasons"))


@query("status", res("select row_id, status, len(reasons) > 0 as needs_review from res"))
def status(spark, sf_dir):
    return results(spark, sf_dir).select("row_id", "status", C("review")["needs_review"].alias("needs_review"))


@query("review_categories", res("select row_id, array_to_string(categories, '|') as categories from res"))
def review_categories(spark, sf_dir):
    return results(spark, sf_dir).select("row_id", text_list(C("review")["categories"]).alias("categories"))


# ------------------------------------------------------------------------------------------ delivery
@query("overflow_warnings", res("""select row_id, case when n > 20 then 'feature overflow: ' || n || ' features extracted, only first 20 exported' else '' end as feature_warning,
case when 8 * m > 50 then 'attribute overflow: ' || 8 * m || ' attributes extracted, only first 50 exported' else '' end as attribute_warning
from (select row_id, 4 * len(features) as n, len(attributes) as m from res where ok)"""))
def overflow_warnings(spark, sf_dir):
    """Records with their lists repeated, so that some outgrow the slots."""
    e = C("enriched")
    rows = dl.deliverable(results(spark, sf_dir)).select(
        "row_id", F.flatten(F.array_repeat(e["features"], 4)).alias("features"), F.flatten(F.array_repeat(e["attributes"], 8)).alias("attributes")
    )
    w = rows.select("row_id", qa.overflow_warnings().alias("w"))
    first = lambda word: F.coalesce(F.get(F.filter("w", lambda x: x.startswith(word)), F.lit(0)), F.lit(""))
    return w.select("row_id", first("feature").alias("feature_warning"), first("attribute").alias("attribute_warning"))


@query("header_gate", res("select count(*) as row_count, '' as errors, 'expected 252 columns, got 251; missing columns: [''MFR URL'']' as shorter from res where ok"))
def header_gate(spark, sf_dir):
    rows = dl.to_delivery(dl.deliverable(results(spark, sf_dir)))
    return rows.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit("; ".join(dl.header_errors(rows.columns))).alias("errors"), F.lit("; ".join(dl.header_errors(rows.columns[1:]))).alias("shorter")
    )


@query("row_gate", res("select count(*) as row_count, 0::bigint as null_cells from res where ok"))
def row_gate(spark, sf_dir):
    return dl.row_gate(dl.to_delivery(dl.deliverable(results(spark, sf_dir))))


@query("deliverable", res("select row_id, status from res where ok"))
def deliverable(spark, sf_dir):
    return dl.deliverable(results(spark, sf_dir)).select("row_id", "status")


@query("export_status", res("select 252::bigint as delivery_columns, true as valid, '' as errors, 0::bigint as warning_count, count(*) filter (ok) as row_count, count(*) filter (len(reasons) > 0) as rows_needing_review from res"))
def export_status(spark, sf_dir):
    return dl.export_status(results(spark, sf_dir)).withColumn("errors", F.array_join("errors", "; "))


# ------------------------------------------------------------------------------------------ kpis
_RATE = "round_even(100.0 * count(*) filter ({}) / count(*), 2)::double as {}"


@query("kpis", res("select count(*) as total, count(*) filter (status = 'success') as success, count(*) filter (status = 'review') as review, 0::bigint as errors, "
    + ", ".join(_RATE.format(c, n) for n, c in (
        ("success_rate", "status = 'success'"), ("invoice_char_pass", "v_char"), ("invoice_caps_pass", "v_caps"), ("schema_mobile_pass", "v_85"),
        ("mobile_target_60_80_pass", "v_mob"), ("schema_pass_rate", "ok"), ("classpath_specific_rate", "not v_gen"), ("attribute_coverage", "ok and len(attributes) > 0")))
    + ", round_even(avg(confidence), 2) as avg_confidence, round_even(avg(coalesce(len(attributes), 0)), 2) as avg_attributes from res"))
def kpis(spark, sf_dir):
    return kp.kpis(results(spark, sf_dir))


@query("confidence_histogram", res("select bucket, count(row_id) as count from (values ('0-59', 0, 59), ('60-79', 60, 79), ('80-89', 80, 89), ('90-99', 90, 99), ('100', 100, 100)) b(bucket, lo, hi) left join res on confidence between lo and hi group by bucket"))
def confidence_histogram(spark, sf_dir):
    return kp.confidence_histogram(results(spark, sf_dir))


_BUCKETED = """select bucket as reason, count(*) as count from (select case when contains(r, 'INVOICE_DESC exceeds') then 'Invoice description over 40 characters'
when contains(r, 'not uppercase') then 'Invoice description not uppercase' when contains(r, 'MOBILE_DESC') then 'Mobile description outside target window'
when contains(r, 'No technical attributes') then 'No technical attributes extracted' when contains(lower(r), 'classpath') then 'Generic taxonomy fallback'
when contains(lower(r), 'failed') then 'Processing error' when contains(lower(r), 'schema') then 'Schema validation failure' else r end as bucket
from (select unnest(reasons) as r from res)) group by bucket order by count desc, reason"""


@query("reason_counts", res(_BUCKETED))
def reason_counts(spark, sf_dir):
    return kp.reason_counts(results(spark, sf_dir))


@query("top_reasons", res(_BUCKETED + " limit 8"))
def top_reasons(spark, sf_dir):
    return kp.top_reasons(results(spark, sf_dir))


@query("status_distribution", res("select s as status, count(row_id) as count from (values ('success'), ('review'), ('error')) v(s) left join res on res.status = s group by s"))
def status_distribution(spark, sf_dir):
    return kp.status_distribution(results(spark, sf_dir))


@query("engine_kpis", res("select count(*) as total_records, round_even(100.0 * count(*) filter (v_char) / count(*), 2)::double as invoice_char_limit_pass_rate, round_even(100.0 * count(*) filter (v_caps) / count(*), 2)::double as invoice_all_caps_pass_rate, "
    "round_even(100.0 * count(*) filter (length(mobile_desc) between 50 and 85) / count(*), 2)::double as mobile_desc_compliance_rate, round_even(avg(score), 2) as avg_confidence_score, count(*) filter (score < 80) as needs_review_count, "
    "round_even(100.0 * count(*) filter (score < 80) / count(*), 2)::double as needs_review_percentage, case when count(*) filter (v_char) >= 0.98 * count(*) then 'WINNER' else 'NEEDS_TUNING' end as overall_status from res where ok"))
def engine_kpis(spark, sf_dir):
    return kp.engine_kpis(results(spark, sf_dir).where(C("enriched").isNotNull()).select("enriched.*"))


@query("scorecard", res("""select metric, value, target, case when value >= target then 'PASS' else 'CHECK' end as verdict from (select unnest([
struct_pack(metric := 'Invoice Desc (<=40 chars)', value := round_even(100.0 * count(*) filter (v_char) / count(*), 2)::double, target := 100.0::double),
struct_pack(metric := 'Invoice Desc (ALL CAPS)', value := round_even(100.0 * count(*) filter (v_caps) / count(*), 2)::double, target := 100.0::double),
struct_pack(metric := 'Mobile Desc (schema <=85)', value := round_even(100.0 * count(*) filter (v_85) / count(*), 2)::double, target := 90.0::double),
struct_pack(metric := 'Mobile Desc (target 60-80)', value := round_even(100.0 * count(*) filter (v_mob) / count(*), 2)::double, target := 90.0::double),
struct_pack(metric := 'Schema validation', value := round_even(100.0 * count(*) filter (ok) / count(*), 2)::double, target := 100.0::double),
struct_pack(metric := 'Specific classpath (non-generic)', value := round_even(100.0 * count(*) filter (not v_gen) / count(*), 2)::double, target := 95.0::double),
struct_pack(metric := 'Attribute coverage', value := round_even(100.0 * count(*) filter (ok and len(attributes) > 0) / count(*), 2)::double, target := 90.0::double),
struct_pack(metric := 'Delivery columns', value := 252.0::double, target := 252.0::double)], recursive := true) from res)"""))
def scorecard(spark, sf_dir):
    return kp.scorecard(results(spark, sf_dir))


@query("batch_summary", res("select count(*) as processed, count(*) filter (status = 'success') as success, count(*) filter (status = 'review') as review, 0::bigint as errors, 100::bigint as progress, case when count(*) filter (status <> 'success') > 0 then 'completed_with_review' else 'completed' end as status from res"))
def batch_summary(spark, sf_dir):
    return kp.batch_summary(results(spark, sf_dir))


@query("top_classpaths", res("select classpath, count(*) as count from res where ok group by classpath order by count desc, classpath limit 8"))
def top_classpaths(spark, sf_dir):
    return kp.top_classpaths(results(spark, sf_dir))


@query("category_counts", res("select c as category, count(row_id) as count from (values ('all'), " + ", ".join(f"({o.q(c)})" for c in rules.REVIEW_CATEGORIES) + ") v(c) left join res on len(reasons) > 0 and (c = 'all' or list_contains(categories, c)) group by c"))
def category_counts(spark, sf_dir):
    return kp.category_counts(results(spark, sf_dir))


# ------------------------------------------------------------------------------------------ truth
_LAST = ", last_truth as (select upper(trim(t_mpn)) as key_, max_by(truth, truth_id) as t from truth where trim(t_mpn) <> '' group by 1)"
_FIRST = ", first_truth as (select upper(trim(t_mpn)) as key_, min_by(truth, truth_id) as t from truth where trim(t_mpn) <> '' group by 1)"


@query("truth_join", res_truth("select row_id, t.t_brand as truth_brand, t.t_mobile as truth_mobile from res join last_truth on key_ = upper(trim(m1)) where ok", _LAST))
def truth_join(spark, sf_dir):
    rows = tr.truth_join(results(spark, sf_dir), truth(spark, sf_dir))
    return rows.select("row_id", C("truth")["BRAND_NAME"].alias("truth_brand"), C("truth")["MOBILE_DESC"].alias("truth_mobile"))


@query("row_detail", res_truth("select row_id, status, t.t_brand as truth_brand, t.truth_id % 10 = 0 as is_first from res left join first_truth on key_ = upper(trim(m1)) where row_id = 50", _FIRST))
def row_detail(spark, sf_dir):
    row = tr.row_detail(results(spark, sf_dir), truth(spark, sf_dir), 50)
    return row.select("row_id", "status", C("truth")["BRAND_NAME"].alias("truth_brand"), C("truth").isNotNull().alias("is_first"))


_FIELD_SQL = {
    "MANUFACTURER_NAME": ("t_mfg", "mfg"), "BRAND_NAME": ("t_brand", "bctx"), "MANUFACTURER_PART_NUMBER": ("t_mpn2", "m1"),
    "Classpath": ("t_classpath", "classpath"), "UNSPSC": ("t_unspsc", "unspsc"), "Product Name": ("t_product", "product_name"),
    "INVOICE_DESC": ("t_invoice", "invoice_desc"), "MOBILE_DESC": ("t_mobile", "mobile_desc"), "SHORT_DESC": ("t_short", "short_desc"),
    "LONG_DESC1": ("t_long", "long_desc1"), "RETAIL_DESC": ("t_retail", "retail_desc"),
}


def _plain(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace(lower({x}), '®', ''), '™', ''), '[^a-z0-9]+', ' ', 'g'))"


_PAIRS = " union all ".join(f"select {o.q(f)} as field, t.{a} as want, {b} as got from res join last_truth on key_ = upper(trim(m1)) where ok" for f, (a, b) in _FIELD_SQL.items())


@query("truth_benchmark", res_truth(f"""select (select count(*) from last_truth) as ground_truth_rows, (select count(*) from pairs where field = 'Classpath') as matched_rows,
(select round_even(avg(norm_), 2) from rates where compared > 0) as overall_normalized_match_rate, field, compared, exact_ as exact_match_rate, norm_ as normalized_match_rate from rates""",
    _LAST + f""", pairs as ({_PAIRS}), rates as (select field, count(*) filter (want <> '') as compared,
coalesce(round_even(100.0 * count(*) filter (want <> '' and want = got) / nullif(count(*) filter (want <> ''), 0), 2), 0)::double as exact_,
coalesce(round_even(100.0 * count(*) filter (want <> '' and {_plain('want')} = {_plain('got')}) / nullif(count(*) filter (want <> ''), 0), 2), 0)::double as norm_ from pairs group by field)"""))
def truth_benchmark(spark, sf_dir):
    return tr.truth_benchmark(results(spark, sf_dir), truth(spark, sf_dir))


def scored_pairs(spark, sf_dir) -> DataFrame:
    """Row i of the truth against row i of the results (part order on both sides)."""
    e = C("enriched")
    rows = results(spark, sf_dir).where(e.isNotNull())
    pred = rows.select(
        C("row_id").alias("row_index"), e["manufacturer_name"].alias("MANUFACTURER_NAME"), e["brand_name"].alias("BRAND_NAME"),
        e["invoice_desc"].alias("INVOICE_DESC"), e["mobile_desc"].alias("MOBILE_DESC"), e["short_desc"].alias("SHORT_DESC"),
    )
    gt = truth(spark, sf_dir).where(C("truth_id") % 10 == 0).select(
        F.expr("truth_id div 10").alias("row_index"), "MANUFACTURER_NAME", "BRAND_NAME", "SHORT_DESC"
    )
    # scoring costs about a millisecond a row, and the join's tasks are cut by bytes alone
    return spread(tr.zip_join(pred, gt))


_ZIPPED = "(select * from res join truth on truth_id = res.row_id * 10 where ok)"


@query("zip_join", res_truth("select res.row_id as row_index, t_mfg as gt_mfg, mfg as pred_mfg from res join truth on truth_id = res.row_id * 10 where ok"))
def zip_join(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select(
        "row_index", C("gt")["MANUFACTURER_NAME"].alias("gt_mfg"), C("pred")["MANUFACTURER_NAME"].alias("pred_mfg")
    )


@query("zip_rows", """select i as row_index, a.p_name as pred_name, b.n as gt_total from (select row_number() over (order by p_partkey) as i, p_name from part) a
join (select row_number() over (order by o_orderkey) as i, o_totalprice as n from orders) b using (i)""")
def zip_rows(spark, sf_dir):
    """Parts in order of their key beside orders in order of theirs: neither frame carries a number, and one is longer."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    pairs = tr.zip_rows(read("part").sort("p_partkey").select("p_name"), read("orders").sort("o_orderkey").select("o_totalprice"))
    return pairs.select("row_index", C("pred")["p_name"].alias("pred_name"), C("gt")["o_totalprice"].alias("gt_total"))


# SHORT_DESC of the truth is the predicted text plus ' New'; after sorting, the predicted words are a
# subsequence of the truth's, so the LCS is the length of the shorter text.
_SCORED = """, scored as (select res.row_id as row_index, lower(trim(t_mfg)) = lower(trim(mfg)) as mfg_match, trim(t_brand) = trim(bctx) as brand_match, length(invoice_desc) <= 40 as inv_len,
invoice_desc = upper(invoice_desc) as inv_caps, length(mobile_desc) between 60 and 80 as mob_len, t_brand, bctx, mobile_desc,
(1.0::double - 4.0 / (2 * length(s) + 4)) * 100 as sim
from (select *, array_to_string(list_sort(string_split(trim(regexp_replace(short_desc, '\\s+', ' ', 'g')), ' ')), ' ') as s from res) res join truth on truth_id = res.row_id * 10 where ok),
scored2 as (select *, (case when mfg_match then 25 else 0 end + case when brand_match then 25 else 0 end + case when inv_len and inv_caps then 15 else 0 end + case when mob_len then 15 else 0 end) + sim * 0.2 as c,
(not brand_match and t_brand <> '')::int + (not mob_len)::int + (not mfg_match)::int as n_issues from scored)"""


@query("score_rows", res_truth("select row_index, mfg_match, brand_match, inv_len as invoice_desc_len_valid, inv_caps as invoice_desc_caps_valid, mob_len as mobile_desc_len_valid, round_even(sim, 4) as similarity, round_even(c, 2) as confidence, c < 75 or n_issues > 0 as needs_human_review, n_issues::int as issues from scored2", _SCORED))
def score_rows(spark, sf_dir):
    rows = tr.score_rows(scored_pairs(spark, sf_dir))
    return rows.select(
        "row_index", "mfg_match", "brand_match", "invoice_desc_len_valid", "invoice_desc_caps_valid", "mobile_desc_len_valid",
        F.bround("short_desc_similarity", 4).alias("similarity"), C("confidence_score").alias("confidence"), "needs_human_review",
        F.size("audit_issues").alias("issues"),
    )


@query("score_summary", res_truth("""select count(*) as total_evaluated, round_even(100.0 * count(*) filter (mfg_match) / count(*), 2)::double as mfg_accuracy_pct,
round_even(100.0 * count(*) filter (brand_match) / count(*), 2)::double as brand_accuracy_pct, round_even(100.0 * count(*) filter (inv_len and inv_caps) / count(*), 2)::double as invoice_desc_compliance_pct,
round_even(100.0 * count(*) filter (mob_len) / count(*), 2)::double as mobile_desc_compliance_pct, round_even(sum(sim) / count(*), 2) as short_desc_avg_similarity_pct,
round_even(sum(round_even(c, 2)) / count(*), 2) as avg_confidence_score_pct, count(*) filter (c < 75 or n_issues > 0) as needs_human_review_count,
round_even(100.0 * count(*) filter (c < 75 or n_issues > 0) / count(*), 2)::double as review_rate_pct from scored2""", _SCORED))
def score_summary(spark, sf_dir):
    return tr.score_summary(tr.score_rows(scored_pairs(spark, sf_dir)))


# ------------------------------------------------------------------------------------------ serving
@query("results_by_status", res("select row_id, \"Mfg_Part_Num\" as mpn, confidence from res where status = 'success'"))
def results_by_status(spark, sf_dir):
    return sv.by_status(results(spark, sf_dir), "success").select("row_id", "mpn", "confidence")


@query("results_search", res("select row_id, \"Mfg_Part_Num\" as mpn from res where contains(lower(concat_ws(' ', coalesce(m1, ''), coalesce(bctx, ''), coalesce(product_name, ''), coalesce(classpath, ''), \"Mfg_Part_Num\", \"Part_Desc\")), 'dishwasher')"))
def results_search(spark, sf_dir):
    return sv.search(results(spark, sf_dir), "DishWasher").select("row_id", "mpn")


@query("results_page", res("select row_id, \"Mfg_Part_Num\" as mpn, status from res where status = 'review' order by row_id limit 25 offset 25"))
def results_page(spark, sf_dir):
    return sv.page(results(spark, sf_dir), 2, 25, "review").select("row_id", "mpn", "status")


@query("results_page_info", res("select count(*) as total, ceil(count(*) / 25.0)::bigint as pages from res where status = 'review'"))
def results_page_info(spark, sf_dir):
    return sv.page_info(results(spark, sf_dir), 25, "review")


@query("result_by_id", res("select row_id, status, \"Part_Desc\" as part_desc, invoice_desc from res where row_id = 9"))
def result_by_id(spark, sf_dir):
    return sv.by_id(results(spark, sf_dir), 9).select("row_id", "status", "part_desc", C("enriched")["invoice_desc"].alias("invoice_desc"))


@query("review_queue", res("select row_id, \"Mfg_Part_Num\" as mpn, \"Part_Desc\" as part_desc, coalesce(bctx, '') as brand_name, confidence as confidence_score, status, array_to_string(reasons, '|') as reasons, array_to_string(categories, '|') as categories from res where len(reasons) > 0"))
def review_queue(spark, sf_dir):
    rows = sv.review_queue(results(spark, sf_dir))
    return rows.withColumn("reasons", text_list(C("reasons"))).withColumn("categories", text_list(C("categories")))


@query("review_queue_category", res("select row_id, array_to_string(categories, '|') as categories from res where len(reasons) > 0 and list_contains(categories, 'generic_taxonomy')"))
def review_queue_category(spark, sf_dir):
    return sv.review_queue(results(spark, sf_dir), "generic_taxonomy").select("row_id", text_list(C("categories")).alias("categories"))


_ACTIONS_SQL = ", ".join(o.q(a) for a in sv.ACTIONS)


def decisions(spark, sf_dir) -> DataFrame:
    """Two decisions for every result row: an action by row id, later the next one."""
    rows = results(spark, sf_dir).select("row_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"))
    actions = tx.literal_array(sv.ACTIONS)
    return rows.select(
        "row_id", F.get(actions, ((C("row_id") + C("nth")) % 4).cast("int")).alias("action"), F.concat(F.lit("c"), C("nth").cast("string")).alias("comment"),
        F.timestamp_seconds(C("row_id") * 10 + C("nth")).alias("at"),
    )


@query("apply_decisions", res(f"""select row_id, list_extract([{_ACTIONS_SQL}], ((row_id + 1) % 4)::int + 1) as action, 'c1' as comment,
len(reasons) > 0 and not (list_extract([{_ACTIONS_SQL}], (row_id % 4)::int + 1) <> 'reject' or list_extract([{_ACTIONS_SQL}], ((row_id + 1) % 4)::int + 1) <> 'reject') as needs_review from res"""))
def apply_decisions(spark, sf_dir):
    rows = sv.apply_decisions(results(spark, sf_dir), decisions(spark, sf_dir))
    return rows.select("row_id", C("decision")["action"].alias("action"), C("decision")["comment"].alias("comment"), C("review")["needs_review"].alias("needs_review"))


_RANGED: dict[tuple[str, str], RangedResults] = {}


def ranged(spark: SparkSession, sf_dir: str) -> RangedResults:
    """Results in ranges of 300 row ids, written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RANGED:
        _RANGED[key] = RangedResults.write(results(spark, sf_dir), f"{shared_folder(spark)}/skuforge/ranged-{uuid.uuid4().hex}", 300)
    return _RANGED[key]


@query("ranged_page", res("select row_id, \"Mfg_Part_Num\" as mpn, status from res where status = 'review' order by row_id limit 25 offset 500"))
def ranged_page(spark, sf_dir):
    """Page 21 through the count index."""
    return ranged(spark, sf_dir).page(21, 25, "review").select("row_id", "mpn", "status")


@query("ranged_after", res("select row_id, status from res where status = 'review' and row_id > 590 order by row_id limit 40"))
def ranged_after(spark, sf_dir):
    """The page behind a row."""
    return ranged(spark, sf_dir).after(590, 40, "review").select("row_id", "status")


@query("ranged_page_info", res("select count(*) as total, ceil(count(*) / 25.0)::bigint as pages from res where status = 'review'"))
def ranged_page_info(spark, sf_dir):
    return ranged(spark, sf_dir).info(25, "review")


_LATER = "list_extract([" + _ACTIONS_SQL + "], ((row_id + 1) % 4)::int + 1)"
_EARLIER = "list_extract([" + _ACTIONS_SQL + "], (row_id % 4)::int + 1)"


@query("merge_decisions", res(f"""select row_id, case when row_id % 900 < 450 then {_LATER} when row_id % 3 = 0 then {_EARLIER} end as action,
case when row_id % 900 < 450 then 'c1' when row_id % 3 = 0 then 'c0' end as comment,
len(reasons) > 0 and not ((row_id % 3 = 0 and {_EARLIER} <> 'reject') or (row_id % 900 < 450 and {_LATER} <> 'reject')) as needs_review from res"""))
def merge_decisions(spark, sf_dir):
    """Later decisions arrive first, for some ranges; earlier ones for every third row follow."""
    store = RangedResults.write(results(spark, sf_dir), f"{shared_folder(spark)}/skuforge/ranged-{uuid.uuid4().hex}", 300)
    every = decisions(spark, sf_dir)
    store.merge(every.where((C("comment") == "c1") & (C("row_id") % 900 < 450)))
    store.merge(every.where((C("comment") == "c0") & (C("row_id") % 3 == 0)))
    return store.rows().select("row_id", C("decision")["action"].alias("action"), C("decision")["comment"].alias("comment"), C("review")["needs_review"].alias("needs_review"))


@query("length_budget", res("select row_id, " + ", ".join(f"length({c})::bigint as {c}_len, length({c}) <= {n} as {c}_ok" for c, n in rules.CHANNEL_LIMITS.items()) + " from res where ok"))
def length_budget(spark, sf_dir):
    return sv.length_budget(dl.deliverable(results(spark, sf_dir)).select("row_id", "enriched.*"))


_FLAT = lambda x: rf"regexp_replace(lower(trim({x})), '\s+', ' ', 'g')"


def _diff_sql() -> str:
    lines = [("raw", c, f'"{c}"', "false", "true") for c in rules.REQUIRED_COLUMNS]
    for label, a, b in (("MANUFACTURER_PART_NUMBER", "m1", '"Mfg_Part_Num"'), ("MANUFACTURER_NAME", "mfg", '"Part_Manuf"'), ("BRAND_NAME", "bctx", '"E1_Brand"')):
        lines.append(("generated", label, a, f"{_FLAT(a)} <> {_FLAT(b)}", "true"))
    for label, a in (("SERIES", "series"), ("Product Name", "product_name"), ("Classpath", "classpath"), ("UNSPSC", "unspsc")):
        lines.append(("generated", label, a, f"{a} <> ''", "true"))
    lines.append(("generated", "Confidence", "printf('%.1f', confidence)", "false", "true"))
    for label, a, b in (("MANUFACTURER_PART_NUMBER", "t.t_mpn2", ""), ("MANUFACTURER_NAME", "t.t_mfg", "mfg"), ("BRAND_NAME", "t.t_brand", "bctx"), ("SERIES", "''", ""),
                        ("Product Name", "t.t_product", "product_name"), ("Classpath", "t.t_classpath", "classpath"), ("UNSPSC", "t.t_unspsc", "unspsc")):
        lines.append(("truth", label, a, f"{_FLAT(a)} <> {_FLAT(b)}" if b else "false", "t is not null"))
    return " union all ".join(f"select row_id, {o.q(p)} as panel, {o.q(l)} as label, {v} as value, {c} as changed from j where {w}" for p, l, v, c, w in lines)


@query("three_way_diff", res_truth(_diff_sql(), _FIRST + ", j as (select * from res left join first_truth on key_ = upper(trim(m1)) where ok)"))
def three_way_diff(spark, sf_dir):
    rows = dl.deliverable(results(spark, sf_dir)).withColumn("truth_key", tr.match_key(C("enriched")["mfg_part_num"]))
    return sv.three_way_diff(rows.join(tr.truth_by_key(truth(spark, sf_dir), "truth_id", last=False), "truth_key", "left"))


# ------------------------------------------------------------------------------------------ streaming
def _part_stream(spark, sf_dir) -> DataFrame:
    """The part table as a stream of feed rows."""
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    part = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir).select("p_partkey", "p_name", "p_size")
    # a stream cannot be counted before it runs
    part = part.repartition(4 * spark.sparkContext.defaultParallelism)
    columns = sample_feed.feed_columns(C("p_partkey"), C("p_name"), C("p_size"))
    return part.select((C("p_partkey") + 1).alias("row_id"), *[v.alias(c) for c, v in columns.items()])


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/skuforge/{name}-{uuid.uuid4().hex}"


@query("stream_enrich", res("select row_id, status, invoice_desc, mobile_desc from res"))
def stream_enrich(spark, sf_dir):
    target = _fresh(pl.tune(spark), "stream")
    ingest.stream_enrich(_part_stream(spark, sf_dir), f"{target}/rows", f"{target}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{target}/rows")
    return rows.select("row_id", "status", C("enriched")["invoice_desc"].alias("invoice_desc"), C("enriched")["mobile_desc"].alias("mobile_desc"))


@query("stream_counters", res("select count(*) as processed, count(*) filter (status = 'success') as success, count(*) filter (status = 'review') as review, 0::bigint as errors from res"))
def stream_counters(spark, sf_dir):
    target = _fresh(pl.tune(spark), "counters")
    ingest.stream_counters(_part_stream(spark, sf_dir), f"{target}/rows", f"{target}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{target}/rows")
    return rows.agg(*[F.sum(c).alias(c) for c in ("processed", "success", "review", "errors")])


@query("stream_feed_files", res("""select row_number() over (order by row_id % 2, row_id) as row_id, "Part_Desc" as part_desc, status, processed from res
join (select row_id % 2 as half, count(*) as processed from res group by 1) on half = row_id % 2"""))
def stream_feed_files(spark, sf_dir):
    """A micro-batch of a fit and an unfit feed file, then one of another: ids go on, counters come from the written rows."""
    target = _fresh(pl.tune(spark), "stream-files")
    rows = feed(spark, sf_dir)
    for half in range(2):
        write_feed(rows.where(C("row_id") % 2 == half).coalesce(1).sortWithinPartitions("row_id").drop("row_id"), f"{target}/in/{half}")
        if half == 0:
            write_feed(rows.drop("row_id", "Part_Desc").coalesce(1), f"{target}/in/unfit")
        ingest.stream_feed_files(spark, f"{target}/in/*", f"{target}/out", f"{target}/checkpoint").awaitTermination()
    counters = spark.read.option("basePath", f"{target}/out/counters").parquet(f"{target}/out/counters").select("batch", "processed")
    out = spark.read.option("basePath", f"{target}/out/rows").parquet(f"{target}/out/rows")
    return out.join(counters, "batch").select("row_id", "part_desc", "status", "processed")


__all__ = ["ORACLES", "QUERIES", "flat_results", "layer"]
