"""A supplier feed derived from the `part` table.

The driver tables hold no supplier feed, so one is spelled out of part keys, names and sizes:
every part becomes one feed row, with templates that touch all extraction rules. `line_feed`
repeats that for every order line and is what the benchmark runs on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.operators.stages import spread

C = F.col

# p = part name, n = part size
DESCRIPTIONS = [
    "{p} Dishwasher SS {n}V 15A 5-Wash Cycle 47 dBA - Display Only",
    'Diablo 1/2"x{n}" Sanding Belt 80 Grit',
    "3/8 CPLG BRS {n}# FNPT x MNPT",
    '5"x.045"x7/8" Metal Cut Off Disc {n}pk',
    "Trex Biscayne 1x6-{n}' Decking Sq Edge",
    "BR30 LED {n}W 27k Lamp",
    "M18 FUEL 1/2 Impact Wrench Friction Ring (Bare)",
    "12V5AH Battery 8D Battery",
    'Hex Head Screw 1/4-20 x {n}" Zinc Plated',
    "Kichler Wall Lt {n} BK",
    'Planer 3HP 1PH {n}"',
    "Cross Line Laser Green 3 spot",
    "Faucet 1.{n} gpm Chrome Push-Fit",
    "Patio Dr Low-E Argon 80x{n}",
    "Gas Cooktop {n} in. 50-1/4IN Depth",
    "Hose {n} ft",
    "Shaper 1-1/4 Spindle",
    "fits 2-4 in {p}",
    "Range span 2 - {n} {p}",
    "Stikit Film Disc 3rd Rack DKO CleanBoost",
    "Steel {p} {n}",
    "{p}",
    "",
    "Box “{p}” ’{n}’  twin   space - Promo",
]
SUPPLIERS = [
    "Appliance Dealers Cooperative (APPDE)", "Freud Inc (2435)", "3 M Co (5293)", "Jam Industrial Supply LLC (JAMIN)",
    "Milwaukee Accessory (4031)", "Hunter Fan Company", "-- Unbranded --", "Mirka Abrasives Inc", "Acme Supply (A) (B)",
    "Stanley Black & Decker",
]
PREFIXES = ["PDSH", "WDTS", "DCB", "49-94-", "D213", "ZZ", "XSS", "QBK"]
# E1, Unilog, DIB
BRANDS = [
    ("-- Unbranded --", "-- No Unilog Brand --", "-- No DIB Brand --"),
    ("Milwaukee", "", ""),
    ("Bosch", "-- No Unilog Brand --", ""),
    ("", "", ""),
    ("", "", "Square D®"),
    ("n/a", "", ""),
]


def _choose(values: list[Column], k: Column) -> Column:
    return F.get(F.array(*values), (k % len(values)).cast("int"))


def feed_columns(k: Column, name: Column, size: Column) -> dict[str, Column]:
    n = size.cast("string")

    def fill(template: str) -> Column:
        parts: list[Column] = []
        for i, chunk in enumerate(template.replace("{p}", "\x00p\x00").replace("{n}", "\x00n\x00").split("\x00")):
            if i % 2:
                parts.append(name if chunk == "p" else n)
            elif chunk:
                parts.append(F.lit(chunk))
        return F.concat(*parts) if parts else F.lit("")

    supplier = F.when(k % 50 == 9, "").otherwise(_choose([F.lit(s) for s in SUPPLIERS], k))
    number = F.concat(_choose([F.lit(p) for p in PREFIXES], k), k.cast("string"))
    return {
        "Mfg_Part_Num": number,
        "Part_Desc": _choose([fill(t) for t in DESCRIPTIONS], k),
        **{
            column: _choose([F.lit(b[i]) for b in BRANDS], k)
            for i, column in enumerate(("E1_Brand", "Unilog_Brand", "DIB_Brand"))
        },
        "Part_Manuf": supplier,
        "PART_NUMBER": k.cast("string"),
        "Dept": F.concat(F.lit("D"), (k % 5).cast("string")),
        "Class": F.lit("C1"),
        "Fine": F.lit(""),
        "SKU - MY_PART_NUMBER": F.concat(F.lit(" "), k.cast("string"), F.lit(" ")),
    }


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed row per part."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size"))
    columns = feed_columns(C("p_partkey"), C("p_name"), C("p_size"))
    return part.select((C("p_partkey") + 1).alias("row_id"), *[v.alias(c) for c, v in columns.items()])


def line_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed row per order line: the part's row with the order line as row id."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    rows = line.join(part, C("l_partkey") == C("p_partkey"))
    columns = feed_columns(C("p_partkey"), C("p_name"), C("p_size"))
    return rows.select(
        (C("l_orderkey") * 10 + C("l_linenumber")).alias("row_id"), *[v.alias(c) for c, v in columns.items()]
    )
