"""Channel descriptions and feature bullets.

Builders take a `Facts` bundle of columns, so the same code serves the whole pipeline (facts are
columns that extraction has just made) and stand-alone use on any frame with such columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import distinct_filled, first_filled, ladder, leaf, lookup, no_marks, squeeze, strip, text
from skuforge.operators.stages import layer

C = F.col
DESCRIPTIONS = ["invoice_desc", "mobile_desc", "short_desc", "long_desc1", "retail_desc", "marketing_description"]


def brand_context(brand: Column, manufacturer: Column) -> Column:
    """Brand, or the manufacturer where the brand is blank or a '--' placeholder."""
    b = text(brand)
    return F.when((b != "") & ~b.startswith("--"), b).otherwise(text(manufacturer))


def joined(parts: list[Column], sep: str = " ") -> Column:
    """Join of the parts that are not blank."""
    return F.concat_ws(sep, *[F.when(p != "", p) for p in parts])


def value_unit(a: Column) -> Column:
    return F.when(text(a["uom"]) != "", F.concat(a["value"], F.lit(" "), a["uom"])).otherwise(a["value"])


def without(attributes: Column, *labels: str) -> Column:
    return F.filter(attributes, lambda a: ~a["label"].isin(*labels))


def abbreviate(c: Column) -> Column:
    """Known words shortened, case aside; other words stay."""
    words = F.split(squeeze(c), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(lookup(F.upper(w), rules.ABBREVIATIONS), w)), " ")


# --------------------------------------------------------------------------------------------- invoice
@dataclass(frozen=True)
class Facts:
    """Columns the builders read."""

    manufacturer: Column
    brand: Column
    mpn: Column
    product: Column
    classpath: Column
    attributes: Column
    dimensions: Column
    series: Column
    material: Column
    finish: Column
    voltage: Column

    @classmethod
    def of_columns(cls, **names: str) -> Facts:
        default = dict(
            manufacturer="manufacturer_name", brand="brand_name", mpn="mfg_part_num", product="product_name",
            classpath="classpath", attributes="attributes", dimensions="dimensions", series="series",
            material="material", finish="finish", voltage="voltage",
        )
        return cls(**{k: C(v) for k, v in {**default, **names}.items()})

    def maker(self) -> Column:
        return first_filled(self.brand, self.manufacturer)


def invoice_parts(f: Facts) -> dict[str, Column]:
    """The four pieces of an invoice text."""
    material = F.upper(f.material)
    d = f.dimensions
    spec = ladder(
        [
            (d["diameter"] != "", F.replace(F.concat(d["diameter"], F.lit("IN")), F.lit(" "), F.lit(""))),
            (d["thickness"] != "", F.replace(F.concat(d["thickness"], F.lit("IN")), F.lit(" "), F.lit(""))),
            (f.voltage != "", F.concat(f.voltage, F.lit("V"))),
            (f.material != "", F.coalesce(lookup(material, rules.ABBREVIATIONS), F.substring(material, 1, 2))),
        ],
        "",
    )
    return {
        "i_maker": F.upper(strip(no_marks(first_filled(f.brand, f.manufacturer, F.lit("MRO"))))),
        "i_product": F.upper(abbreviate(first_filled(f.product, F.lit("PART")))),
        "i_spec": spec,
        "i_mpn": F.upper(text(f.mpn)),
    }


def invoice_desc() -> Column:
    """Upper case, 40 characters at most: the key spec goes first, then the product name."""
    maker, product, spec, mpn = C("i_maker"), C("i_product"), C("i_spec"), C("i_mpn")
    tries = [[maker, product, spec, mpn], [maker, product, mpn], [maker, mpn]]
    lengths = []
    for parts in tries:
        total = sum((F.length(p) + (p != "").cast("int") for p in parts), F.lit(-1))
        lengths.append(total <= rules.INVOICE_MAX)
    full = F.upper(joined(tries[-1]))
    return ladder(
        [(ok, F.upper(joined(parts))) for ok, parts in zip(lengths, tries)],
        strip(F.substring(full, 1, rules.INVOICE_MAX)),
    )


# --------------------------------------------------------------------------------------------- mobile
def mobile_start(f: Facts) -> list[dict[str, Column]]:
    """Layers with the parts of a mobile text before its length is adjusted."""
    codes = r" \((" + "|".join(rules.SUPPLIER_CODES) + r")\)"
    raw, b, m = text(f.manufacturer), C("m_b"), C("m_m")
    product, series, maker = C("m_product"), text(f.series), C("m_maker")
    return [
        {
            "m_m": strip(F.when(raw.contains("("), F.regexp_replace(raw, codes, "")).otherwise(raw)),
            "m_raw": strip(text(f.brand)),
            "m_product": first_filled(f.product, F.lit("Hardware Component")),
            "m_specs": F.transform(F.slice(without(f.attributes, "Series", "Bulb Base / Shape"), 1, 3), value_unit),
        },
        {"m_b": F.when((C("m_raw") == "") | C("m_raw").startswith("--"), m).otherwise(C("m_raw"))},
        {"m_maker": ladder([((m != "") & (b != "") & (m != b), F.concat(m, F.lit(" "), b)), (b != "", b)], m)},
        {
            "m_1": F.when(maker != "", maker),
            "m_2": F.when(product != maker, product),
            "m_3": F.when((series != "") & (series != maker) & (series != product), series),
            "m_4": F.get(C("m_specs"), F.lit(0)),
            "m_5": F.when(text(f.mpn) != "", f.mpn),
        },
        {"m_parts": F.array_compact(F.array(*[C(f"m_{i}") for i in range(1, 6)]))},
    ]


def _line(parts: Column) -> Column:
    return F.array_join(parts, ", ")


def _insert_before_last(parts: Column, item: Column) -> Column:
    return F.array_insert(parts, -2, item)


def mobile_desc(df: DataFrame, f: Facts) -> DataFrame:
    """Adds mobile_desc: padded with checked specs below 60 characters, trimmed above 80."""
    low, high = rules.MOBILE_LOW, rules.MOBILE_HIGH
    for columns in mobile_start(f):
        df = layer(df, columns)
    for i in (1, 2):
        extra = F.get(C("m_specs"), F.lit(i))
        short = (F.length(_line(C("m_parts"))) < low) & extra.isNotNull()
        df = layer(df, {"m_parts": F.when(short, _insert_before_last(C("m_parts"), extra)).otherwise(C("m_parts"))})
    df = layer(df, {"m_line": _line(C("m_parts")), "m_leaf": leaf(text(f.classpath))})
    add_leaf = (F.length(C("m_line")) < low) & (text(f.classpath) != "") & ~C("m_line").contains(C("m_leaf"))
    df = layer(df, {"m_parts": F.when(add_leaf, F.array_insert(C("m_parts"), 2, C("m_leaf"))).otherwise(C("m_parts"))})
    df = layer(df, {"m_line": _line(C("m_parts")), "m_n": F.size(C("m_parts"))})

    def without_middle(k: Column) -> Column:
        n, parts = C("m_n"), C("m_parts")
        return _line(F.concat(F.slice(parts, F.lit(1), n - 1 - k), F.slice(parts, n, F.lit(1))))

    cuts = F.transform(F.sequence(F.lit(0), F.greatest(C("m_n") - 3, F.lit(0))), without_middle)
    fitting = F.get(F.filter(cuts, lambda s: F.length(s) <= high), F.lit(0))
    df = layer(
        df,
        {
            "m_line": F.when(F.length(C("m_line")) <= high, C("m_line")).otherwise(
                F.coalesce(fitting, F.element_at(cuts, -1))
            )
        },
    )
    clamp = F.rtrim(F.substring(C("m_line"), 1, high), F.lit(", "))
    return layer(df, {"mobile_desc": F.when(F.length(C("m_line")) > high, clamp).otherwise(C("m_line"))})


# --------------------------------------------------------------------------------------------- others
def short_desc(f: Facts) -> Column:
    d = f.dimensions["diameter"]
    return strip(
        joined(
            [
                strip(f.maker()), text(f.series), text(f.mpn), first_filled(f.product, F.lit("Component")),
                F.when(d != "", F.concat(d, F.lit(" in"))).otherwise(""),
                text(f.finish),
                F.when(f.voltage != "", F.concat(f.voltage, F.lit("V"))).otherwise(""),
            ]
        )
    )


def long_desc(f: Facts) -> Column:
    base = F.concat(f.maker(), F.lit(" "), text(f.product), F.lit(" (MPN: "), text(f.mpn), F.lit(")"))
    specs = F.transform(
        f.attributes, lambda a: F.concat(a["label"], F.lit(": "), value_unit(a))
    )
    return F.when(F.size(f.attributes) > 0, F.concat(base, F.lit(" - "), F.array_join(specs, ", "))).otherwise(base)


def highlights_of(f: Facts) -> Column:
    """First four attributes that say more than what the product is."""
    return F.slice(without(f.attributes, "Product Type", "Application", "Series"), 1, 4)


def retail_desc(f: Facts, highlights: Column) -> Column:
    maker = strip(no_marks(f.maker()))
    series = text(f.series)
    head = F.concat(
        maker,
        F.when(series != "", F.concat(F.lit(" "), series)).otherwise(""),
        F.lit(" "), first_filled(f.product, F.lit("Industrial Product")),
        F.when(text(f.mpn) != "", F.concat(F.lit(" (MPN: "), f.mpn, F.lit(")"))).otherwise(""),
    )
    specs = F.transform(highlights, lambda a: F.concat(a["label"], F.lit(": "), value_unit(a)))
    line = F.array_join(specs, ", ")
    return F.concat(head, F.when(line != "", F.concat(F.lit(" featuring "), line)).otherwise(""), F.lit("."))


def marketing_description(f: Facts, highlights: Column) -> Column:
    product = strip(first_filled(f.product, F.lit("component")))
    target = F.when(text(f.classpath) != "", leaf(f.classpath)).otherwise(product)
    series = text(f.series)
    one = F.concat(
        strip(no_marks(f.maker())), F.lit(" "), text(f.mpn), F.lit(" "), F.lower(product),
        F.when(series != "", F.concat(F.lit(" from the "), series, F.lit(" series for "))).otherwise(" designed for "),
        F.lower(target), F.lit(" applications."),
    )
    specs = F.transform(
        F.slice(highlights, 1, 3),
        lambda a: F.concat(
            a["value"], F.when(a["uom"] != "", F.concat(F.lit(" "), a["uom"])).otherwise(""), F.lit(" "), F.lower(a["label"])
        ),
    )
    line = F.array_join(specs, " and ")
    return squeeze(F.concat(one, F.when(line != "", F.concat(F.lit(" Features "), line, F.lit("."))).otherwise("")))


def spec_phrase(attributes: Column, *skip: str) -> Column:
    """'value uom' of the first attribute with a value whose label is not skipped."""
    hit = F.get(F.filter(attributes, lambda a: ~a["label"].isin(*skip) & (a["value"] != "")), F.lit(0))
    return text(value_unit(hit))


def describe(df: DataFrame, f: Facts | None = None) -> DataFrame:
    """Adds the six channel descriptions."""
    f = f or Facts.of_columns()
    keep = df.columns
    df = layer(df, {**invoice_parts(f), "_top": highlights_of(f)})
    df = mobile_desc(df, f)
    return df.select(
        *keep,
        invoice_desc().alias("invoice_desc"),
        C("mobile_desc"),
        short_desc(f).alias("short_desc"),
        long_desc(f).alias("long_desc1"),
        retail_desc(f, C("_top")).alias("retail_desc"),
        marketing_description(f, C("_top")).alias("marketing_description"),
    )


# --------------------------------------------------------------------------------------------- features
# Bullets that repeat one attribute, in order: label, text before, text after.
BULLETS = [
    ("Voltage Rating", "", " V electrical rating"), ("Amperage Rating", "", " A amperage rating"),
    ("Battery Capacity", "", " Ah battery capacity"), ("Battery Group Size", "Group ", " battery size"),
    ("Fuel Type", "", " fuel source"), ("Power Source", "", " powered operation"),
    ("Color Temperature", "", " color temperature"), ("Number of Wash Cycles", "", " wash cycles"),
    ("Pressure Class", "", " pressure rating"), ("Grit Grade", "", " abrasive grit"),
    ("Connection", "", " connection"), ("Thread Size", "", " thread size"),
    ("Horsepower Rating", "", " HP motor rating"), ("Motor Type", "", " motor"),
    ("Drive / Chuck Size", "", " in drive size"), ("Anvil / Retainer Type", "", " anvil"),
    ("Tool Configuration", "", ""), ("Laser Beam Color", "", " laser beam"),
    ("Beam Configuration", "", " beam configuration"), ("Package Quantity", "Pack of ", ""),
]
LABELS = [b[0] for b in BULLETS if b[0] != "Connection"] + [
    "Connection Type 1", "Connection Type", "Material", "Color / Finish", "Mounting Type", "Application",
]


def label_values(attributes: Column) -> Column:
    """Values of the labels the bullets use, in the order of LABELS, from any attribute array (the
    last attribute of a label counts). The pipeline has them as columns already and skips this."""
    return F.aggregate(
        attributes,
        F.array_repeat(F.lit(""), len(LABELS)),
        lambda acc, a: F.transform(
            acc, lambda v, i: F.when(F.lower(a["label"]) == F.get(_label_array(), i), a["value"]).otherwise(v)
        ),
    )


def _label_array() -> Column:
    return F.array(*[F.lit(x.lower()) for x in LABELS])


def value_of(values: Column, label: str) -> Column:
    return F.get(values, F.lit(LABELS.index(label)))


def synthesize_features(values: Column, f: Facts, mount: Column) -> Column:
    """Distinct bullets in fixed order, built from known facts only."""

    def bullet(before: str, value: Column, after: str) -> Column:
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after)))

    d = f.dimensions
    size = ladder(
        [
            (d["diameter"] != "", F.concat(d["diameter"], F.lit(" in diameter"))),
            ((d["width"] != "") & (d["length"] != ""), F.concat(d["width"], F.lit(" x "), d["length"], F.lit(" in size"))),
            (d["thickness"] != "", F.concat(d["thickness"], F.lit(" in thickness"))),
        ]
    )
    out = [bullet("", first_filled(f.material, value_of(values, "Material")), " construction"), size]
    for label, before, after in BULLETS:
        if label == "Connection":
            value = first_filled(value_of(values, "Connection Type 1"), value_of(values, "Connection Type"))
        else:
            value = value_of(values, label)
        out.append(bullet(before, value, after))
    out += [
        bullet("", first_filled(f.finish, value_of(values, "Color / Finish")), " finish"),
        bullet("", first_filled(mount, value_of(values, "Mounting Type")), " mounting"),
        bullet("", text(f.series), " Series"),
        bullet("Engineered for ", value_of(values, "Application"), " applications"),
    ]
    return distinct_filled(*out)


def merge_features(detected: Column, synthesized: Column) -> Column:
    """Detected features first, then new bullets, 20 at most."""
    return F.slice(F.array_distinct(F.concat(detected, synthesized)), 1, rules.MAX_FEATURES)


def features(df: DataFrame, f: Facts | None = None, values: Column | None = None) -> DataFrame:
    """Adds `synthesized` and `features` to a frame with attributes and facts."""
    f = f or Facts.of_columns()
    keep = df.columns
    df = layer(df, {"_values": label_values(f.attributes) if values is None else values})
    df = layer(df, {"synthesized": synthesize_features(C("_values"), f, C("mount_type"))})
    return df.select(*keep, "synthesized", merge_features(C("detected_features"), C("synthesized")).alias("features"))

