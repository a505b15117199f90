"""Units of measure, trade fractions and number tokens as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import (
    UNICODE, WS, ladder, literal_array, lookup, strip, text,
)

# A number token: 1-1/4, 3/8, .045, 1.25, 18
NUM = r"(?:(?:\d+-)?\d+\s*/\s*\d+|\d*\.\d+|\d+)"
_FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def to_double(c: Column) -> Column:
    """Plain decimal text as a double, NULL for anything else ('24d' is not a number here)."""
    t = strip(c)
    return F.when(t.rlike(_FLOAT), t.try_cast("double"))


def _int_text(d: Column) -> Column:
    return d.try_cast("decimal(38,0)").cast("string")


def _is_int(d: Column) -> Column:
    return d == F.floor(d)


def _short_decimal(d: Column) -> Column:
    """Four decimals, then without trailing zeros and point."""
    return F.rtrim(F.rtrim(F.format_string("%.4f", d), F.lit("0")), F.lit("."))


def _plain_double(d: Column) -> Column:
    """Shortest decimal text of a double (1.5, 0.045)."""
    return F.regexp_replace(d.try_cast("decimal(30,12)").cast("string"), r"\.?0+$", "")


def fraction_text(d: Column) -> Column:
    """50.25 -> 50-1/4, 0.25 -> 1/4, 24.0 -> 24; decimals that are no 64th stay decimal."""
    whole = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("double")
    part = F.round(d - whole, 6)
    step = F.round(part * 64)
    near = (F.abs(part - step / 64) < 0.0005) & (step >= 1) & (step <= 63)
    name = F.get(literal_array(rules.fraction_table(64)), step.cast("int") - 1)
    return (
        F.when(_is_int(d), _int_text(d))
        .when(near & (whole > 0), F.concat(_int_text(whole), F.lit("-"), name))
        .when(near, name)
        .otherwise(_short_decimal(d))
    )


def trade_fraction(c: Column) -> Column:
    """Decimal text to trade fraction; other text is only trimmed; NULL and '' give ''."""
    d = to_double(c)
    return F.when(d.isNotNull(), fraction_text(d)).otherwise(strip(text(c)))


def fraction_16ths(c: Column) -> Column:
    """Coarser form: 16ths within 0.001, everything else unchanged."""
    d = to_double(c)
    whole = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("double")
    part = d - whole
    step = F.round(part * 16)
    near = (F.abs(part - step / 16) < 0.001) & (step >= 1) & (step <= 15)
    name = F.get(literal_array(rules.fraction_table(16)), step.cast("int") - 1)
    return (
        F.when(near & (whole > 0), F.concat(_int_text(whole), F.lit("-"), name))
        .when(near, name)
        .otherwise(c)
    )


def standardize_uom(c: Column) -> Column:
    """Spelling of a unit to the standard unit, unknown ones only trimmed."""
    t = strip(text(c))
    return F.coalesce(lookup(F.lower(t), rules.UNITS), t)


def _rating_text(d: Column) -> Column:
    return F.when(_is_int(d), _int_text(d)).otherwise(_plain_double(d))


def format_measurement(value: Column, unit: Column) -> Column:
    """'50.25','in' -> '50-1/4 in'; '15','amps' -> '15 A'; lengths as fractions, ratings as decimals."""
    v = strip(text(value))
    d = to_double(v)
    std = standardize_uom(unit)
    as_fraction = (text(unit) == "") | std.isin(rules.TRADE_FRACTION_UNITS)
    shown = F.when(d.isNull(), v).when(as_fraction, fraction_text(d)).otherwise(_rating_text(d))
    return (
        F.when(text(value) == "", "")
        .when((text(unit) == "") | (std == ""), shown)
        .otherwise(F.concat(shown, F.lit(" "), std))
    )


def normalize_uom(c: Column) -> Column:
    """'24in' -> '24 in', '1.5GPM' -> '1.5 gpm'; without a number the text is taken as a unit."""
    t = strip(text(c))
    pattern = UNICODE + r"^([\d./-]+)\s*([A-Za-z°\"'/]+)$"
    number = F.regexp_extract(t, pattern, 1)
    unit = F.regexp_extract(t, pattern, 2)
    std = standardize_uom(unit)
    d = to_double(number)
    shown = (
        F.when(d.isNull(), number)
        .when(std.isin(rules.TRADE_FRACTION_UNITS), fraction_text(d))
        .otherwise(_rating_text(d))
    )
    return F.when(number != "", F.concat(shown, F.lit(" "), std)).otherwise(standardize_uom(t))


def std_dimensions(c: Column) -> Column:
    """'12"x20mm' -> '12 in x 20 mm'. The text is cut at every x, as the contract wants it."""
    t = strip(text(c))

    def part(s: Column) -> Column:
        return (
            F.when(s.endswith('"') | s.endswith("in"), F.concat(strip(F.rtrim(s, F.lit('"in'))), F.lit(" in")))
            .when(s.endswith("'") | s.endswith("ft"), F.concat(strip(F.rtrim(s, F.lit("'ft"))), F.lit(" ft")))
            .when(s.endswith("mm"), F.concat(strip(F.substring(s, F.lit(1), F.length(s) - 2)), F.lit(" mm")))
            .when(s.rlike(UNICODE + r"^[\d./-]+$"), F.concat(s, F.lit(" in")))
            .otherwise(s)
        )

    # the text is trimmed and the separator takes the blanks around it, so the parts are trimmed
    cut = F.split(t, UNICODE + r"\s*[xX]\s*")
    return F.when(t.contains("x") | t.contains("X"), F.array_join(F.transform(cut, part), " x ")).otherwise(t)


def fraction_to_double(c: Column) -> Column:
    """'1-1/4' -> 1.25, '5/16' -> 0.3125, '.5' -> 0.5, anything else NULL."""
    t = strip(c)
    mixed = UNICODE + r"^(\d+)-(\d+)\s*/\s*(\d+)$"
    plain = UNICODE + r"^(\d+)\s*/\s*(\d+)$"

    def num(pattern, group):
        return F.regexp_extract(t, pattern, group).try_cast("double")

    return ladder(
        [
            (t.rlike(mixed), num(mixed, 1) + F.try_divide(num(mixed, 2), num(mixed, 3))),
            (t.rlike(plain), F.try_divide(num(plain, 1), num(plain, 2))),
            (F.lit(True), to_double(t)),
        ]
    )


def peek_uom(after: Column, default) -> Column:
    """Unit written right behind a number; `after` is up to five characters of following text."""
    rest = F.lower(F.ltrim(after, F.lit(WS)))
    return ladder(
        [
            (rest.startswith("'"), "ft"),
            (rest.startswith('"'), "in"),
            (rest.startswith("ft") | rest.startswith("feet"), "ft"),
            (rest.startswith("in"), "in"),
        ],
        default,
    )


def squash(c: Column) -> Column:
    """Number token without inner blanks: '1 / 2' -> '1/2'."""
    return F.translate(c, WS, "")


__all__ = [
    "NUM", "format_measurement", "fraction_16ths", "fraction_to_double", "normalize_uom",
    "peek_uom", "squash", "standardize_uom", "std_dimensions", "to_double", "trade_fraction",
]
