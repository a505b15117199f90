"""Attribute extraction from free text.

Three layers of plain expressions:

1. `captures`   one column per pattern, read once from the text (plus context flags),
2. `sizes`, `derive`, `facts`   values that depend on captures,
3. `SLOTS`      the ordered list of attribute slots, each a nullable (label, value, uom) struct.

The slots share the captures, so asking for a single rule prunes every other pattern from the
plan. Cheap substring tests stand in front of the regexes, and whole-word tests run on a word
list built once per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.text import (
    distinct_filled, find, find_or_null, first_filled, first_token, groups, has_any, has_unit, has_word, ladder, leaf, lookup,
    matches, sql_text, strip, text, unit_list, word_list,
)
from skuforge.functions.units import NUM, fraction_to_double, peek_uom, squash
from skuforge.operators.describe import LABELS
from skuforge.operators.stages import layer

C = F.col
_AFTER = r"(?=([\s\S]{0,5}))"  # the characters right behind a number, kept for its unit
_Q = r"\s*[\"']?\s*"
SIZE3 = f"({NUM}){_AFTER}{_Q}x\\s*({NUM}){_AFTER}{_Q}x\\s*({NUM}){_AFTER}"
SIZE2 = f"({NUM}){_AFTER}{_Q}x\\s*({NUM}){_AFTER}"
BOARD = r"(\d+n?)\s*[xX]\s*(\d+)\s*[- ]\s*(\d+)" + _AFTER
REST = r"[\s\S]*"


# --------------------------------------------------------------------------------------------- context
def is_abrasive(category: str, low: str) -> Column:
    return has_any(category, ["cut-off", "grinding", "sanding", "abrasive"]) | has_any(low, rules.ABRASIVE_WORDS)


def is_fitting(category: str, low: str) -> Column:
    return has_any(category, ["pipe fitting", "fitting", "valve", "faucet", "coupling"]) | has_any(low, rules.FITTING_WORDS)


def is_fastener(category: str, low: str) -> Column:
    return has_any(category, ["fastener", "nail"]) | has_any(low, rules.FASTENER_WORDS)


# --------------------------------------------------------------------------------------------- layer 0
def with_text(
    df: DataFrame, desc: Column, mpn: Column, manufacturer: Column,
    category: str = "product_name", classpath: str = "classpath",
) -> DataFrame:
    """The text all rules read (description, part number and resolved manufacturer) in the forms
    they read it in."""
    joined = strip(F.concat(text(desc), F.lit(" "), text(mpn), F.lit(" "), text(manufacturer)))
    df = layer(df, {"_text": F.when(C(category).isNotNull(), joined), "_mpn": F.upper(text(mpn))})
    df = layer(df, {"_low": F.lower(C("_text")), "_cat": F.lower(C(category)), "k_leaf": leaf(text(C(classpath)))})
    return layer(
        df,
        {
            "_words": word_list(C("_low")), "_units": unit_list(C("_low")), "k_category": C(category),
            "_ctx": F.concat(C("_cat"), F.lit(" "), C("_low")),
        },
    )


# --------------------------------------------------------------------------------------------- layer 1
def captures() -> dict[str, Column]:
    low, words, units, cat = "_low", "_words", "_units", "_cat"
    num = f"({NUM})"
    inch = r'\s*(?:"|in\b|inch)?\s*'
    size_shape = C(low).contains("x") & C(low).rlike(r"(?U)[\dn\"'\s]x\s*[\d.]")

    def measured(pattern: str, *starts: str) -> Column:
        return find(low, pattern, when=has_unit(units, *starts))

    return {
        "c_series": text(first_token(low, [(s.lower(), s) for s in rules.SERIES])),
        "c_watt": measured(r"\b(\d+)\s*w\b", "w"),
        "c_volt": measured(r"\b(\d+)\s*(?:volts|volt|vac|v)\b", "v"),
        "c_vah": measured(r"(\d+\s*v\s*\d+(?:\.\d+)?)\s*ah", "ah"),
        "c_amp": measured(r"\b(\d+)\s*(?:amps|amp|a)\b", "a"),
        "c_ah": measured(r"\b(\d+(?:\.\d+)?)\s*ah\b", "ah"),
        "c_group": find(low, r"\b(8d|24f|27f|31|34|35|48|49|51r|65|78)\s*battery\b", needs=["battery"]),
        "c_kelvin": measured(r"\b(\d{1,2})k\b", "k"),
        "c_cct": matches(low, r"\b(?:multi cct|5cct|selectable cct)\b", needs=["cct"]),
        "c_bulb": find(words, r" (br30|a19|par38|par30|mr16|b10|g25|t8|t5|cand|med) "),
        "c_sound": measured(r"(\d+)\s*(?:dba|db)\b", "db"),
        "c_size3": F.when(size_shape, find(low, SIZE3 + REST, 0)).otherwise(""),
        "c_board": F.when(size_shape, find("_text", BOARD + REST, 0)).otherwise(""),
        "c_size2": F.when(size_shape, find(low, SIZE2 + REST, 0)).otherwise(""),
        "c_grit": find(
            low, r"\b(p\d{2,4}|\d{2,3}\s*grit|\d{2,3}g)\b",
            when=has_unit(units, "g") | C(words).rlike(r"(?U) p\d"),
        ),
        "c_pack": measured(
            r"(\d+)\s*(?:pk|pack|pc|disc/box|pro/\d+|box|port|sq)\b", "pk", "pa", "pc", "pr", "po", "disc", "box", "sq"
        ),
        "c_material": text(first_token(low, rules.MATERIALS)),
        "c_finish": F.coalesce(
            first_token(low, rules.FINISHES),
            ladder([(C("_mpn").endswith(code), name) for code, name in rules.MPN_FINISHES], ""),
        ),
        "c_drive": find(
            low, num + inch + r"(?:drive|impact|rachet|ratchet|hex)",
            when=has_unit(units, '"', "in", "drive", "impact", "ra", "hex"),
        ),
        "c_hp": measured(num + r"\s*hp\b", "hp"),
        "c_phase": measured(r"\b(1ph|1 ph|1-phase|1\s*phase|3ph|3 ph|3-phase)\b", "ph"),
        "c_laser": has_word(words, "laser") | matches(low, r"\bcross line\b", needs=["cross line"]),
        "c_mount": ladder(
            [
                (matches(low, r"\b(wall lt|wall light|wall mount)\b", needs=["wall "]), "Wall Mount"),
                (has_word(words, "vanity") | matches(low, r"\bbath light\b", needs=["bath light"]), "Vanity / Bath"),
                (matches(low, r"\bstrip light\b", needs=["strip light"]), "Surface Mount"),
                (has_word(words, "recessed") | matches(low, r"\bdown light\b", needs=["down light"]), "Recessed"),
                (has_word(words, "leg"), "Leg"),
                (has_word(words, "bltln") | matches(low, r"\bbuilt[- ]in\b", needs=["built"]), "Built-in"),
            ],
            "",
        ),
        "c_gas": has_word(words, "gas"),
        "c_electric": has_word(words, "elect", "electric"),
        "c_flow": measured(r"(\d+(?:\.\d+)?)\s*(?:gpm|g/m)\b", "g"),
        "c_press": measured(r"(\d+)\s*(?:#|lb\b|class\s*\d+)", "#", "lb", "class"),
        "c_conn": ladder(
            [
                (matches(low, r"\bfnpt\s*x\s*mnpt\b", needs=["fnpt"]), "FNPT x MNPT"),
                (has_word(words, "fnpt"), "FNPT"),
                (has_word(words, "mnpt"), "MNPT"),
                (has_word(words, "npt"), "NPT"),
            ],
            "",
        ),
        "c_cycles": measured(r"(\d+)\s*[- ]?(?:wash cycle|cycles|cycle)\b", "wash", "cycle"),
        "c_depth": F.coalesce(
            squash(find_or_null(low, num + r'\s*(?:in\.|inch|in|")\s*depth', needs=["depth"])),
            F.when(C(low).contains("50-1/4in"), "50-1/4").otherwise(""),
        ),
        "k_abrasive": is_abrasive(cat, low),
        "k_fitting": is_fitting(cat, low),
        "k_fastener": is_fastener(cat, low),
        "k_deck": has_any(cat, ["decking", "railing", "fascia"]) | has_any(low, ["trex", "azek", "timbertech"]),
        "k_glazed": has_any(cat, ["window", "door"])
        | has_any(low, ["patio dr", "gliding"])
        | matches(low, r"low[\s-]?e", needs=["low"]),
        "k_appliance": has_any(cat, rules.APPLIANCE_WORDS),
    }


# --------------------------------------------------------------------------------------------- layer 2
def sizes() -> dict[str, Column]:
    """Groups of the size chain that applies: three numbers, else a board, else two numbers, else
    one number with a hint what it measures."""
    low, units = "_low", "_units"
    num = f"({NUM})"
    s3, board, s2 = C("c_size3") != "", C("c_board") != "", C("c_size2") != ""

    def tagged(tag: str, pattern: str, when: Column) -> Column:
        return F.concat(F.lit(tag), find_or_null(low, pattern, when=when))

    single = F.coalesce(
        tagged("L", r"\b" + num + r"\s*(?:'|ft\b|feet\b)", has_unit(units, "'", "ft", "feet")),
        tagged(
            "S", num + r'\s*(?:"|in\b|inch)?\s*(?:spindle|arbor|shank|collet)',
            has_any(low, ["spindle", "arbor", "shank", "collet"]),
        ),
        tagged("D", num + r'\s*(?:"|in\b|inches\b|inch\b)', has_unit(units, '"', "in")),
        tagged("P", num + r"\s*[-]?\s*(?:" + "|".join(rules.PIPE_NOUNS) + r")\b", has_unit(units, *rules.PIPE_NOUNS)),
        tagged("R", r"(?<![\w./-])(\d+\s*-\s*\d+)(?![\w./-])", C(low).contains("-")),
        F.lit(""),
    )
    fast = C("k_fastener")
    return {
        "z3": F.when(s3, groups(C("c_size3"), SIZE3, 6)),
        "zb": F.when(~s3 & board, groups(C("c_board"), BOARD, 4)),
        "z2": F.when(~s3 & ~board & s2, groups(C("c_size2"), SIZE2, 4)),
        "z1": F.when(~s3 & ~board & ~s2, single).otherwise(""),
        "k_disc": is_abrasive("_cat", "_ctx") & ~has_any("_ctx", ["belt"]),
        "c_rpm": find(low, r"(\d{4,6})\s*rpm", when=C("k_abrasive") & has_unit(units, "rpm")),
        "c_thread": F.when(fast, _thread()).otherwise(""),
        "c_fastlen": F.when(
            fast,
            F.coalesce(
                find_or_null("_text", r"[xX]\s*" + num + r'\s*(?:"|in\b|inch)', needs=["x", "X"]),
                find_or_null(low, num + r'\s*"\s*(?:long|lg\b)', needs=["long", "lg"]),
                F.lit(""),
            ),
        ).otherwise(""),
        "c_head": F.when(fast, F.initcap(find(low, "(" + "|".join(rules.HEADS) + ")"))).otherwise(""),
        "c_drv": F.when(fast, F.initcap(find(low, "(" + "|".join(rules.DRIVES) + ")"))).otherwise(""),
        "c_coat": F.when(fast, find(low, "(" + "|".join(k for k, _ in rules.COATINGS) + ")")).otherwise(""),
    }


def _thread() -> Column:
    """1/4-20 and the like unless the text speaks of a class or grade, else #10-32 or #8."""
    low = "_low"
    diameter = find_or_null(low, f"({NUM}" + r"\s*-\s*\d{1,2})(?![\d/.])(?:\s*(?:tpi|threads?))?\b", needs=["-"])
    gauge = find_or_null(low, r"(#\d+(?:\s*-\s*\d{1,2})?)(?!\d)", needs=["#"])
    return F.coalesce(squash(F.when(~has_word("_words", "class", "grade"), diameter)), squash(gauge), F.lit(""))


# --------------------------------------------------------------------------------------------- layer 3
def derive() -> dict[str, Column]:
    low, words = "_low", "_words"
    z3, zb, z2, z1 = C("z3"), C("zb"), C("z2"), C("z1")
    tag, one = F.substring(z1, 1, 1), squash(F.substring(z1, F.lit(2), F.length(z1)))

    def at(parts: Column, i: int) -> Column:
        return squash(F.get(parts, F.lit(i)))

    def unit(parts: Column, i: int, default) -> Column:
        return peek_uom(F.get(parts, F.lit(i)), default)

    u3, u2 = unit(z3, 1, "in"), unit(z2, 1, "in")
    disc = C("k_disc") & z2.isNotNull()
    small = F.when(disc, text_le(fraction_to_double(at(z2, 2)), 1.5)).otherwise(False)
    vah = C("c_vah") != ""
    arbor_label = z3.isNotNull() | (disc & small)
    return {
        "d_volt": F.when(C("c_volt") != "", C("c_volt"))
        .when(has_word(words, "m18"), "18")
        .when(has_word(words, "m12"), "12")
        .when(vah, F.regexp_extract(C("c_vah"), r"^(\d+)", 1))
        .otherwise(""),
        "d_amp": F.when(vah, "").otherwise(C("c_amp")),
        "d_ah": F.when(vah, F.regexp_extract(C("c_vah"), r"(?U)v\s*(\d+(?:\.\d+)?)$", 1)).otherwise(C("c_ah")),
        # sizes: value and unit of each label that can come out of the chain
        "d_l3": at(z3, 0), "d_l3u": u3,
        "d_t3": at(z3, 2), "d_t3u": unit(z3, 3, u3),
        "d_a3": at(z3, 4), "d_a3u": unit(z3, 5, u3),
        "d_bt": F.replace(F.get(zb, F.lit(0)), F.lit("n"), F.lit("")),
        "d_bw": F.get(zb, F.lit(1)),
        "d_bl": F.get(zb, F.lit(2)), "d_blu": unit(zb, 3, "in"),
        "d_w2": at(z2, 0), "d_w2u": u2, "d_l2": at(z2, 2), "d_l2u": unit(z2, 3, u2),
        "d_disc": disc, "d_small": small,
        "d_tag": tag, "d_one": one,
        "d_arbor": F.when(
            C("k_abrasive") & ~arbor_label,
            squash(
                F.coalesce(
                    find_or_null(low, f"({NUM})" + r'\s*"?\s*(?:arbor|shank)', needs=["arbor", "shank"]),
                    find_or_null(low, r"(?:arbor|shank)\s*[:\-]?\s*" + f"({NUM})", needs=["arbor", "shank"]),
                )
            ),
        ),
        "d_deckcolor": F.when(
            C("k_deck") & (C("c_finish") == ""),
            text(first_token(low, [(c.lower(), c) for c in rules.DECKING_COLORS])),
        ).otherwise(""),
    }


def text_le(d: Column, bound: float) -> Column:
    return F.coalesce(d <= bound, F.lit(False))


# --------------------------------------------------------------------------------------------- layer 4
def facts() -> dict[str, Column]:
    """Attribute values that need more than one capture; '' where a rule does not apply."""
    low, words = "_low", "_words"
    tag, one = C("d_tag"), C("d_one")

    def word(*tokens: str) -> Column:
        return has_word(words, *tokens)

    def said(*parts: str) -> Column:
        return has_any(low, parts)

    def only(cond: Column, value) -> Column:
        return F.when(cond, value).otherwise("")

    return {
        "a_cct": ladder(
            [(C("c_kelvin") != "", F.concat(C("c_kelvin"), F.lit("00"))), (C("c_cct"), "Selectable CCT")], ""
        ),
        "a_group": F.upper(C("c_group")),
        "a_bulb": F.upper(C("c_bulb")),
        "a_feet": only(tag == "L", one),
        "a_spindle": only(tag == "S", one),
        "a_inch": only(tag == "D", one),
        "a_pipe": only(tag == "P", one),
        "a_range": only(tag == "R", F.replace(one, F.lit("-"), F.lit(" - "))),
        "a_grit": F.replace(F.upper(C("c_grit")), F.lit(" "), F.lit("")),
        "a_drive": squash(C("c_drive")),
        "a_anvil": ladder(
            [
                (said("friction ring"), "Friction Ring"), (said("pin detent"), "Pin Detent"),
                (said("interchangeable anvil"), "Interchangeable Anvil"),
            ],
            "",
        ),
        "a_config": ladder(
            [
                (said("(bare)", "bare tool", "tool only", "tool - only"), "Bare Tool (Tool Only)"),
                (word("kit") | said("starter kit"), "Kit with Battery & Charger"),
            ],
            "",
        ),
        "a_motor": only(word("brushless", "fuel"), "Brushless"),
        "a_hp": squash(C("c_hp")),
        "a_phase": ladder([(C("c_phase") == "", ""), (C("c_phase").contains("1"), "1-Phase")], "3-Phase"),
        "a_beam": ladder([(~C("c_laser"), ""), (word("green"), "Green"), (word("red"), "Red")], ""),
        "a_spots": ladder([(~C("c_laser"), ""), (said("3 spot"), "3-Spot"), (said("5 spot"), "5-Spot")], ""),
        "a_fuel": only(C("c_gas"), "Gas"),
        "a_power": only(C("c_electric") & ~C("c_gas"), "Electric"),
        "a_press": only(C("c_press") != "", F.concat(F.lit("Class "), C("c_press"))),
        "a_edge": ladder(
            [
                (matches(low, r"\b(sq edge|square edge|sq ed)\b", needs=["sq"]), "Square Edge"),
                (word("grooved"), "Grooved"),
                (matches(low, r"\bt&g\b", needs=["t&g"]), "Tongue & Groove"),
            ],
            "",
        ),
        "a_leaf": only((C("k_category") != "") & (F.lower(C("k_leaf")) != F.lower(C("k_category"))), C("k_leaf")),
        "a_abrasive": only(
            C("k_abrasive"),
            ladder(
                [
                    (said("cubitron"), "Ceramic Alumina"), (said("zirconia", "steel demon"), "Zirconia Alumina"),
                    (said("silicon carbide", "wet/dry", "wet dry"), "Silicon Carbide"), (said("diamond"), "Diamond"),
                ],
                "Aluminum Oxide",
            ),
        ),
        "a_backing": only(
            C("k_abrasive"),
            ladder(
                [
                    (word("film") | said("stikit film", "polyester film"), "Polyester Film"),
                    (word("belt", "cloth"), "Cloth"),
                    (word("net") | said("abranet", "abrasanet"), "Abrasive Net"),
                    (said("sponge", "block"), "Foam"),
                    (said("cut-off", "cut off", "grinding wheel", "type 1", "type 27"), "Fiber"),
                ],
                "Paper",
            ),
        ),
        "a_conn2": only(C("k_fitting") & (C("c_conn") == "FNPT x MNPT"), "MNPT"),
        "a_end": only(
            C("k_fitting"),
            ladder(
                [
                    (matches(low, r"push[\s-]?fit", needs=["push"]), "Push-Fit"),
                    (said("sweat", "solder"), "Sweat / Solder"), (said("flange"), "Flanged"),
                    (said("fpt", "fnpt", "female"), "Female Threaded"), (said("mpt", "mnpt", "male"), "Male Threaded"),
                    (said("npt", "thread"), "Threaded"), (said("solvent", "socket"), "Solvent Weld"),
                ],
                "",
            ),
        ),
        "a_fastlen": squash(C("c_fastlen")),
        "a_coat": F.coalesce(lookup(C("c_coat"), dict(rules.COATINGS)), F.lit("")),
        "a_deckmat": only(
            C("k_deck") & ((C("c_material") == "") | C("k_fitting")) & said("trex", "azek", "timbertech", "composite"),
            "Composite",
        ),
        "a_board": only(
            C("k_deck"),
            ladder(
                [
                    (said("fascia"), "Fascia Board"), (said("decking", "deck board"), "Deck Board"),
                    (said("rail kit", "railing"), "Rail Kit"),
                ],
                "",
            ),
        ),
        "a_mains": only(C("k_appliance") & ~C("c_gas") & ~C("c_electric"), "Electric"),
        "a_install": only(F.lower(C("k_category")).contains("dishwasher"), "Built-In"),
        "a_glass": only(C("k_glazed") & matches(low, r"low[\s-]?e", needs=["low"]), "Low-E"),
        "a_argon": only(C("k_glazed") & (said("argon") | word("arg")), "Argon"),
        "a_openhead": only(
            said("open head") & ~said("friction ring", "pin detent", "interchangeable anvil"), "Open Head"
        ),
    }


# --------------------------------------------------------------------------------------------- slots
class Sql(str):
    """A label or unit that depends on the row, as SQL text."""


@dataclass(frozen=True)
class Slot:
    """One attribute of the ordered output: rule id, label, column with the value, unit."""

    rule: str
    label: str
    value: str
    uom: str = ""

    def struct(self) -> str:
        label, uom = (x if isinstance(x, Sql) else sql_text(x) for x in (self.label, self.uom))
        fields = f"named_struct('label', {label}, 'value', {self.value}, 'uom', {uom})"
        return f"case when {self.value} <> '' then {fields} end"


def _either(flag: str, yes: str, no: str) -> Sql:
    return Sql(f"case when {flag} then '{yes}' else '{no}' end")


_SECOND = "case when d_disc and d_small then 'Arbor / Shank Size' when d_disc then 'Thickness' else 'Length' end"
SLOTS = [
    Slot("F1", "Series", "c_series"),
    Slot("F2", "Wattage Rating", "c_watt", "W"),
    Slot("F3", "Voltage Rating", "d_volt", "V"),
    Slot("F5", "Amperage Rating", "d_amp", "A"),
    Slot("F4", "Battery Capacity", "d_ah", "Ah"),
    Slot("F6", "Battery Group Size", "a_group"),
    Slot("F7", "Color Temperature", "a_cct", Sql("case when c_kelvin <> '' then 'K' else '' end")),
    Slot("F8", "Bulb Base / Shape", "a_bulb"),
    Slot("F9", "Sound Level", "c_sound", "dBA"),
    Slot("F10", "Diameter / Length", "d_l3", Sql("d_l3u")),
    Slot("F10", "Thickness", "d_t3", Sql("d_t3u")),
    Slot("F10", "Arbor / Shank Size", "d_a3", Sql("d_a3u")),
    Slot("F11", "Thickness", "d_bt", "in"),
    Slot("F11", "Width", "d_bw", "in"),
    Slot("F11", "Length", "d_bl", Sql("d_blu")),
    Slot("F12", _either("d_disc", "Diameter", "Width"), "d_w2", Sql("d_w2u")),
    Slot("F12", Sql(_SECOND), "d_l2", Sql("d_l2u")),
    Slot("F13", "Length", "a_feet", "ft"),
    Slot("F14", "Arbor / Spindle Size", "a_spindle", "in"),
    Slot("F15", "Diameter / Size", "a_inch", "in"),
    Slot("F16", "Diameter / Size", "a_pipe", "in"),
    Slot("F17", "Size Range", "a_range", "in"),
    Slot("F18", "Grit Grade", "a_grit"),
    Slot("F19", "Package Quantity", "c_pack"),
    Slot("F20", _either("k_fitting", "Body Material", "Material"), "c_material"),
    Slot("F21", "Color / Finish", "c_finish"),
    Slot("F22", "Drive / Chuck Size", "a_drive", "in"),
    Slot("F23", "Anvil / Retainer Type", "a_anvil"),
    Slot("F23", "Head Style", "a_openhead"),
    Slot("F24", "Tool Configuration", "a_config"),
    Slot("F25", "Motor Type", "a_motor"),
    Slot("F26", "Horsepower Rating", "a_hp", "HP"),
    Slot("F27", "Electrical Phase", "a_phase"),
    Slot("F28", "Laser Beam Color", "a_beam"),
    Slot("F28", "Beam Configuration", "a_spots"),
    Slot("F29", "Mounting Type", "c_mount"),
    Slot("F30", "Fuel Type", "a_fuel"),
    Slot("F30", "Power Source", "a_power"),
    Slot("F31", "Flow Rate", "c_flow", "gpm"),
    Slot("F32", "Pressure Class", "a_press"),
    Slot("F33", _either("k_fitting", "Connection Type 1", "Connection Type"), "c_conn"),
    Slot("F34", "Number of Wash Cycles", "c_cycles"),
    Slot("F35", "Depth With Door Open", "c_depth", "in"),
    Slot("F36", "Edge Profile", "a_edge"),
    Slot("F38", "Product Type", "k_category"),
    Slot("F38", "Application", "a_leaf"),
    Slot("F40", "Abrasive Material", "a_abrasive"),
    Slot("F40", "Backing Material", "a_backing"),
    Slot("F40", "Max RPM", "c_rpm", "RPM"),
    Slot("F40", "Arbor Size", "d_arbor", "in"),
    Slot("F42", "Connection Type 2", "a_conn2"),
    Slot("F42", "End Style", "a_end"),
    Slot("F44", "Thread Size", "c_thread"),
    Slot("F44", "Fastener Length", "a_fastlen", "in"),
    Slot("F44", "Head Type", "c_head"),
    Slot("F44", "Drive Type", "c_drv"),
    Slot("F44", "Finish / Coating", "a_coat"),
    Slot("F45", "Material", "a_deckmat"),
    Slot("F45", "Color / Finish", "d_deckcolor"),
    Slot("F45", "Board Type", "a_board"),
    Slot("F46", "Power Source", "a_mains"),
    Slot("F46", "Installation Type", "a_install"),
    Slot("F47", "Glass Type", "a_glass"),
    Slot("F47", "Gas Fill", "a_argon"),
]
RULES = list(dict.fromkeys(slot.rule for slot in SLOTS))


def slot_array(only: str | None = None) -> Column:
    """All slots in order, NULL where a rule does not apply; with `only`, those of one rule."""
    return F.expr("array(" + ", ".join(slot.struct() for slot in SLOTS if only is None or slot.rule == only) + ")")


def filled_slots(name: str = "_slots") -> Column:
    """Attribute array of a slot column. The column is read twice so that the optimizer leaves it
    in a projection of its own: there it is compiled, below a lambda it would be interpreted."""
    slots = C(name)
    return F.when(F.size(slots) > 0, F.filter(slots, lambda s: s.isNotNull()))


def detected_features() -> Column:
    low = C("_low")
    return distinct_filled(
        *[
            F.when(low.contains(word), F.lit(name))
            for word, name in [
                ("cleanboost", "With CleanBoost™"), ("3rd rack", "3rd Rack"),
                ("stikit", "Stikit™ Attachment"), ("dko", "Dual Knockout (DKO)"),
            ]
        ]
    )


def dimensions() -> Column:
    """Sizes by meaning, whatever rule found them."""
    disc_width, disc_rest = "if(d_disc, d_w2, '')", "if(d_disc and {}, d_l2, '')"
    sources = {
        "diameter": ["d_l3", disc_width, "a_inch", "a_pipe"],
        "thickness": ["d_t3", "d_bt", disc_rest.format("not d_small")],
        "arbor": ["d_a3", disc_rest.format("d_small"), "a_spindle", "d_arbor"],
        "width": ["d_bw", "if(d_disc, '', d_w2)"],
        "length": ["d_bl", "if(d_disc, '', d_l2)", "a_feet"],
        "depth_with_door_open": ["c_depth"],
    }
    fields = [
        f"'{name}', coalesce({', '.join(f'nullif({x}, {empty})' for x in xs)}, {empty})"
        for empty in ["''"] for name, xs in sources.items()
    ]
    return F.expr(f"named_struct({', '.join(fields)})")


# Single facts that descriptions and features read, by output name.
SCALARS = {
    "series": "c_series", "mount_type": "c_mount", "material": "c_material", "finish": "c_finish",
    "voltage": "d_volt", "amperage": "d_amp", "sound_level": "c_sound", "package_qty": "c_pack",
    "pressure_class": "a_press", "connection_type": "c_conn", "flow_rate": "c_flow",
}


def label_values() -> Column:
    """The array describe.label_values() would compute from the attribute array, taken from the
    columns that are there already."""
    late = {
        "Voltage Rating": "d_volt", "Amperage Rating": "d_amp", "Battery Capacity": "d_ah", "Battery Group Size": "a_group",
        "Fuel Type": "a_fuel", "Power Source": "if(a_power <> '', a_power, a_mains)", "Color Temperature": "a_cct",
        "Number of Wash Cycles": "c_cycles", "Pressure Class": "a_press", "Grit Grade": "a_grit",
        "Connection Type 1": "if(k_fitting, c_conn, '')", "Connection Type": "if(k_fitting, '', c_conn)",
        "Thread Size": "c_thread", "Horsepower Rating": "a_hp", "Motor Type": "a_motor", "Drive / Chuck Size": "a_drive",
        "Anvil / Retainer Type": "a_anvil", "Tool Configuration": "a_config", "Laser Beam Color": "a_beam",
        "Beam Configuration": "a_spots", "Package Quantity": "c_pack",
        "Material": "if(a_deckmat <> '', a_deckmat, if(k_fitting, '', c_material))",
        "Color / Finish": "if(d_deckcolor <> '', d_deckcolor, c_finish)", "Mounting Type": "c_mount", "Application": "a_leaf",
    }
    return F.expr("array(" + ", ".join(f"coalesce({late[label]}, '')" for label in LABELS) + ")")


def with_rules(df: DataFrame, desc: Column, mpn: Column, manufacturer: Column) -> DataFrame:
    """All captures and derived columns on top of a classified frame (needs product_name, classpath)."""
    df = with_text(df, desc, mpn, manufacturer)
    for columns in (captures(), sizes(), derive(), facts()):
        df = layer(df, columns)
    return df


def extract_attributes(
    df: DataFrame, desc: Column, mpn: Column, manufacturer: Column, only: str | None = None
) -> DataFrame:
    """Adds attributes, detected_features, dimensions, the single facts and label_values to a
    classified frame."""
    keep = df.columns
    df = with_rules(df, desc, mpn, manufacturer)
    df = df.select(
        *keep,
        slot_array(only).alias("_slots"),
        detected_features().alias("detected_features"),
        dimensions().alias("dimensions"),
        *[text(C(column)).alias(name) for name, column in SCALARS.items()],
        label_values().alias("label_values"),
    )
    return layer(df, {"attributes": filled_slots()}).drop("_slots")
