"""The pipeline once more in DuckDB SQL, for checking.

Each stage is a CTE; an oracle is the stages it needs plus a final SELECT. The SQL is written from
the rules, not generated from the Spark expressions, and it searches keywords relationally (rule
tables joined by priority) where the Spark side walks a prefix tree.
"""

from __future__ import annotations

from skuforge import rules
from skuforge.sources import sample_feed as sf

WS = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NUM = r"(?:(?:\d+-)?\d+\s*/\s*\d+|\d*\.\d+|\d+)"


def q(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def case(pairs, default="''") -> str:
    return "(case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {default} end)"


def rx(text: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"regexp_extract({text}, {q(pattern)}, {group}, {q(flags)})"


def has(text: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({text}, {q(pattern)}, {q(flags)})"


def any_in(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def word(token: str) -> str:
    import re

    return r"\b" + re.escape(token).replace(r"\ ", " ").replace(r"\™", "™") + r"\b"


def placeholder(x: str) -> str:
    s = strip(x)
    return f"(case when lower({s}) in ({', '.join(q(p) for p in rules.PLACEHOLDERS)}) then null else {s} end)"


def supplier(x: str) -> str:
    return f"nullif({strip(rf'''regexp_replace({placeholder(x)}, '\s*\([A-Za-z0-9_\-]+\)\s*$', '')''')}, '')"


def clean_desc(x: str) -> str:
    quotes = f"replace(coalesce({placeholder(x)}, ''), '\"\"', '\"')"
    quotes = f"translate({quotes}, '”“’‘', '\"\"''''')"
    noise = "|".join(rules.NOISE_SUFFIXES)
    cut = strip(rf"regexp_replace({quotes}, '\s*-\s*({noise})\s*$', '', 'i')")
    return rf"regexp_replace({cut}, '[ \t]+', ' ', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def marks(x: str) -> str:
    return f"replace(replace({x}, '®', ''), '™', '')"


def values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(str(c) for c in r) + ")" for r in rows) + ")"


def leaf(x: str) -> str:
    return strip(f"list_extract(string_split({x}, '>'), -1)")


# ------------------------------------------------------------------------------------------ feed
def feed() -> str:
    k = "p_partkey"

    def choose(items, mod):
        return "(case {} % {} {} end)".format(k, mod, " ".join(f"when {i} then {v}" for i, v in enumerate(items)))

    def fill(t):
        return "(" + q(t).replace("{p}", "' || p_name || '").replace("{n}", "' || p_size::varchar || '") + ")"

    desc = choose([fill(t) for t in sf.DESCRIPTIONS], len(sf.DESCRIPTIONS))
    sup = choose([q(s) for s in sf.SUPPLIERS], len(sf.SUPPLIERS))
    number = choose([q(p) for p in sf.PREFIXES], len(sf.PREFIXES))
    brand = [choose([q(b[i]) for b in sf.BRANDS], len(sf.BRANDS)) for i in range(3)]
    return f"""feed as (select {k} + 1 as row_id, {number} || {k}::varchar as "Mfg_Part_Num", {desc} as "Part_Desc",
{brand[0]} as "E1_Brand", {brand[1]} as "Unilog_Brand", {brand[2]} as "DIB_Brand",
case when {k} % 50 = 9 then '' else {sup} end as "Part_Manuf", {k}::varchar as "PART_NUMBER",
'D' || ({k} % 5)::varchar as "Dept", 'C1' as "Class", '' as "Fine", ' ' || {k}::varchar || ' ' as "SKU - MY_PART_NUMBER"
from part)"""


# ------------------------------------------------------------------------------------------ normalise
FUZZY = f"""fz_in as (select distinct {supplier('s1')} as sup from n1 where {supplier('s1')} is not null),
fz_cat as (select min(pri) as pri, mfg, list_aggregate(list_sort(string_split(mfg, ' ')), 'string_agg', ' ') as b from cat group by mfg),
fz_pair as (select sup, pri, b, list_aggregate(list_sort(string_split(regexp_replace(trim(sup), '\\s+', ' ', 'g'), ' ')), 'string_agg', ' ') as a
from fz_in cross join fz_cat),
fz_lcs as (with recursive t(sup, pri, a, b, i, prev) as (
select sup, pri, a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0::bigint) from fz_pair
union all
select sup, pri, a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc,
case when substr(b, j::int, 1) = substr(a, i + 1, 1) then prev[j] + 1 else greatest(prev[j + 1], acc[len(acc)]) end), [0::bigint])
from t where i < length(a))
select sup, pri, 2.0 * prev[len(prev)] / (length(a) + length(b)) as sim from t where i = length(a)),
fz as (select sup, arg_min(pri, struct_pack(s := -sim, p := pri)) as fz_pri, max(sim) as fz_sim from fz_lcs group by sup)"""


def norm() -> list[tuple[str, str]]:
    cat = values([(i, q(r.manufacturer), q(r.brand)) for i, r in enumerate(rules.CATALOG)])
    kws = values([(i, q(k)) for i, r in enumerate(rules.CATALOG) for k in r.keywords])
    alias = values([(q(a), q(b)) for a, b in rules.BRAND_ALIASES.items()])
    dist = values([(i, q(d), q(p), q(m)) for i, (d, p, m) in enumerate(rules.DISTRIBUTORS)])
    miss = ", ".join(f"case when {strip(chr(34) + c + chr(34))} = '' then {q(c)} end" for c in rules.REQUIRED_VALUES)
    return [
        ("cat", f"cat(pri, mfg, brand) as {cat}"), ("kw", f"kw(pri, word) as {kws}"),
        ("alias", f"alias(word, brand) as {alias}"), ("dist", f"dist(pri, dist, pre, mfg) as {dist}"),
        ("n1", f"""n1 as (select *, {clean_desc('"Part_Desc"')} as d1, {supplier('"Part_Manuf"')} as s1,
{placeholder("coalesce(nullif(\"Unilog_Brand\", ''), nullif(\"E1_Brand\", ''), nullif(\"DIB_Brand\", ''), '')")} as b1,
{strip('"Mfg_Part_Num"')} as m1, list_filter([{miss}], lambda x: x is not null) as missing from feed)"""),
        ("fz", FUZZY),
        ("n2", f"""n2 as (select *, {supplier('s1')} as s2, lower({clean_desc('d1')}) as d2, upper(m1) as m2,
trim({marks('lower(b1)')}) as bkey from n1)"""),
        ("n3", f"""n3 as (select n2.*,
(select min(cat.pri) from alias join cat on cat.brand = alias.brand where alias.word = n2.bkey) as p1,
(select arg_min(c.pri, (dist.pri, c.pri)) from dist join cat c on c.mfg = dist.mfg where contains(lower(n2.s2), dist.dist)
 and (starts_with(n2.m2, dist.pre) or contains(n2.d2, lower(dist.pre)))) as p2,
(select min(kw.pri) from kw where contains(n2.d2, kw.word) or contains(n2.m2, upper(kw.word))) as p3,
(select min(cat.pri) from cat where lower(cat.mfg) = lower(n2.s2)) as p4,
(select min(fz_pri) from fz where fz.sup = n2.s2 and fz_sim >= 0.7 - 1e-12) as p5 from n2)"""),
        ("n4", """n4 as (select n3.*, coalesce(cat.mfg, s2, 'Unknown Manufacturer') as mfg, coalesce(cat.brand, s2, 'Unknown Brand') as brand
from n3 left join cat on cat.pri = coalesce(p1, p2, p3, p4, p5))"""),
    ]


# ------------------------------------------------------------------------------------------ classify
def classify() -> list[tuple[str, str]]:
    tax = values([(i, q(r.classpath), q(r.unspsc), q(r.product_name)) for i, r in enumerate(rules.TAXONOMY)])
    tkw = values([(i, q(k)) for i, r in enumerate(rules.TAXONOMY) for k in r.keywords])
    f = rules.FALLBACK_RULE
    return [
        ("tax", f"tax(pri, classpath, unspsc, product_name) as {tax}"), ("tkw", f"tkw(pri, word) as {tkw}"),
        ("e1", f"""e1 as (select *, {strip('"Part_Desc"')} as dsc,
case when brand <> '' and not starts_with(brand, '--') then brand else mfg end as bctx from n4 where len(missing) = 0)"""),
        ("e2", """e2 as (select e1.*, (select min(tkw.pri) from tkw where contains(lower(dsc || ' ' || m1 || ' ' || mfg), tkw.word)) as tpri from e1)"""),
        ("e3", f"""e3 as (select e2.*, coalesce(tax.classpath, {q(f.classpath)}) as classpath, coalesce(tax.unspsc, '') as unspsc,
coalesce(tax.product_name, {q(f.product_name)}) as product_name from e2 left join tax on tax.pri = e2.tpri)"""),
    ]


# ------------------------------------------------------------------------------------------ extract
def first_word(tokens, t="t") -> str:
    return case([(has(t, word(k)), q(v)) for k, v in tokens])


def squash(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', '', 'g')"


def _size(text: str, pattern: str, group: int) -> str:
    return squash(rx(text, pattern, group))


def _unit(mark: str, default: str) -> str:
    m = f"lower({mark})"
    return f"(case when {m} in ('''', 'ft', 'feet') then 'ft' when {m} in ('\"', 'in') then 'in' else {default} end)"


P3 = rf"({NUM})\s*([\"']?)\s*[xX]\s*({NUM})\s*([\"']?)\s*[xX]\s*({NUM})\s*('|\"|ft|feet|in)?"
P2 = rf"({NUM})\s*([\"']?)\s*[xX]\s*({NUM})\s*('|\"|ft|feet|in)?"
PB = r"(\d+n?)\s*[xX]\s*(\d+)\s*[- ]\s*(\d+)\s*('|\"|[fF][tT]|[fF][eE][eE][tT]|[iI][nN])?"
THREAD = rf"({NUM})\s*-\s*(\d{{1,2}})(?:\s*(?:TPI|THREADS?)\b|[^\w/.]|$)"
RANGE = r"(?:^|[^\w./-])(\d+)\s*-\s*(\d+)(?:$|[^\w./-])"


def extract() -> list[tuple[str, str]]:
    t = "t"
    aw, fw, nw = rules.ABRASIVE_WORDS, rules.FITTING_WORDS, rules.FASTENER_WORDS
    x1 = {
        "series": first_word([(s, s) for s in rules.SERIES]),
        "watt": rx(t, r"\b(\d+)\s*w\b"),
        "v0": rx(t, r"\b(\d+)\s*(?:v|volt|volts|vac)\b"),
        "vah1": rx(t, r"(\d+)\s*v\s*(\d+(?:\.\d+)?)\s*ah", 1), "vah2": rx(t, r"(\d+)\s*v\s*(\d+(?:\.\d+)?)\s*ah", 2),
        "amp0": rx(t, r"\b(\d+)\s*(?:a|amp|amps)\b"), "ah0": rx(t, r"\b(\d+(?:\.\d+)?)\s*ah\b"),
        "bgroup": f"upper({rx(t, r'\b(8D|24F|27F|31|34|35|48|49|51R|65|78)\s*Battery\b')})",
        "kel": rx(t, r"\b(\d{1,2})k\b"), "cct": has(t, r"\b(?:multi cct|5cct|selectable cct)\b"),
        "bulb": f"upper({rx(t, r'\b(BR30|A19|PAR38|PAR30|MR16|B10|G25|T8|T5|Cand|Med)\b')})",
        "sound": rx(t, r"(\d+)\s*(?:dba|db)\b"),
        "s3": rx(t, P3, 0), "sb": rx(t, PB, 0, ""), "s2d": rx(t, P2, 0),
        "grit": rf"replace(upper({rx(t, r'\b(P\d{2,4}|\d{2,3}\s*Grit|\d{2,3}G)\b')}), ' ', '')",
        "pack": rx(t, r"(\d+)\s*(?:pk|pack|pc|disc/box|pro/\d+|box|port|sq)\b"),
        "material": first_word(rules.MATERIALS),
        "fin0": first_word(rules.FINISHES),
        "fin1": case([(f"ends_with(upper(m1), {q(c)})", q(v)) for c, v in rules.MPN_FINISHES]),
        "drive": squash(rx(t, rf"({NUM})\s*(?:\"|in\b|inch)?\s*(?:drive|impact|rachet|ratchet|hex)")),
        "hp": squash(rx(t, rf"({NUM})\s*hp\b")),
        "phase": rx(t, r"\b(1ph|1 ph|1-phase|1\s*phase|3ph|3 ph|3-phase)\b"),
        "laser": has(t, r"\b(laser|cross line)\b"),
        "mount": case([
            (has(t, r"\b(wall lt|wall light|wall mount)\b"), "'Wall Mount'"), (has(t, r"\b(bath light|vanity)\b"), "'Vanity / Bath'"),
            (has(t, r"\bstrip light\b"), "'Surface Mount'"), (has(t, r"\b(down light|recessed)\b"), "'Recessed'"),
            (has(t, r"\bleg\b"), "'Leg'"), (has(t, r"\bbuilt-in\b|\bbltln\b|\bbuilt in\b"), "'Built-in'"),
        ]),
        "gas": has(t, r"\bgas\b"), "elec": has(t, r"\b(elect|electric)\b"),
        "flow": rx(t, r"(\d+(?:\.\d+)?)\s*(?:gpm|g/m)\b"), "press": rx(t, r"(\d+)\s*(?:#|lb\b|class\s*\d+)"),
        "conn": case([
            (has(t, r"\bfnpt\s*x\s*mnpt\b"), "'FNPT x MNPT'"), (has(t, r"\bfnpt\b"), "'FNPT'"), (has(t, r"\bmnpt\b"), "'MNPT'"),
            (has(t, r"\bnpt\b"), "'NPT'"),
        ]),
        "cycles": rx(t, r"(\d+)\s*[- ]?(?:wash cycle|cycles|cycle)\b"),
        "dep0": squash(rx(t, rf"({NUM})\s*(?:in|inch|\"|in\.)\s*(?:depth with door open|depth)")),
        "leaf": leaf("classpath"), "cat": "lower(product_name)",
    }
    x2 = {
        "abr": f"({any_in('cat', ['cut-off', 'grinding', 'sanding', 'abrasive'])} or {any_in('low', aw)})",
        "fit": f"({any_in('cat', ['fitting', 'valve', 'faucet', 'coupling'])} or {any_in('low', fw)})",
        "fas": f"({any_in('cat', ['fastener', 'nail'])} or {any_in('low', nw)})",
        "deck": f"({any_in('cat', ['decking', 'railing', 'fascia'])} or {any_in('low', ['trex', 'azek', 'timbertech'])})",
        "glz": f"({any_in('cat', ['window', 'door'])} or {has('t', r'patio dr|gliding|low[\s-]?e')})",
        "app": any_in("cat", rules.APPLIANCE_WORDS),
        "volt": case([("v0 <> ''", "v0"), (has(t, r"\bm18\b"), "'18'"), (has(t, r"\bm12\b"), "'12'")], "vah1"),
        "finish": "case when fin0 <> '' then fin0 else fin1 end",
        "depth": f"case when dep0 <> '' then dep0 when {has(t, '50-1/4IN')} then '50-1/4' else '' end",
        "is3": "s3 <> ''", "isb": "(s3 = '' and sb <> '')", "is2": "(s3 = '' and sb = '' and s2d <> '')",
    }
    disc = (
        f"(is2 and ({any_in('cat', ['cut-off', 'grinding', 'sanding', 'abrasive'])} or {any_in('cat || chr(32) || low', aw)})"
        f" and not contains(cat || ' ' || low, 'belt'))"
    )
    x3 = {
        "l3": f"case when is3 then {_size(t, P3, 1)} else '' end", "l3u": _unit(rx(t, P3, 2), "'in'"),
        "t3": f"case when is3 then {_size(t, P3, 3)} else '' end", "t3m": rx(t, P3, 4),
        "a3": f"case when is3 then {_size(t, P3, 5)} else '' end", "a3m": rx(t, P3, 6),
        "bt": f"case when isb then replace({rx(t, PB, 1, '')}, 'n', '') else '' end",
        "bw": f"case when isb then {rx(t, PB, 2, '')} else '' end", "bl": f"case when isb then {rx(t, PB, 3, '')} else '' end",
        "blu": _unit(rx(t, PB, 4, ""), "'in'"),
        "w2": f"case when is2 then {_size(t, P2, 1)} else '' end", "w2u": _unit(rx(t, P2, 2), "'in'"),
        "l2": f"case when is2 then {_size(t, P2, 3)} else '' end", "l2m": rx(t, P2, 4),
        "disc": disc,
        "nosize": "not (is3 or isb or is2)",
        "z_ft": squash(rx(t, rf"\b({NUM})\s*(?:'|ft\b|feet\b)")),
        "z_sp": squash(rx(t, rf"({NUM})\s*(?:\"|in\b|inch)?\s*(?:spindle|arbor|shank|collet)")),
        "z_in": squash(rx(t, rf"({NUM})\s*(?:\"|in\b|inches\b|inch\b)")),
        "z_pi": squash(rx(t, rf"({NUM})\s*[-]?\s*(?:{'|'.join(rules.PIPE_NOUNS)})\b")),
        "z_r1": rx(t, RANGE, 1), "z_r2": rx(t, RANGE, 2),
        "rpm": f"case when abr then {rx('low', r'(\d{4,6})\s*rpm')} else '' end",
        "thr": case([
            (f"not fas", "''"),
            (rf"{rx('upper(t)', THREAD, 1, '')} <> '' and not {has('upper(t)', r'\b(?:CLASS|GRADE)\b', '')}",
             f"{squash(rx('upper(t)', THREAD, 1, ''))} || '-' || {rx('upper(t)', THREAD, 2, '')}"),
            (f"{rx(t, r'#(\d+)(?:\s*-\s*(\d{1,2}))?(?:\D|$)', 1)} <> ''",
             f"'#' || {rx(t, r'#(\d+)(?:\s*-\s*(\d{1,2}))?(?:\D|$)', 1)} || case when {rx(t, r'#(\d+)(?:\s*-\s*(\d{1,2}))?(?:\D|$)', 2)} <> '' then '-' || {rx(t, r'#(\d+)(?:\s*-\s*(\d{1,2}))?(?:\D|$)', 2)} else '' end"),
        ]),
        "flen": "case when not fas then '' else coalesce(nullif({}, ''), {}) end".format(
            squash(rx(t, rf"[xX]\s*({NUM})\s*(?:\"|in\b|inch)", 1, "")), squash(rx("upper(t)", rf"({NUM})\s*\"\s*(?:LONG|LG\b)", 1, ""))
        ),
        "head": f"case when fas then {rx('low', '(' + '|'.join(rules.HEADS) + ')')} else '' end",
        "drv": f"case when fas then {rx('low', '(' + '|'.join(rules.DRIVES) + ')')} else '' end",
        "coat": f"case when fas then {rx('low', '(' + '|'.join(k for k, _ in rules.COATINGS) + ')')} else '' end",
    }
    frac = case(
        [
            (r"regexp_full_match(l2, '\d+-\d+/\d+')",
             "split_part(l2, '-', 1)::double + split_part(split_part(l2, '-', 2), '/', 1)::double / nullif(split_part(l2, '/', 2)::double, 0)"),
            ("contains(l2, '/')", "split_part(l2, '/', 1)::double / nullif(split_part(l2, '/', 2)::double, 0)"),
        ],
        "try_cast(nullif(l2, '') as double)",
    )
    x4 = {
        "t3u": _unit("t3m", "l3u"), "a3u": _unit("a3m", "l3u"), "l2u": _unit("l2m", "w2u"),
        "small": f"coalesce({frac} <= 1.5, false)",
        "o_ft": "case when nosize then z_ft else '' end",
        "o_sp": "case when nosize and z_ft = '' then z_sp else '' end",
        "o_in": "case when nosize and z_ft = '' and z_sp = '' then z_in else '' end",
        "o_pi": "case when nosize and z_ft = '' and z_sp = '' and z_in = '' then z_pi else '' end",
        "o_rg": "case when nosize and z_ft = '' and z_sp = '' and z_in = '' and z_pi = '' and z_r1 <> '' then z_r1 || ' - ' || z_r2 else '' end",
        "arb": "case when abr and not (is3 or (disc and {})) then {} else '' end".format(
            f"coalesce({frac} <= 1.5, false)",
            "coalesce(nullif({}, ''), {})".format(
                squash(rx(t, rf"({NUM})\s*\"?\s*(?:arbor|shank)")), squash(rx(t, rf"(?:arbor|shank)\s*[:\-]?\s*({NUM})"))
            ),
        ),
        "deckcol": "case when deck and finish = '' then {} else '' end".format(first_word([(c.lower(), c) for c in rules.DECKING_COLORS])),
    }
    out = [("x0", f"""x0 as (select *, {strip("dsc || ' ' || m1 || ' ' || mfg")} as t, lower({strip("dsc || ' ' || m1 || ' ' || mfg")}) as low from e3)""")]
    for name, prev, cols in (("x1", "x0", x1), ("x2", "x1", x2), ("x3", "x2", x3), ("x4", "x3", x4)):
        out.append((name, f"{name} as (select *, " + ",\n".join(f"{v} as {k}" for k, v in cols.items()) + f" from {prev})"))
    return out


def slots() -> list[tuple[str, str, str, str]]:
    """(rule, label, value, uom) as SQL; an attribute exists where value <> ''."""
    t = "t"

    def only(cond, v):
        return f"case when {cond} then {v} else '' end"

    out: list[tuple[str, str, str, str]] = []

    def add(rule, label, value, uom="''"):
        label = label if label.startswith("case ") else q(label)
        out.append((rule, label, value, uom))

    add("F1", "Series", "series")
    add("F2", "Wattage Rating", "watt", "'W'")
    add("F3", "Voltage Rating", "volt", "'V'")
    add("F5", "Amperage Rating", only("vah1 = ''", "amp0"), "'A'")
    add("F4", "Battery Capacity", "case when vah1 <> '' then vah2 else ah0 end", "'Ah'")
    add("F6", "Battery Group Size", "bgroup")
    add("F7", "Color Temperature", "case when kel <> '' then kel || '00' when cct then 'Selectable CCT' else '' end",
        "case when kel <> '' then 'K' else '' end")
    add("F8", "Bulb Base / Shape", "bulb")
    add("F9", "Sound Level", "sound", "'dBA'")
    add("F10", "Diameter / Length", "l3", "l3u")
    add("F10", "Thickness", "t3", "t3u")
    add("F10", "Arbor / Shank Size", "a3", "a3u")
    add("F11", "Thickness", "bt", "'in'")
    add("F11", "Width", "bw", "'in'")
    add("F11", "Length", "bl", "blu")
    add("F12", "case when disc then 'Diameter' else 'Width' end", "w2", "w2u")
    add("F12", "case when disc and small then 'Arbor / Shank Size' when disc then 'Thickness' else 'Length' end", "l2", "l2u")
    add("F13", "Length", "o_ft", "'ft'")
    add("F14", "Arbor / Spindle Size", "o_sp", "'in'")
    add("F15", "Diameter / Size", "o_in", "'in'")
    add("F16", "Diameter / Size", "o_pi", "'in'")
    add("F17", "Size Range", "o_rg", "'in'")
    add("F18", "Grit Grade", "grit")
    add("F19", "Package Quantity", "pack")
    add("F20", "case when fit then 'Body Material' else 'Material' end", "material")
    add("F21", "Color / Finish", "finish")
    add("F22", "Drive / Chuck Size", "drive", "'in'")
    add("F23", "Anvil / Retainer Type", case([
        (has(t, "friction ring"), "'Friction Ring'"), (has(t, "pin detent"), "'Pin Detent'"),
        (has(t, "interchangeable anvil"), "'Interchangeable Anvil'")]))
    add("F23", "Head Style", only(has(t, "open head") + " and not " + has(t, "friction ring|pin detent|interchangeable anvil"), "'Open Head'"))
    add("F24", "Tool Configuration", case([
        (has(t, r"\(bare\)|bare tool|tool only|tool - only"), "'Bare Tool (Tool Only)'"),
        (has(t, r"\bkit\b|\b2pc kit\b|starter kit"), "'Kit with Battery & Charger'")]))
    add("F25", "Motor Type", only(has(t, r"\bbrushless\b|\bfuel\b"), "'Brushless'"))
    add("F26", "Horsepower Rating", "hp", "'HP'")
    add("F27", "Electrical Phase", "case when phase = '' then '' when contains(phase, '1') then '1-Phase' else '3-Phase' end")
    add("F28", "Laser Beam Color", case([("not laser", "''"), (has(t, r"\bgreen\b"), "'Green'"), (has(t, r"\bred\b"), "'Red'")]))
    add("F28", "Beam Configuration", case([("not laser", "''"), (has(t, "3 spot"), "'3-Spot'"), (has(t, "5 spot"), "'5-Spot'")]))
    add("F29", "Mounting Type", "mount")
    add("F30", "Fuel Type", only("gas", "'Gas'"))
    add("F30", "Power Source", only("elec and not gas", "'Electric'"))
    add("F31", "Flow Rate", "flow", "'gpm'")
    add("F32", "Pressure Class", only("press <> ''", "'Class ' || press"))
    add("F33", "case when fit then 'Connection Type 1' else 'Connection Type' end", "conn")
    add("F34", "Number of Wash Cycles", "cycles")
    add("F35", "Depth With Door Open", "depth", "'in'")
    add("F36", "Edge Profile", case([
        (has(t, r"\b(sq edge|square edge|sq ed)\b"), "'Square Edge'"), (has(t, r"\bgrooved\b"), "'Grooved'"),
        (has(t, r"\bt&g\b"), "'Tongue & Groove'")]))
    add("F38", "Product Type", "product_name")
    add("F38", "Application", only("lower(leaf) <> cat", "leaf"))
    add("F40", "Abrasive Material", only("abr", case([
        (has("low", "cubitron"), "'Ceramic Alumina'"), (has("low", "zirconia|steel demon"), "'Zirconia Alumina'"),
        (has("low", "silicon carbide|wet/dry|wet dry"), "'Silicon Carbide'"), (has("low", "diamond"), "'Diamond'")], "'Aluminum Oxide'")))
    add("F40", "Backing Material", only("abr", case([
        (has("low", r"\bfilm\b|stikit film|polyester film"), "'Polyester Film'"), (has("low", r"\bbelt\b|\bcloth\b"), "'Cloth'"),
        (has("low", r"abranet|abrasanet|\bnet\b"), "'Abrasive Net'"), (has("low", "sponge|block"), "'Foam'"),
        (has("low", "cut-off|cut off|grinding wheel|type 1|type 27"), "'Fiber'")], "'Paper'")))
    add("F40", "Max RPM", "rpm", "'RPM'")
    add("F40", "Arbor Size", "arb", "'in'")
    add("F42", "Connection Type 2", only("fit and conn = 'FNPT x MNPT'", "'MNPT'"))
    add("F42", "End Style", only("fit", case([
        (has("low", r"push[\s-]?fit"), "'Push-Fit'"), (has("low", "sweat|solder"), "'Sweat / Solder'"), (has("low", "flange"), "'Flanged'"),
        (has("low", "fnpt|fpt|female"), "'Female Threaded'"), (has("low", "mnpt|mpt|male"), "'Male Threaded'"),
        (has("low", "npt|thread"), "'Threaded'"), (has("low", "solvent|socket"), "'Solvent Weld'")])))
    add("F44", "Thread Size", "thr")
    add("F44", "Fastener Length", "flen", "'in'")
    add("F44", "Head Type", case([(f"head = {q(h)}", q(h.title())) for h in rules.HEADS]))
    add("F44", "Drive Type", case([(f"drv = {q(h)}", q(h.title())) for h in rules.DRIVES]))
    add("F44", "Finish / Coating", case([(f"coat = {q(k)}", q(v)) for k, v in rules.COATINGS]))
    add("F45", "Material", only(f"deck and (material = '' or fit) and {has('low', 'trex|azek|timbertech|composite')}", "'Composite'"))
    add("F45", "Color / Finish", "deckcol")
    add("F45", "Board Type", only("deck", case([
        (has("low", "fascia"), "'Fascia Board'"), (has("low", "decking|deck board"), "'Deck Board'"), (has("low", "rail kit|railing"), "'Rail Kit'")])))
    add("F46", "Power Source", only("app and not gas and not elec", "'Electric'"))
    add("F46", "Installation Type", only("contains(cat, 'dishwasher')", "'Built-In'"))
    add("F47", "Glass Type", only(f"glz and {has('low', r'low[\s-]?e')}", "'Low-E'"))
    add("F47", "Gas Fill", only(f"glz and {has('low', r'argon|\barg\b')}", "'Argon'"))
    return out


def attributes(only: str | None = None) -> str:
    items = [
        f"struct_pack(label := {label}, value := {value}, uom := {uom})" for rule, label, value, uom in slots() if only in (None, rule)
    ]
    return "list_filter([" + ",\n".join(items) + "], lambda a: a.value <> '')"


# ------------------------------------------------------------------------------------------ describe
def filled(items, sep) -> str:
    return f"array_to_string(list_filter([{', '.join(items)}], lambda x: x <> ''), {q(sep)})"


def describe() -> list[tuple[str, str]]:
    sp = "case when a.uom <> '' then a.value || ' ' || a.uom else a.value end"
    dims = {
        "diameter": "coalesce(nullif(l3, ''), case when disc then nullif(w2, '') end, nullif(o_in, ''), nullif(o_pi, ''), '')",
        "thickness": "coalesce(nullif(t3, ''), nullif(bt, ''), case when disc and not small then nullif(l2, '') end, '')",
        "width": "coalesce(nullif(bw, ''), case when not disc then nullif(w2, '') end, '')",
        "dlen": "coalesce(nullif(bl, ''), case when not disc then nullif(l2, '') end, nullif(o_ft, ''), '')",
    }
    label = lambda name: f"coalesce(list_last(list_filter(attributes, lambda a: a.label = {q(name)})).value, '')"

    def bullet(before, value, after):
        return f"case when {value} <> '' then {q(before)} || {value} || {q(after)} else '' end"

    from skuforge.operators.describe import BULLETS

    bl = [bullet("", f"coalesce(nullif(material, ''), {label('Material')})", " construction")]
    bl.append(
        "case when diameter <> '' then diameter || ' in diameter' when width <> '' and dlen <> '' then width || ' x ' || dlen || ' in size' "
        "when thickness <> '' then thickness || ' in thickness' else '' end"
    )
    for name, before, after in BULLETS:
        value = f"coalesce(nullif({label('Connection Type 1')}, ''), {label('Connection Type')})" if name == "Connection" else label(name)
        bl.append(bullet(before, value, after))
    bl += [
        bullet("", f"coalesce(nullif(finish, ''), {label('Color / Finish')})", " finish"),
        bullet("", "mount", " mounting"), bullet("", "series", " Series"),
        bullet("Engineered for ", label("Application"), " applications"),
    ]
    det = ", ".join(
        f"case when contains(low, {q(k)}) then {q(v)} else '' end"
        for k, v in (("cleanboost", "With CleanBoost™"), ("3rd rack", "3rd Rack"), ("stikit", "Stikit™ Attachment"), ("dko", "Dual Knockout (DKO)"))
    )
    distinct = "list_reduce({}, lambda acc, x: case when x = '' or list_contains(acc, x) then acc else list_append(acc, x) end, []::varchar[])"
    abb = " ".join(f"when {q(k)} then {q(v)}" for k, v in rules.ABBREVIATIONS.items())
    abbr = f"array_to_string(list_transform(string_split({squeeze('product_name')}, ' '), lambda w: case upper(w) {abb} else w end), ' ')"
    mat = "case upper(material) " + " ".join(f"when {q(k)} then {q(v)}" for k, v in rules.ABBREVIATIONS.items()) + " else upper(substr(material, 1, 2)) end"
    codes = "|".join(rules.SUPPLIER_CODES)
    top = "list_filter(attributes, lambda a: a.label not in ('Product Type', 'Application', 'Series'))"
    d2 = {
        "i_mk": f"upper({strip(marks('bctx'))})", "i_pr": f"upper({abbr})", "i_mp": "upper(m1)",
        "i_sp": f"case when diameter <> '' then replace(diameter || 'IN', ' ', '') when thickness <> '' then replace(thickness || 'IN', ' ', '') when volt <> '' then volt || 'V' when material <> '' then {mat} else '' end",
        "mm": strip(rf"regexp_replace(mfg, ' \(({codes})\)', '', 'g')"),
        "specs": f"list_transform(list_filter(attributes, lambda a: a.label not in ('Series', 'Bulb Base / Shape')), lambda a: {sp})",
        "top": top,
    }
    d3 = {
        "inv1": filled(["i_mk", "i_pr", "i_sp", "i_mp"], " "), "inv2": filled(["i_mk", "i_pr", "i_mp"], " "), "inv3": filled(["i_mk", "i_mp"], " "),
        "mk": "case when mm <> '' and bctx <> '' and mm <> bctx then mm || ' ' || bctx when bctx <> '' then bctx else mm end",
    }
    d4 = {
        "invoice_desc": "case when length(inv1) <= 40 then inv1 when length(inv2) <= 40 then inv2 when length(inv3) <= 40 then inv3 else trim(substr(inv3, 1, 40)) end",
        "mp0": "list_filter([mk, case when product_name <> mk then product_name else '' end, series, coalesce(specs[1], ''), m1], lambda x: x <> '')",
    }
    join = lambda p: f"array_to_string({p}, ', ')"
    ins = lambda p, x: f"list_concat({p}[1:len({p}) - 1], [{x}], {p}[len({p}):])"
    d5 = {"mp1": f"case when length({join('mp0')}) < 60 and len(specs) > 1 then {ins('mp0', 'specs[2]')} else mp0 end"}
    d6 = {"mp2": f"case when length({join('mp1')}) < 60 and len(specs) > 2 then {ins('mp1', 'specs[3]')} else mp1 end"}
    d7 = {"mp3": f"case when length({join('mp2')}) < 60 and not contains({join('mp2')}, leaf) then list_concat(mp2[1:1], [leaf], mp2[2:]) else mp2 end"}
    cut = "list_concat(mp3[1:len(mp3) - 1 - k], mp3[len(mp3):])"
    d8 = {
        "mob1": f"coalesce(list_filter(list_transform(range(0, greatest(len(mp3) - 3, 0) + 1), lambda k: {join(cut)}), lambda s: length(s) <= 80)[1], "
        f"{join('list_concat(mp3[1:2], mp3[len(mp3):])')})"
    }
    d9 = {
        "mobile_desc": "case when length(mob1) > 80 then rtrim(substr(mob1, 1, 80), ', ') else mob1 end",
        "short_desc": filled(["bctx", "series", "m1", "product_name", "case when diameter <> '' then diameter || ' in' else '' end", "finish", "case when volt <> '' then volt || 'V' else '' end"], " "),
        "long_desc1": f"bctx || ' ' || product_name || ' (MPN: ' || m1 || ')' || case when len(attributes) > 0 then ' - ' || array_to_string(list_transform(attributes, lambda a: a.label || ': ' || {sp}), ', ') else '' end",
        "retail_desc": f"{strip(marks('bctx'))} || case when series <> '' then ' ' || series else '' end || ' ' || product_name || case when m1 <> '' then ' (MPN: ' || m1 || ')' else '' end || case when len(top) > 0 then ' featuring ' || array_to_string(list_transform(top[1:4], lambda a: a.label || ': ' || {sp}), ', ') else '' end || '.'",
        "marketing_description": squeeze(
            f"{strip(marks('bctx'))} || ' ' || m1 || ' ' || lower(product_name) || case when series <> '' then ' from the ' || series || ' series for ' else ' designed for ' end || lower(leaf) || ' applications.' || "
            "case when len(top) > 0 then ' Features ' || array_to_string(list_transform(top[1:3], lambda a: a.value || case when a.uom <> '' then ' ' || a.uom else '' end || ' ' || lower(a.label)), ' and ') || '.' else '' end"
        ),
    }
    out = [("att", "att as (select *, " + attributes() + " as attributes, " + ", ".join(f"{v} as {k}" for k, v in dims.items()) + " from x4)")]
    out.append(("ft", f"ft as (select *, {distinct.format('[' + det + ']')} as detected, {distinct.format('[' + ', '.join(bl) + ']')} as synthesized from att)"))
    out.append(("ff", f"ff as (select *, ({distinct.format('list_concat(detected, synthesized)')})[1:20] as features from ft)"))
    prev = "ff"
    for i, cols in enumerate((d2, d3, d4, d5, d6, d7, d8, d9), start=2):
        out.append((f"d{i}_", f"d{i}_ as (select *, " + ",\n".join(f"{v} as {k}" for k, v in cols.items()) + f" from {prev})"))
        prev = f"d{i}_"
    return out


def quality() -> list[tuple[str, str]]:
    dom = values([(i, q(k), q(rules.DOMAINS[k])) for i, k in enumerate(sorted(rules.DOMAINS, key=len, reverse=True))])
    bare = lambda x: squeeze(marks(f"split_part({x}, '(', 1)"))
    hay = f"lower({bare('mfg')} || ' ' || coalesce(nullif({bare('bctx')}, ''), {bare('mfg')}))"
    nouns = r"\b(" + "|".join(rules.PRODUCT_NOUNS) + r")\b"
    f = [
        ("length(invoice_desc) > 40", 20, "'INVOICE_DESC exceeds 40 characters (' || length(invoice_desc) || ' chars)'"),
        ("invoice_desc <> '' and not (invoice_desc = upper(invoice_desc) and invoice_desc <> lower(invoice_desc))", 10, "'INVOICE_DESC is not uppercase'"),
        ("length(mobile_desc) not between 60 and 80", 10, "'MOBILE_DESC length (' || length(mobile_desc) || ' chars) outside optimal 60-80 window'"),
        ("len(attributes) = 0", 25, "'No technical attributes could be extracted from description'"),
        ("classpath = '' or contains(classpath, 'General Hardware')", 15, "'Uncertain category / generic classpath fallback'"),
        (f"dsc <> '' and length(dsc) < 30 and not {has('lower(dsc)', nouns)}", 25,
         "'Low-context description missing explicit product noun; manual verification recommended'"),
    ]
    lost = " - ".join(["100.0::double"] + [f"(case when {c} then {p} else 0 end)" for c, p, _ in f])
    reasons = ", ".join(f"case when {c} then {r} end" for c, _, r in f)
    enc = lambda x: f"replace(replace(replace(url_encode({x}), '%20', '+'), '*', '%2A'), '%7E', '~')"
    own = """case when len(r1) = 0 and score < 80 then 'Flagged for review by the enrichment engine' end,
case when not v_char then 'INVOICE_DESC exceeds 40 characters (' || length(invoice_desc) || ' chars)' end,
case when not v_caps then 'INVOICE_DESC is not uppercase' end,
case when not v_mob then 'MOBILE_DESC length (' || length(mobile_desc) || ' chars) outside target 60-80 window' end,
case when len(attributes) = 0 then 'No technical attributes could be extracted from description' end,
case when v_gen then 'Uncertain category / generic classpath fallback' end"""
    distinct = "list_reduce({}, lambda acc, x: case when x is null or list_contains(acc, x) then acc else list_append(acc, x) end, []::varchar[])"
    return [
        ("dom", f"dom(pri, frag, domain) as {dom}"),
        ("q1", f"""q1 as (select *, greatest(0.0::double, {lost}) as score, list_filter([{reasons}], lambda x: x is not null) as r1,
(select arg_min(domain, pri) from dom where contains({hay}, dom.frag)) as domain, {enc('m1')} as key_ from d9_)"""),
        ("q2", """q2 as (select *, length(invoice_desc) between 1 and 40 as v_char,
invoice_desc = upper(invoice_desc) and invoice_desc <> lower(invoice_desc) as v_caps, length(mobile_desc) between 1 and 85 as v_85,
length(mobile_desc) between 60 and 80 as v_mob, contains(classpath, 'General Hardware') or classpath = '' as v_gen,
case when domain is null then '' else 'https://www.' || domain || '/products/' || key_ end as mfr_url,
case when domain is null then []::varchar[] else ['https://www.' || domain || '/search?q=' || key_, 'https://www.' || domain || '/documentation/' || key_] end as ref_urls
from q1)"""),
        ("q3", f"q3 as (select *, {distinct.format(f'list_concat(r1, [{own}])')} as reasons from q2)"),
        ("q4", """q4 as (select *, case when len(reasons) > 0 then 'review' else 'success' end as status,
list_filter([case when score < 80 then 'low_confidence' end, case when len(attributes) = 0 then 'no_attributes' end,
case when v_gen then 'generic_taxonomy' end, case when not (v_char and v_caps) or not v_mob then 'description_issue' end,
case when len(features) > 20 or len(attributes) > 50 then 'export_issue' end], lambda x: x is not null) as categories from q3)"""),
        ("res", """res as (select n4.row_id, n4."Mfg_Part_Num", n4."Part_Desc", n4."E1_Brand", n4."Unilog_Brand", n4."DIB_Brand", n4."Part_Manuf",
n4.d1, n4.m1 as nm1, n4.mfg as nmfg, n4.brand as nbrand, n4.missing, q4.row_id is not null as ok, coalesce(q4.status, 'review') as status,
coalesce(q4.score, 0) as confidence, coalesce(q4.reasons, ['Required field is missing or blank: ' || array_to_string(n4.missing, ', ')]) as reasons,
coalesce(q4.categories, ['missing_required_field']) as categories, q4.score, q4.r1, q4.m1, q4.dsc, q4.mfg, q4.bctx, q4.series, q4.classpath,
q4.unspsc, q4.product_name, q4.attributes, q4.features, q4.invoice_desc, q4.mobile_desc, q4.short_desc, q4.long_desc1, q4.retail_desc,
q4.marketing_description, q4.mfr_url, q4.ref_urls, coalesce(q4.v_char, false) as v_char, coalesce(q4.v_caps, false) as v_caps,
coalesce(q4.v_85, false) as v_85, coalesce(q4.v_mob, false) as v_mob, coalesce(q4.v_gen, true) as v_gen
from n4 left join q4 on q4.row_id = n4.row_id)"""),
    ]


STAGES = [("feed", feed()), *norm(), *classify(), *extract(), *describe(), *quality()]


def with_stages(upto: str, final: str) -> str:
    """SQL with all stages up to `upto` and the final SELECT."""
    out = []
    for name, body in STAGES:
        out.append(body)
        if name == upto:
            return "with " + ",\n".join(out) + "\n" + final
    raise KeyError(upto)
