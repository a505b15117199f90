"""DuckDB SQL for resolution against catalog tables, over the catalog that sources.sample_catalog derives."""

from __future__ import annotations

from skuforge.oracle import sql as o
from skuforge.sources.sample_catalog import SYLLABLES


def spelled(key: str) -> str:
    table = "[" + ", ".join(f"'{s}'" for s in SYLLABLES) + "]"
    digits = f"lpad(({key})::varchar, greatest(4, length(({key})::varchar))::int, '0')"
    return f"array_to_string(list_transform(string_split({digits}, ''), lambda d: {table}[d::int + 1]), '')"


def capital(c: str) -> str:
    return f"(upper({c}[1]) || lower({c}[2:]))"


def changed(n: str, k: str) -> str:
    return f"""(case {k} % 8 when 0 then {n} when 1 then upper({n}) when 2 then array_to_string(list_reverse(string_split({n}, ' ')), ' ')
when 3 then {n}[1:2] || {n}[4:] when 4 then {n}[1:5] || 'qq' || {n}[6:] || ' Co' when 5 then {n}[1:3] || {n}[7:]
when 6 then '  ' || replace({n}, ' ', '  ') || ' (A1)' else 'The ' || translate({n}, 'aeiou', 'eioua') end)"""


MAKERS = f"""mk as (select pri, stem, {capital('stem')} || ' ' || {capital('second')} || ' ' || {capital('c_mktsegment')} as mfg, upper(stem) || '®' as brand
from (select c_custkey as pri, {spelled('c_custkey')} as stem, {spelled('c_custkey * 7919 % 10007')} as second, c_mktsegment from customer))"""

_WORDS = "list_aggregate(list_sort(string_split(regexp_replace(trim({}), '\\s+', ' ', 'g'), ' ')), 'string_agg', ' ')"


def fuzzy(names: str) -> str:
    """Like o.FUZZY, but a pair further apart by edit distance than the floor allows by insertions and deletions is left out first."""
    return f"""fz_in as ({names}),
fz_cat as (select min(pri) as pri, mfg, {_WORDS.format('mfg')} as b from cat group by mfg),
fz_pair as (select sup, pri, a, b from (select sup, {_WORDS.format('sup')} as a from fz_in where trim(sup) <> '') join fz_cat
on abs(length(a) - length(b)) <= 0.3 * (length(a) + length(b)) + 1e-6 and levenshtein(a, b) <= 0.3 * (length(a) + length(b)) + 1e-6),
fz_lcs as""" + o.FUZZY.split("fz_lcs as", 1)[1]


_CHANGED_NAMES = f"""select distinct {changed('n', 'k')} as sup from (select mfg as n, pri as k from mk
union all select {spelled('s_suppkey * 7 + 1')} || ' Trading ' || lower(s_name), s_suppkey from supplier)"""
MFG_FUZZY_JOIN = f"""with {MAKERS}, cat as (select pri, mfg from mk),
{fuzzy(_CHANGED_NAMES)}
select sup as name, fz_pri as pri, round_even(100.0 * fz_sim, 6) as score from fz where fz_sim >= 0.7 - 1e-12"""

_STAGES = dict(o.norm())
_SUPPLIERS = f"select distinct {o.supplier('s1')} as sup from n1 where {o.supplier('s1')} is not null"
CUSTOM_CATALOG = f"""with {MAKERS}, cat as (select pri, mfg, brand from mk),
kw as (select pri, unnest([stem || '-x', 'no. ' || stem]) as word from mk),
alias as (select stem || ' inc' as word, brand from mk where pri % 3 = 0),
dist as (select pri, 'depot ' || stem as dist, 'Z' || (pri % 10)::varchar as pre, mfg from mk where pri % 50 = 7),
feed as (select p_partkey + 1 as row_id, 'Z' || (p_partkey % 10)::varchar || case when p_partkey % 23 = 0 then upper(stem) || '-X' else p_partkey::varchar end as "Mfg_Part_Num",
p_name || case when p_partkey % 17 = 2 then ' No. ' || stem else '' end as "Part_Desc", case when p_partkey % 13 = 4 then stem || ' Inc' else '' end as "E1_Brand",
'' as "Unilog_Brand", '-- No DIB Brand --' as "DIB_Brand",
case when p_partkey % 50 = 9 then '' when p_partkey % 19 = 3 then 'Depot ' || stem else {changed('mfg', 'p_partkey')} end as "Part_Manuf"
from part join mk on p_partkey * 11 % 100 = pri),
{_STAGES['n1']},
{fuzzy(_SUPPLIERS)},
{_STAGES['n2']},
{_STAGES['n3']},
{_STAGES['n4']}
select row_id, mfg, brand from n4"""
