"""String expressions shared by all operators.

All of them are plain Column expressions: no Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuforge import rules

# Whitespace in the Unicode sense; Spark's own trim() removes plain spaces only.
WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
UNICODE = "(?U)"  # \w \d \s \b follow Unicode, whatever the JVM's default is


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def text(c: Column) -> Column:
    """NULL as empty text."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    return c != ""


def first_filled(*cols: Column) -> Column:
    """First column that is neither NULL nor empty, else empty text."""
    return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of whitespace to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, UNICODE + r"\s+", " "))


def no_marks(c: Column) -> Column:
    """Without registered and trademark signs."""
    return F.translate(c, "®™", "")


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def has_any(c: Column | str, words: Sequence[str]) -> Column:
    """True if one of the words occurs anywhere. Long lists over a named column are handed to
    Spark as one SQL text, which builds the plan much faster than operator calls."""
    if isinstance(c, str):
        return F.expr(has_any_sql(c, words))
    return any_of(c.contains(w) for w in words)


def has_any_sql(name: str, words: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({name}, {sql_text(w)})" for w in words) + ")"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(c: Column | str, pattern: str, needs: Sequence[str] = ()) -> Column:
    """Regular-expression test. `needs` are literals of which every match holds at least one: a
    cheap byte search then keeps most rows away from the regex engine."""
    test = _col(c).rlike(UNICODE + pattern)
    return has_any(c, needs) & test if needs else test


def find(
    c: Column | str, pattern: str, group: int = 1, needs: Sequence[str] = (), when: Column | None = None
) -> Column:
    """Text of the first match, '' if there is none."""
    hit = F.regexp_extract(_col(c), UNICODE + pattern, group)
    when = has_any(c, needs) if needs else when
    return hit if when is None else F.when(when, hit).otherwise("")


def find_or_null(
    c: Column | str, pattern: str, group: int = 1, needs: Sequence[str] = (), when: Column | None = None
) -> Column:
    """Text of the first match, NULL if there is none (so that coalesce() can try the next rule)."""
    hit = F.get(F.regexp_extract_all(_col(c), F.lit(UNICODE + pattern), F.lit(group)), F.lit(0))
    when = has_any(c, needs) if needs else when
    return hit if when is None else F.when(when, hit)


# Words that follow a number: '5-Wash Cycle 120V 3/8"' -> '|wash|v|"|'. A rule that needs a number
# with a unit is tried only on rows that have such a unit.
_AFTER_NUMBER = UNICODE + r"\d[\s-]*([a-z#\"']+)"


def unit_list(low: Column) -> Column:
    hits = F.regexp_extract_all(low, F.lit(_AFTER_NUMBER), F.lit(1))
    return F.concat(F.lit("|"), F.array_join(hits, "|"))


def has_unit(units: str, *starts: str) -> Column:
    """True if some number is followed by a word that starts so."""
    return has_any(units, [f"|{s}" for s in starts])


def groups(tail: Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that is known to match at the start of `tail`, as an array; one
    regex evaluation instead of n."""
    sep = "\x01"
    refs = sep.join(f"${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(tail, UNICODE + "^(?:" + pattern + r")[\s\S]*$", refs), sep)


def word_list(c: Column) -> Column:
    """' word word word ': whole-word tests on it are plain substring tests."""
    return F.concat(F.lit(" "), F.regexp_replace(c, UNICODE + r"\W+", " "), F.lit(" "))


def has_word(words: Column | str, *tokens: str) -> Column:
    return has_any(words, [f" {t} " for t in tokens])


def ladder(pairs: Iterable[tuple[Column, object]], default=None) -> Column:
    """First true condition decides."""
    out = None
    for cond, value in pairs:
        out = F.when(cond, lit(value)) if out is None else out.when(cond, lit(value))
    return out if default is None else out.otherwise(lit(default))


def prefix_tree(words: Sequence[str]) -> str:
    """Regex for 'the longest of these words that starts here', with shared prefixes."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        alternatives = [re.escape(ch) + render(child) for ch, child in sorted(node.items()) if ch]
        if not alternatives:
            return ""
        body = alternatives[0] if len(alternatives) == 1 and "" not in node else "(?:" + "|".join(alternatives) + ")"
        return body + "?" if "" in node else body

    return render(root)


def ranked_words(table: dict[str, int], whole_words: bool) -> tuple[str, dict[str, int]]:
    """Regex that finds words of the table at every position, and the rank of what it finds.

    It reports the longest word at a position, so a word inherits the rank of any shorter word it
    starts with (with whole words only where that one ends at a word boundary, too).
    """
    ranks = {}
    for word, rank in table.items():
        inner = [
            r for w, r in table.items()
            if word.startswith(w) and (not whole_words or w == word or re.match(r"\W", word[len(w):]))
        ]
        ranks[word] = min(inner + [rank])
    tree = prefix_tree(list(ranks))
    starts = "".join(sorted({re.escape(w[0]) for w in ranks}))
    if whole_words:
        return UNICODE + rf"\b(?=[{starts}])(?=({tree})\b)", ranks
    return f"(?=[{starts}])(?=({tree}))", ranks


def first_rank(name: str, table: dict[str, int], whole_words: bool = False) -> str:
    """SQL for the smallest rank of all words of the table that occur in a column, NULL without
    any: one pass over the text, whatever the size of the table."""
    regex, ranks = ranked_words(table, whole_words)
    entries = ", ".join(f"{sql_text(w)}, {r}" for w, r in ranks.items())
    hits = f"regexp_extract_all({name}, {sql_text(regex)}, 1)"
    return f"array_min(transform({hits}, w -> try_element_at(map({entries}), w)))"


def first_token(name: str, tokens: Sequence[tuple[str, str]]) -> Column:
    """Value of the first listed token that occurs as whole word(s), NULL if none does."""
    ranks: dict[str, int] = {}
    for i, (token, _) in enumerate(tokens):
        ranks.setdefault(token, i)
    return F.get(literal_array([v for _, v in tokens]), F.expr(first_rank(name, ranks, whole_words=True)))


def literal_array(values: Sequence) -> Column:
    """Constant array, as one SQL text (a call per element would be slow to build)."""
    return F.expr("array(" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in values) + ")")


def distinct_filled(*items: Column) -> Column:
    """Array of the items that are not NULL, each once, in order. array_except() compiles with its
    arguments, whereas array_compact() is a lambda, and everything below a lambda is interpreted."""
    return F.array_except(F.array(*items), F.expr("array(cast(null as string))"))


def lookup(key: Column, table: dict[str, object]) -> Column:
    """Value of a small literal table, NULL if the key is missing."""
    if not table:
        return F.lit(None)
    entries = ", ".join(f"{sql_text(k)}, {sql_text(v) if isinstance(v, str) else v}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


# ---------------------------------------------------------------------------------------------
def clean_placeholder(c: Column) -> Column:
    """Trimmed text, NULL where it only says that there is no value."""
    t = strip(c)
    return F.when(F.lower(t).isin(rules.PLACEHOLDERS), None).otherwise(t)


def clean_supplier(c: Column) -> Column:
    """Supplier name without its trailing account code: 'Freud Inc (2435)' -> 'Freud Inc'."""
    return drop_code(clean_placeholder(c))


def drop_code(t: Column) -> Column:
    """Second half of clean_supplier; projections that clean many rows compute the first half in a
    layer of its own, because this half reads it several times."""
    bare = F.when(
        t.endswith(")"), strip(F.regexp_replace(t, UNICODE + r"\s*\([A-Za-z0-9_\-]+\)\s*$", ""))
    ).otherwise(t)
    return F.nullif(bare, F.lit(""))


def clean_desc(c: Column) -> Column:
    """Description with plain quotes, single spaces and without a trailing catalog remark."""
    return drop_remark(plain_quotes(c))


def plain_quotes(c: Column) -> Column:
    """First half of clean_desc."""
    t = F.replace(text(clean_placeholder(c)), F.lit('""'), F.lit('"'))
    return F.translate(t, "”“’‘", "\"\"''")


def drop_remark(t: Column) -> Column:
    """Second half of clean_desc."""
    remark = UNICODE + r"(?i)\s*-\s*(" + "|".join(rules.NOISE_SUFFIXES) + r")\s*$"
    longest = max(map(len, rules.NOISE_SUFFIXES))
    end = F.lower(F.substring(t, -longest, longest))
    ends = any_of(end.endswith(s.lower()) for s in rules.NOISE_SUFFIXES)
    bare = F.when(ends, strip(F.regexp_replace(t, remark, ""))).otherwise(strip(t))
    return F.regexp_replace(bare, r"[ \t]+", " ")


def normalize_text(c: Column) -> Column:
    """Form for forgiving comparison: lower case, only letters and digits, single spaces."""
    return F.trim(F.regexp_replace(no_marks(F.lower(text(c))), r"[^a-z0-9]+", " "))


def flatten_text(c: Column) -> Column:
    """Form for 'did it really change': trimmed, lower case, single spaces."""
    return F.regexp_replace(F.lower(strip(text(c))), UNICODE + r"\s+", " ")


def is_upper(c: Column) -> Column:
    """At least one letter with case, and none in lower case."""
    return (c == F.upper(c)) & (c != F.lower(c))


def leaf(classpath: Column) -> Column:
    """Last level of a 'A > B > C' path."""
    return strip(F.substring_index(classpath, ">", -1))


def is_generic(classpath: Column) -> Column:
    return (text(classpath) == "") | text(classpath).contains(rules.GENERIC_MARK)
