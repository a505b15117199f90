"""Token-sort similarity.

Two texts are split into words, the words sorted and joined again; the score is the share of
characters that need no insertion or deletion: 2 * LCS / (len a + len b).

Both forms count common characters by a bit-parallel scan: a row of the usual table is kept in the bits of
64-bit words of WORD bits each, as many as the text needs, and a carry runs from word to word.

* `best_match` compares a column with a small fixed list of names. The built-in edit distance rejects names
  that cannot reach the floor (insert/delete distance is never smaller than edit distance, so the test is
  exact); the few survivors are scanned with masks that are literals of the plan.
* `token_sort_ratio` compares two columns; the masks are built for each row.

Everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuforge.functions.text import UNICODE, sql_text, text

#: Bits of a word of the scan; the sum of two words and a carry fits a bigint.
WORD = 60
_FULL = (1 << WORD) - 1


def token_sort(c: Column) -> Column:
    """The words of a text in order, joined by one space."""
    words = F.split(F.trim(F.regexp_replace(c, UNICODE + r"[\s\x1c-\x1f]+", " ")), " ")
    return F.array_join(F.sort_array(words), " ")


def _sorted_tokens(value: str) -> str:
    return " ".join(sorted(value.split()))


def _word_bits(size: int) -> list[int]:
    """Bits in use of each word that a text of this size takes."""
    return [min(WORD, size - at) for at in range(0, size, WORD)]


def _lcs_with_name(chars: str, name: str) -> str:
    """SQL for the length of the longest common subsequence of an array of characters with a constant name."""
    masks: dict[str, list[int]] = {}
    words = _word_bits(len(name))
    for i, ch in enumerate(name):
        masks.setdefault(ch, [0] * len(words))[i // WORD] |= 1 << i % WORD
    numbers = lambda values: "array(" + ", ".join(f"{v}L" for v in values) + ")"
    table = "map(" + ", ".join(f"{sql_text(ch)}, {numbers(m)}" for ch, m in masks.items()) + ")"
    sums, carry = [], "0L"
    for w in range(len(words)):
        total = f"(v[{w}] + (v[{w}] & m[{w}]) + {carry})"
        sums.append(f"(({total} & {_FULL}L) | (v[{w}] - (v[{w}] & m[{w}])))")
        carry = f"shiftright({total}, {WORD})"
    steps = f"transform({chars}, c -> coalesce(try_element_at({table}, c), {numbers([0] * len(words))}))"
    free = f"aggregate({steps}, {numbers((1 << b) - 1 for b in words)}, (v, m) -> array({', '.join(sums)}))"
    left = " + ".join(f"bit_count(free[{w}] & {(1 << b) - 1}L)" for w, b in enumerate(words))
    return f"transform(array({free}), free -> {len(name)} - ({left}))[0]"


def best_match(name_column: str, chars_column: str, names: Sequence[str], floor: float) -> Column:
    """The most similar name as struct(sim, rank), rank being its position times -1, so that the
    earliest wins ties; NULL if no name can reach the floor. The columns hold the token-sorted text and its characters."""
    scored = []
    for i, raw in enumerate(names):
        name = _sorted_tokens(raw)
        total = f"(length({name_column}) + {len(name)})"
        reach = f"ceil({total} * {1.0 - floor!r} + 1e-6)"
        near = (
            f"abs(length({name_column}) - {len(name)}) <= {reach} "
            f"and levenshtein({name_column}, {sql_text(name)}) <= {reach}"
        )
        lcs = _lcs_with_name(chars_column, name)
        sim = f"(1D - cast({total} - 2 * {lcs} as double) / {total}) * 100 / 100"
        scored.append(f"case when {near} then named_struct('sim', {sim}, 'rank', -{i}) end")
    return F.expr(f"array_max(array({', '.join(scored)}))")


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of characters, of any length."""

    def of(x: Column) -> Column:
        size = F.size(x["a"])
        words = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / F.lit(WORD)).cast("int") - 1, F.lit(0))), lambda w: F.slice(x["placed"], w * WORD + 1, WORD))
        return _let(F.struct(x["a"].alias("a"), x["b"].alias("b"), words.alias("words")), masked)

    def masked(x: Column) -> Column:
        def mask(c: Column) -> Column:
            return F.transform(x["words"], lambda w: F.aggregate(w, F.lit(0).cast("bigint"), lambda m, p: F.when(p["c"] == c, m.bitwiseOR(p["bit"])).otherwise(m)))

        kinds = F.array_intersect(x["a"], x["b"])  # characters of one side alone change nothing
        masks = F.map_from_arrays(kinds, F.transform(kinds, mask))
        full = F.transform(x["words"], lambda w: F.aggregate(w, F.lit(0).cast("bigint"), lambda m, p: m.bitwiseOR(p["bit"])))
        return _let(F.struct(x["a"].alias("a"), x["b"].alias("b"), masks.alias("masks"), full.alias("full")), scanned)

    def scanned(x: Column) -> Column:
        def add(state: Column, p: Column) -> Column:
            used = p["v"].bitwiseAND(p["m"])
            total = p["v"] + used + state["carry"]
            word = total.bitwiseAND(F.lit(_FULL)).bitwiseOR(p["v"] - used)
            return F.struct(F.concat(state["words"], F.array(word)).alias("words"), F.shiftright(total, WORD).alias("carry"))

        def step(v: Column, c: Column) -> Column:
            start = F.struct(F.array().cast("array<bigint>").alias("words"), F.lit(0).cast("bigint").alias("carry"))
            moved = F.aggregate(F.arrays_zip(v.alias("v"), x["masks"][c].alias("m")), start, add, lambda s: s["words"])
            return F.when(F.map_contains_key(x["masks"], c), moved).otherwise(v)

        last = F.aggregate(x["b"], x["full"], step)
        free = F.aggregate(F.zip_with(last, x["full"], lambda v, f: F.bit_count(v.bitwiseAND(f))), F.lit(0), lambda s, n: s + n)
        return F.size(x["a"]) - free

    placed = F.transform(a, lambda c, i: F.struct(c.alias("c"), F.expr("1L").alias("one"), i.alias("i")))
    placed = F.transform(placed, lambda p: F.struct(p["c"].alias("c"), F.call_function("shiftleft", p["one"], p["i"] % WORD).alias("bit")))
    return _let(F.struct(a.alias("a"), b.alias("b"), placed.alias("placed")), of)


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0..100 for two text columns; NULL counts as empty text. Equal texts are not scanned."""

    def ratio(x: Column) -> Column:
        total = F.length(x["a"]) + F.length(x["b"])
        scanned = (F.lit(1.0) - (total - 2 * lcs_length(_chars(x["a"]), _chars(x["b"]))) / total) * 100
        return F.when(x["a"] == x["b"], 100.0).otherwise(scanned)

    return _let(F.struct(token_sort(text(a)).alias("a"), token_sort(text(b)).alias("b")), ratio)


def text_similarity(a: Column, b: Column) -> Column:
    """token_sort_ratio with the scoring rule for blanks: both blank 100, one blank 0."""
    a, b = text(a), text(b)
    return F.when((a == "") & (b == ""), 100.0).when((a == "") | (b == ""), 0.0).otherwise(token_sort_ratio(a, b))
