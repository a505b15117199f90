"""Resolution against a catalog of any size that is kept in tables.

`operators.resolve` turns a short fixed catalog into expressions of the plan. Here catalog, aliases and
distributors are data:

* Part texts go through one multi-pattern automaton (Aho-Corasick) that reports the best-ranked keyword, if the keywords fit one of
  bounded size. A larger keyword table is joined: the pieces of a text that have the size and a hash bit of some keyword are
  its candidates, found in one pass whatever the number of keywords, and the join keeps those that are keywords.
* Everything that depends on the supplier name alone is worked out once for each distinct name: distributor
  rules, exact match, and the most similar manufacturer among those that are still open.
* The most similar manufacturer is an exact search. Names of the same words are found by a join. The others go down a prefix tree of
  the catalog, thousands at once, and leave a node when the characters in common so far and those that can follow (by bitmaps) are too few
  for the similarity sought: a high one first, then lower ones down to the floor for names that have none yet. Catalog names come in
  blocks of bounded size; a later block starts with the best of the earlier ones, and names are dealt over tasks by the pairs that they make.

The verdicts are joined back by name; Spark decides by size whether that needs a shuffle, and splits a hot name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions.similarity import token_sort
from skuforge.functions.text import clean_placeholder, drop_code, drop_remark, no_marks, plain_quotes, strip, text
from skuforge.plans.results import written

C = F.col
UNKNOWN = ("Unknown Manufacturer", "Unknown Brand")
#: Characters of the keywords of one automaton.
AUTOMATON_CHARS = 1 << 20
#: Bits, as a power of two, of the largest bitmap of keyword hashes; beyond a sixteenth as many keywords more candidates are joined, none is missed.
SLOT_BITS = 28
#: Characters of texts that are hashed at once.
SCAN_CHARS = 1 << 19
#: Catalog names that a similarity pass broadcasts.
NAMES_BLOCK = 1 << 18
#: Names of a node of the prefix tree that are bounded one by one.
NAMES_A_NODE = 16
#: 64-bit words of the bitmap of a name's characters: characters that share a bit can only raise the bound.
MARK_WORDS = 2
#: Occurrences of one character in a name that are told apart.
MOST_NTH = 63
#: Pairs of names that a task bounds, and that one scan compares.
PAIRS_A_TASK = 1 << 29
PAIRS_A_SCAN = 1 << 15
#: Cells of a table of nodes and names, names of one search, and cells of the tables that it keeps for them.
CELLS_A_SCAN = 1 << 16
NAMES_A_SEARCH = 256
TABLE_CELLS = 1 << 22
#: Similarities that are tried before the floor; below DENSE_BELOW nearly all nodes have to be seen.
SIMILAR_STEPS = (0.95, 0.925, 0.9, 0.85)
DENSE_BELOW = 0.8


@dataclass(frozen=True)
class CatalogTables:
    """catalog: pri, manufacturer, brand, keywords (array); the smallest pri wins. aliases: alias (lower case), brand.
    distributors: pri, distributor (lower case), prefix, manufacturer."""

    catalog: DataFrame
    aliases: DataFrame
    distributors: DataFrame


def catalog_tables(spark: SparkSession, catalog: Sequence[rules.CatalogRow] = rules.CATALOG, aliases: Mapping[str, str] = rules.BRAND_ALIASES,
                   distributors: Sequence[tuple[str, str, str]] = rules.DISTRIBUTORS) -> CatalogTables:
    """The rule tables of this package, or others of their form, as frames."""
    return CatalogTables(
        spark.createDataFrame([(i, r.manufacturer, r.brand, list(r.keywords)) for i, r in enumerate(catalog)], "pri long, manufacturer string, brand string, keywords array<string>"),
        spark.createDataFrame(list(aliases.items()), "alias string, brand string"),
        spark.createDataFrame([(i, *d) for i, d in enumerate(distributors)], "pri long, distributor string, prefix string, manufacturer string"),
    )


# ---------------------------------------------------------------------------------------- keywords
@lru_cache(maxsize=4)
def _automaton(words: tuple[tuple[str, int], ...]):
    """Finds all words in one pass over a text; reports the pri of each."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, pri in words:
        out.add_word(word, pri)
    out.make_automaton()
    return out


def _matched(rows: DataFrame, column: str, keywords: DataFrame, start: Column, kind: str, hits, merge, add, block_chars: int) -> DataFrame:
    """rows with start grown by what the keywords (word, pri) hit in the column."""
    spark = rows.sparkSession
    words = written(keywords.where("word <> ''").groupBy("word").agg(F.min("pri").alias("pri")), "keywords")
    size = words.agg(F.sum(F.length("word"))).first()[0] or 0
    rows = rows.withColumn(_HITS, start)
    if not size:
        return rows
    if size <= block_chars:
        pairs = spark.sparkContext.broadcast(tuple((r["word"], r["pri"]) for r in words.sort("word").toLocalIterator()))
        return rows.withColumn(_HITS, add(F.col(_HITS), _finder(pairs, kind, hits)(column)))
    rows = written(rows.withColumn(_ROW, F.monotonically_increasing_id()), "keyword-rows")
    found = _candidates(rows.select(_ROW, column), words).join(words, "word").groupBy(_ROW).agg(merge("pri").alias(_NEW))
    return rows.join(found, _ROW, "left").withColumn(_HITS, add(F.col(_HITS), F.col(_NEW))).drop(_ROW, _NEW)


def _prints(codes: np.ndarray) -> Callable[[np.ndarray, int | np.ndarray], np.ndarray]:
    """Hashes of the pieces of a text (character numbers) by their places and sizes: polynomials modulo 2^64, then mixed."""
    powers = np.full(len(codes) + 1, _BASE, np.uint64)
    powers[0] = 1
    back = np.full(len(codes) + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])

    def of(at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        h = (sums[at + size] - sums[at]) * back[at] + np.asarray(size).astype(np.uint64) * _MIX
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * _MIX
        return h

    return of


def _word_slots(words: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of 2^bits bits, in 64-bit words, with the bit of every word's hash; merged by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            slot = _prints(_codes("".join(texts)))(np.cumsum(sizes) - sizes, sizes) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], ["at", "mark"])

    marks = words.select("word").mapInArrow(run, "at bigint, mark bigint").groupBy("at").agg(F.bit_or("mark").alias("mark")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[marks.column("at").to_numpy()] = marks.column("mark").to_numpy().view(np.uint64)
    return out


def _candidates(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(number, word) for rows (number, text): each distinct piece of a text that has the size and the bit of a word.

    Pieces of all sizes that words have are hashed thousands of texts at once. A piece whose bit another word set is
    left to the join with the words.
    """
    spark = texts.sparkSession
    sizes = words.groupBy(F.length("word").alias("size")).count().sort("size").collect()
    bits = min(SLOT_BITS, max(10, (16 * sum(r["count"] for r in sizes) - 1).bit_length()))
    held = spark.sparkContext.broadcast((_word_slots(words, bits), [r["size"] for r in sizes]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, lengths = held.value
        for batch in batches:
            numbers, column = (c.to_pylist() for c in batch.columns)
            for some in _bounded(column):
                own, found = [column[i] for i in some], set()
                ends = np.cumsum([len(t) for t in own])
                owner = np.repeat(np.arange(len(own)), [len(t) for t in own])
                room = ends[owner] - np.arange(len(owner))
                prints = _prints(_codes("".join(own)))
                for size in lengths:
                    at = np.flatnonzero(room >= size)
                    slot = prints(at, size) >> np.uint64(64 - bits)
                    at = at[(slots[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
                    for who, left in zip(owner[at].tolist(), room[at].tolist()):
                        place = len(own[who]) - left
                        found.add((some[who], own[who][place:place + size]))
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.string())], [_ROW, "word"])

    return texts.mapInArrow(run, f"`{_ROW}` bigint, word string")


def _bounded(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of the texts that are not empty, in runs of about SCAN_CHARS characters."""
    run, chars = [], 0
    for i, t in enumerate(texts):
        if t:
            run.append(i)
            chars += len(t)
            if chars >= SCAN_CHARS:
                yield run
                run, chars = [], 0
    if run:
        yield run


_ROW, _NEW = "row of this keyword pass", "new hits of this keyword pass"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HITS = "keyword hits of this pass"


def _finder(pairs, kind: str, hits):
    def find(texts: pd.Series) -> pd.Series:
        automaton = _automaton(pairs.value)
        return pd.Series([hits(automaton.iter(t)) if t and pairs.value else None for t in texts], dtype="object")

    return F.pandas_udf(find, kind)


def _least(found) -> int | None:
    return min((pri for _, pri in found), default=None)


def _every(found) -> list[int]:
    return sorted({pri for _, pri in found})


def first_keyword(rows: DataFrame, column: str, keywords: DataFrame, out: str, block_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """rows with `out`, the smallest pri of all keywords (word, pri) that occur anywhere in the column; NULL without any.

    Empty and NULL words never match. Keywords of up to block_chars characters are one automaton, more are joined.
    """
    null = F.lit(None).cast("bigint")
    return _matched(rows, column, keywords, null, "bigint", _least, F.min, F.least, block_chars).withColumnRenamed(_HITS, out)


def every_keyword(rows: DataFrame, column: str, keywords: DataFrame, out: str, block_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The same with an array of the pri of all keywords that occur, ascending; empty without any."""
    none = F.array().cast("array<bigint>")
    add = lambda have, new: F.sort_array(F.array_union(have, F.coalesce(new, none)))
    return _matched(rows, column, keywords, none, "array<bigint>", _every, lambda pri: F.sort_array(F.collect_set(pri)), add, block_chars).withColumnRenamed(_HITS, out)


# ------------------------------------------------------------------------------------------- names
def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


class NameIndex:
    """Catalog names in order of their texts: a prefix tree down to where few names share a node, and bitmaps of the characters behind it.

    A search goes down the tree with one row of the table of common characters for each asked name and node, in the bits of
    64-bit words, thousands of rows at once. A node is left when neither the characters that the row has in common so far nor those
    that can follow reach what the asked name needs; names below the last level are bounded one by one and then compared.
    """

    def __init__(self, names: Sequence[tuple[str, int]], floor: float) -> None:
        names = sorted(names)
        self.floor, self.pri = floor, np.array([p for _, p in names], np.int64)
        self.sizes = np.array([len(n) for n, _ in names], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes = _codes("".join(n for n, _ in names))
        self.alphabet, chars = np.unique(codes, return_inverse=True)
        self.chars = chars.astype(np.min_scalar_type(len(self.alphabet)))
        self.longest = int(self.sizes.max(initial=0))
        if names:
            self._plant()
            self._mark()

    def _plant(self) -> None:
        """Levels of nodes. A node has a character, its children from first[node] to first[node + 1], the bounds of the sizes of its names and, if a
        name ends there, that name. A node of few names has no children but the names from first_name[node] on."""
        live, parent, base = np.arange(len(self.sizes)), np.zeros(len(self.sizes), np.int64), 1
        self.depth_of, self.levels, columns = np.zeros(len(self.sizes), np.int64), [], []
        new, chars = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            depth, sizes = len(self.levels), self.sizes[live]
            names = np.diff(np.append(new, len(live)))
            leaf, ends = names <= NAMES_A_NODE, sizes[new] == depth
            self.levels.append((live, new))
            node = np.repeat(np.arange(len(new)), names)
            self.depth_of[live[leaf[node]]] = depth
            on = ~leaf[node]
            on[new[ends]] = False
            self.depth_of[live[new[ends & ~leaf]]] = depth
            ending = np.where(ends & ~leaf, live[new], -1)
            column = [chars, np.minimum.reduceat(sizes, new), np.maximum.reduceat(sizes, new), ending, live[new], np.where(leaf, names, 0)]
            live, node = live[on], node[on]
            char = self.chars[self.starts[live] + depth].astype(np.int64)
            start = np.ones(len(live), bool)
            start[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
            base += len(chars) if depth else 0
            new = np.flatnonzero(start)
            children = np.bincount(node[new], minlength=len(chars))
            columns.append([*column, base + np.cumsum(children) - children])
            if not len(live):
                break
            chars = char[new]
        self.char, self.least, self.most, self.ending, self.first_name, self.names, first = (np.concatenate(c).astype(np.int32) for c in zip(*columns))
        self.first = np.append(first, np.int32(len(first)))

    def _mark(self) -> None:
        """A bit for each character and number of its occurrence, counted from the end; the rarest share bits. `rest` has the bits of a name behind its
        last node, `within` those of the names of a node behind the node."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        kind = owner * len(self.alphabet) + self.chars
        order = np.argsort(kind, kind="stable")[::-1]
        nth = np.empty(len(owner), np.int64)
        nth[order] = np.minimum(_nth(kind[order]), MOST_NTH)
        width = int(nth.max(initial=0)) + 1
        kind = self.chars.astype(np.int64) * width + nth
        often = np.bincount(kind, minlength=len(self.alphabet) * width)
        some = np.flatnonzero(often)
        self.kinds = np.full(len(often), -1, np.int64)
        self.kinds[some] = np.arange(len(some))
        self.kind, self.kinds = self.kinds[kind].astype(np.min_scalar_type(len(some))), self.kinds.reshape(-1, width)
        self.bits = np.empty(len(some), np.int64)
        self.bits[np.argsort(-often[some], kind="stable")] = np.arange(len(some)) % (64 * MARK_WORDS)
        bit = np.append(self.bits[self.kind], 0)
        at, end = self.starts + self.depth_of, self.starts + self.sizes
        some = at < end
        self.rest, self.within = [], []
        for w in range(MARK_WORDS):
            marks = np.where(bit >> 6 == w, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0))
            marks[-1] = 0
            rest = np.zeros(len(self.sizes), np.uint64)
            if some.any():
                rest[some] = np.bitwise_or.reduceat(marks, np.stack([at[some], end[some]], 1).ravel())[::2]
            held, within = rest.copy(), []
            for depth, (live, new) in reversed([*enumerate(self.levels)]):
                deeper = live[self.depth_of[live] > depth]
                held[deeper] |= marks[self.starts[deeper] + depth]
                within.append(np.bitwise_or.reduceat(held[live], new))
            self.rest.append(rest)
            self.within.append(np.concatenate(within[::-1]))
        self.loose = (self.sizes - self.depth_of - sum(np.bitwise_count(r).astype(np.int64) for r in self.rest)).astype(np.int32)
        del self.levels

    def best(self, name: str, found: tuple[float, int] | None = None) -> tuple[float, int] | None:
        """(similarity, pri) of the most similar name, the smallest pri among equals; None below the floor. `found` is the
        best of other names."""
        return self.best_of([name], [found])[0]

    def best_of(self, names: Sequence[str], found: Sequence[tuple[float, int] | None], steps: Sequence[float] | None = None) -> list[tuple[float, int] | None]:
        """The same for many names. Those as similar as the first of the steps are searched first, then as the next one says for names without any."""
        found, open_ = list(found), [i for i, name in enumerate(names) if name and len(self.pri)]
        for step in steps or [*SIMILAR_STEPS, self.floor]:
            step = max(step, self.floor)
            words: dict[int, list[int]] = {}
            for i in sorted(open_, key=names.__getitem__):
                words.setdefault(-(-len(names[i]) // 64), []).append(i)
            for size, some in words.items():
                few = max(1, min(NAMES_A_SEARCH, TABLE_CELLS // (size * len(self.alphabet) + self.longest)))
                for at in range(0, len(some), few):
                    part = some[at:at + few]
                    for i, best in zip(part, _Search(self, [names[i] for i in part], [found[i] for i in part], step).run()):
                        found[i] = best
            open_ = [i for i in open_ if not found[i] or found[i][0] < step]
        return found


class _Search:
    """One way down the tree of an index for names of the same number of 64-bit words."""

    def __init__(self, index: NameIndex, names: list[str], found: list[tuple[float, int] | None], least: float) -> None:
        self.x, self.count, self.words, self.least = index, len(names), -(-len(names[0]) // 64), least
        self.sizes = np.array([len(n) for n in names])
        self.sim = np.array([f[0] if f else 0.0 for f in found])
        self.pri = np.array([f[1] if f else 0 for f in found], np.int64)
        # the places that each character of the catalog has in each name
        owner, codes = np.repeat(np.arange(self.count), self.sizes), _codes("".join(names))
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        char = np.minimum(np.searchsorted(index.alphabet, codes), len(index.alphabet) - 1)
        known = index.alphabet[char] == codes
        owner, char, place = owner[known], char[known], place[known]
        self.masks = np.zeros((self.words, len(index.alphabet), self.count), np.uint64)
        np.bitwise_or.at(self.masks, (place >> 6, char, owner), np.uint64(1) << (place & 63).astype(np.uint64))
        order = np.lexsort((char, owner))
        nth = np.minimum(_nth((owner * len(index.alphabet) + char)[order]), MOST_NTH)
        kind = np.where(nth < index.kinds.shape[1], index.kinds[char[order], np.minimum(nth, index.kinds.shape[1] - 1)], -1)
        owner, kind = owner[order][kind >= 0], kind[kind >= 0]
        bit = index.bits[kind]
        self.has = np.zeros((len(index.bits), self.count), np.uint8)
        self.has[kind, owner] = 1
        self.marks = np.zeros((MARK_WORDS, self.count), np.uint64)
        np.bitwise_or.at(self.marks, (bit >> 6, owner), np.uint64(1) << (bit & 63).astype(np.uint64))
        # sizes of both names and their sum fit
        self.small = np.uint8 if index.longest + self.sizes.max() < 250 else np.int32
        self.never = np.iinfo(self.small).max
        self.loose = (np.bincount(owner, minlength=self.count) - np.bitwise_count(self.marks).sum(axis=0, dtype=np.int64)).astype(self.small)
        self.need, self.fewest = (np.zeros((index.longest + 1, self.count), self.small) for _ in range(2))
        self.slack, self.ahead = (np.zeros((index.longest + 1, self.count), np.int32) for _ in range(2))
        self._demand(np.arange(self.count))
        self.open, self.held = [], 0

    def _demand(self, who: np.ndarray) -> None:
        """What names need, by the size of the other name: common characters; and for nodes, by their largest size how many characters may be without a
        partner, by their least size how far the partners may be ahead and the common characters."""
        sizes, least = self.sizes[None, who], np.maximum(self.sim[who], self.least)[None]
        other = np.arange(self.x.longest + 1)[:, None]
        lo = np.ceil(sizes * least / (2 - least) - 1e-6).astype(np.int64)
        hi = np.floor(sizes * (2 - least) / least + 1e-6).astype(np.int64)
        need = lambda m: np.ceil(least * (sizes + m) / 2 - 1e-6).astype(np.int64)
        large, small = np.minimum(other, hi), np.maximum(other, lo)
        self.need[:, who] = np.where((other >= lo) & (other <= hi), np.minimum(need(other), self.never), self.never)
        self.slack[:, who] = np.where(other >= lo, large - need(large), -(1 << 20))
        self.ahead[:, who] = sizes - need(small)
        self.fewest[:, who] = np.where(other <= hi, np.minimum(need(small), self.never), self.never)

    def run(self) -> list[tuple[float, int] | None]:
        who, rows = np.arange(self.count, dtype=np.int32), np.full((self.words, self.count), ~np.uint64(0))
        root = self._near(0, who, np.zeros(self.count, np.int32), rows)
        if len(root[0]):
            self._every(root[0]) if self.least < DENSE_BELOW else self._some(root)
            self._compare()
        return [(float(s), int(p)) if s else None for s, p in zip(self.sim, self.pri)]

    def _some(self, root: tuple[np.ndarray, ...]) -> None:
        """Goes down to the nodes alone that a name can still fit: pairs of names and nodes, some thousands at once."""
        x, stack = self.x, [(0, *root)]
        while stack:
            depth, who, node, rows, common = stack.pop()
            if len(who) > PAIRS_A_SCAN:
                half = len(who) // 2
                stack.append((depth, who[half:], node[half:], rows[:, half:], common[half:]))
                stack.append((depth, who[:half], node[:half], rows[:, :half], common[:half]))
                continue
            few = np.flatnonzero(x.names[node])
            if len(few):
                self._names(depth, who[few], node[few], rows[:, few], common[few])
            name = x.ending[node]
            ends = np.flatnonzero(name >= 0)
            if len(ends):
                self._hits(who[ends], name[ends], rows[:, ends])
            of, node = _ranges(x.first[node], x.first[node + 1] - x.first[node])
            if len(of):
                who = who[of]
                rows = self._step(rows[:, of], x.char[node] * np.int32(self.count) + who)
                near = self._near(depth + 1, who, node, rows)
                if len(near[0]):
                    stack.append((depth + 1, *near))

    def _step(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rows behind one more character; `at` is the place of its mask."""
        masks = self.masks.reshape(self.words, -1)
        return _moved(rows, [m[at] for m in masks])

    def _near(self, depth: int, who: np.ndarray, node: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those rows at nodes of this depth that a name below can still fit, with their common characters so far."""
        x = self.x
        least = x.least[node] * np.int32(self.count) + who
        until = depth + self.ahead.ravel()[least]
        common = np.zeros(len(who), self.small)
        for w in range(self.words):
            common += np.bitwise_count(~rows[w] & _LOW[np.clip(until - 64 * w, 0, 64)])
        near = np.flatnonzero(common >= depth - self.slack.ravel()[x.most[node] * np.int32(self.count) + who])
        who, node, common = who[near], node[near], common[near]
        can = common + self.loose[who]
        for own, other in zip(self.marks, x.within):
            can += np.bitwise_count(own[who] & other[node])
        fits = np.flatnonzero(can >= self.fewest.ravel()[least[near]])
        return who[fits], node[fits], rows[:, near[fits]], common[fits]

    def _names(self, depth: int, who: np.ndarray, node: np.ndarray, rows: np.ndarray, common: np.ndarray) -> None:
        """Bounds the names of nodes that have few."""
        x = self.x
        of, name = _ranges(x.first_name[node], x.names[node])
        own = who[of]
        can = np.minimum(self.loose[own], x.loose[name].astype(self.small))
        for mine, other in zip(self.marks, x.rest):
            can += np.bitwise_count(mine[own] & other[name])
        near = np.flatnonzero(can + common[of] >= self.need.ravel()[x.sizes[name] * self.count + own])
        self._keep(depth, own[near], name[near], rows[:, of[near]], can[near])

    def _every(self, who: np.ndarray) -> None:
        """Goes down to all nodes with all of these names: tables of nodes and names, some thousands of cells at once."""
        x = self.x
        wide = max(1, CELLS_A_SCAN // len(who))
        masks, marks, loose = self.masks[:, :, who], self.marks[:, who], self.loose[who]
        held = np.empty((wide, len(who)), np.uint64)
        bits, counted = np.empty(held.shape, np.uint8), np.empty(held.shape, self.small)
        stack = [(0, 0, np.full((self.words, 1, len(who)), ~np.uint64(0)))]
        while stack:
            depth, lo, rows = stack.pop()
            hi = lo + rows.shape[1]
            for i in np.flatnonzero(x.ending[lo:hi] >= 0):
                self._hits(who, np.full(len(who), x.ending[lo + i]), rows[:, i])
            below = np.repeat(np.arange(hi - lo), np.diff(x.first[lo:hi + 1]))
            for at in range(0, len(below), wide):
                of, first = below[at:at + wide], int(x.first[lo]) + at
                stack.append((depth + 1, first, _moved(rows[:, of], masks[:, x.char[first:first + len(of)]])))
            few = np.flatnonzero(x.names[lo:hi])
            if not len(few):
                continue
            until = depth + self.ahead[x.least[lo:hi].min(), who]
            common = sum(np.bitwise_count(~rows[w] & _LOW[np.clip(until - 64 * w, 0, 64)]).astype(self.small) for w in range(self.words))
            need = self.need[:, who]
            nodes, names = _ranges(x.first_name[lo + few], x.names[lo + few])
            nodes = few[nodes]
            for at in range(0, len(names), wide):
                node, name = nodes[at:at + wide], names[at:at + wide]
                both, can = held[:len(name)], counted[:len(name)]
                for w, other in enumerate(x.rest):
                    np.bitwise_count(np.bitwise_and(other[name, None], marks[w], out=both), out=bits[:len(name)] if w else can)
                    if w:
                        can += bits[:len(name)]
                if loose.any():
                    can += np.minimum(loose, x.loose[name, None].astype(self.small))
                near = np.flatnonzero(can + common[node] >= need[x.sizes[name]])
                if len(near):
                    cell, own = np.divmod(near, len(who))
                    self._keep(depth, who[own], name[cell], rows[:, node[cell], own], can.ravel()[near])

    def _keep(self, depth: int, who: np.ndarray, name: np.ndarray, rows: np.ndarray, can: np.ndarray) -> None:
        self.open.append((who, name, self.x.sizes[name] - depth, can, rows))
        self.held += len(who)
        if self.held >= PAIRS_A_SCAN:
            self._compare()

    def _compare(self) -> None:
        """Takes the rows of the pairs that are open to the ends of the names, as long as what follows can reach what they need."""
        if not self.held:
            return
        x = self.x
        who, name, left, can, rows = (np.concatenate(part, axis=-1) for part in zip(*self.open))
        self.open, self.held = [], 0
        sizes = x.sizes[name]
        at, need = x.starts[name] + sizes - left, self.need.ravel()[sizes * self.count + who]
        while True:
            common = sum(np.bitwise_count(~row).astype(self.small) for row in rows)
            on = common + can >= need
            ends = np.flatnonzero(on & (left == 0))
            if len(ends):
                self._hits(who[ends], name[ends], rows[:, ends])
            on = np.flatnonzero(on & (left > 0))
            if not len(on):
                return
            who, name, left, can, rows, at, need = who[on], name[on], left[on] - 1, can[on], rows[:, on], at[on], need[on]
            rows = self._step(rows, x.chars[at] * np.int32(self.count) + who)
            can = can - self.has.ravel()[x.kind[at] * np.int32(self.count) + who]
            at = at + 1

    def _hits(self, who: np.ndarray, name: np.ndarray, rows: np.ndarray) -> None:
        common = np.bitwise_count(~rows).sum(axis=0, dtype=np.int64)
        total = self.x.sizes[name] + self.sizes[who]
        sim = (1.0 - (total - 2 * common) / total) * 100 / 100
        pri = self.x.pri[name]
        good = np.flatnonzero((sim >= self.least) & ((sim > self.sim[who]) | (sim == self.sim[who]) & (pri < self.pri[who])))
        if len(good):
            good = good[np.lexsort((-pri[good], sim[good], who[good]))]
            good = good[np.append(who[good][1:] != who[good][:-1], True)]
            who = who[good]
            self.sim[who], self.pri[who] = sim[good], pri[good]
            self._demand(who)


#: Words with the lowest 0 to 64 bits set.
_LOW = np.array([(1 << i) - 1 for i in range(65)], np.uint64)


def _moved(rows: np.ndarray, masks: Sequence[np.ndarray]) -> np.ndarray:
    """Rows of the table of common characters behind one more character with these masks, by words; a carry runs from word to word."""
    out, carry = np.empty_like(rows), None
    for w, mask in enumerate(masks):
        used = rows[w] & mask
        total = rows[w] + used
        if len(masks) > 1:
            over = total < used
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
        used ^= rows[w]
        np.bitwise_or(total, used, out=out[w])
    return out


def _ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of numbers the place of the range and the number, one after the other."""
    of = np.repeat(np.arange(len(first), dtype=np.int32), counts)
    return of, (first - (np.cumsum(counts) - counts)).astype(np.int32)[of] + np.arange(len(of), dtype=np.int32)


def _nth(keys: np.ndarray) -> np.ndarray:
    """How many equal ones go before each of these keys that are in order."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(new)
    return np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))


def most_similar(names: DataFrame, catalog: DataFrame, floor: float = rules.FUZZY_FLOOR, block: int = NAMES_BLOCK) -> DataFrame:
    """For each distinct name of `names` (name) the most similar one of `catalog` (pri, name): rows (name, pri, sim) where the
    token-sort similarity reaches the floor (0 to 1, above 0). The smallest pri wins ties; NULL and blank names have none."""
    spark = names.sparkSession
    listed = written(
        catalog.select("pri", token_sort(C("name")).alias("tokens")).where("tokens <> ''").groupBy("tokens").agg(F.min("pri").alias("pri")), "similar-catalog")
    asked = written(names.select("name", token_sort(C("name")).alias("tokens")).where("tokens <> ''").distinct(), "similar-names")
    # names of the same words need no search
    equal = asked.join(listed, "tokens").select("name", "pri", F.lit(1.0).alias("sim"))
    rows = asked.join(listed, "tokens", "left_anti").select("name", "tokens", F.lit(None).cast("bigint").alias("pri"), F.lit(None).cast("double").alias("sim"))
    rows = written(rows, "similar-open")
    size, open_ = listed.count(), rows.count()
    if not size or not open_:
        return equal
    blocks = -(-size // block)
    if blocks > 1:  # names in order share more of a tree
        listed = written(listed.repartitionByRange(blocks, "tokens").withColumn("block", F.spark_partition_id()), "similar-blocks")
    held = []
    for b in range(blocks):
        part = (listed.where(C("block") == b) if blocks > 1 else listed).select("tokens", "pri").toArrow()
        held.append(spark.sparkContext.broadcast(NameIndex([*zip(*(c.to_pylist() for c in part.columns))], floor)))
    steps = [*(s for s in SIMILAR_STEPS if s > floor), floor]
    # one block at a time, with the best of those before; a name that has one as similar as the step has seen all blocks
    rounds = [[s] for s in steps] if blocks > 1 else [steps]
    for i, some in enumerate(rounds):
        if i:
            done = f"sim >= {rounds[i - 1][-1]!r}D"
            equal = equal.union(rows.where(done).select("name", "pri", "sim"))
            rows = rows.where(f"sim is null or not {done}")
            open_ = rows.count()
            if not open_:
                return equal
        tasks = max(-(-open_ * min(size, block) // PAIRS_A_TASK), min(spark.sparkContext.defaultParallelism, -(-open_ // 64)))
        for b, index in enumerate(held):
            # a name is a few bytes and up to a second's work, so its bytes are no measure
            rows = rows.repartition(tasks).mapInArrow(_searched(index, some), "name string, tokens string, pri bigint, sim double")
            if i + 1 < len(rounds) or b + 1 < blocks:
                rows = written(rows, "similar-block")
    return equal.union(rows.where("pri is not null").select("name", "pri", "sim"))


def _searched(index, steps: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, pri, sim = (c.to_pylist() for c in batch.columns[1:])
            best = index.value.best_of(tokens, [None if p is None else (s, p) for p, s in zip(pri, sim)], steps)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x and x[1] for x in best], pa.int64()), pa.array([x and x[0] for x in best], pa.float64())],
                ["name", "tokens", "pri", "sim"])

    return run


# ---------------------------------------------------------------------------------------- the join
def supplier_verdicts(suppliers: DataFrame, tables: CatalogTables, floor: float = rules.FUZZY_FLOOR) -> DataFrame:
    """For each distinct supplier (supplier): prefixes, the distributor rules that apply to it in order as structs (pri, prefix, row), and
    row, the pri of its exact or else most similar manufacturer."""
    catalog = tables.catalog
    first = catalog.groupBy("manufacturer").agg(F.min("pri").alias("row"))
    rules_of = tables.distributors.join(first, "manufacturer").select(
        F.lower("distributor").alias("word"), F.struct("pri", "prefix", "row").alias("rule"))
    names = written(suppliers.where("supplier is not null").select("supplier", F.lower("supplier").alias("low")).distinct(), "suppliers")
    # a distributor's word gets the smallest pri of its rules as its number
    words = rules_of.groupBy("word").agg(F.min("rule.pri").alias("pri"), F.sort_array(F.collect_list("rule")).alias("rules"))
    found = every_keyword(names, "low", words, "hits").select("supplier", F.explode("hits").alias("pri"))
    hits = found.join(words, "pri").groupBy("supplier").agg(F.sort_array(F.flatten(F.collect_list("rules"))).alias("prefixes"))
    exact = names.join(catalog.groupBy(F.lower("manufacturer").alias("low")).agg(F.min("pri").alias("exact")), "low").select("supplier", "exact")
    known = written(names.select("supplier").join(exact, "supplier", "left").join(hits, "supplier", "left"), "supplier-known")
    similar = most_similar(known.where("exact is null").select(C("supplier").alias("name")), catalog.select("pri", C("manufacturer").alias("name")), floor)
    return known.join(similar.select(C("name").alias("supplier"), C("pri").alias("similar")), "supplier", "left").select(
        "supplier", "prefixes", F.coalesce("exact", "similar").alias("row"))


def resolve_tables(df: DataFrame, supplier: Column, desc: Column, mpn: Column, brand: Column, tables: CatalogTables,
                   out: tuple[str, str] = ("MANUFACTURER_NAME", "BRAND_NAME")) -> DataFrame:
    """Adds the canonical manufacturer and brand by the same cascade as `resolve`: brand alias, distributor rule, keyword,
    exact name, most similar name, else the supplier itself, else unknown. Inputs may be raw; they are cleaned here."""
    keep = df.columns
    row = F.struct(*[C(f"`{c}`") for c in keep]).alias("record")
    rows = df.select(row, drop_code(clean_placeholder(supplier)).alias("supplier"), strip(no_marks(F.lower(clean_placeholder(brand)))).alias("alias"),
                     F.lower(drop_remark(plain_quotes(desc))).alias("desc"), F.upper(strip(text(mpn))).alias("num"))
    rows = first_keyword(rows.withColumn("both", F.concat("desc", F.lit("\n"), F.lower("num"))), "both",
                         tables.catalog.select(F.explode("keywords").alias("word"), "pri"), "by_keyword")
    rows = written(rows.drop("both"), "catalog-rows")
    by_brand = tables.catalog.groupBy("brand").agg(F.min("pri").alias("by_alias"))
    aliases = tables.aliases.join(by_brand, "brand").groupBy("alias").agg(F.min("by_alias").alias("by_alias"))
    verdicts = supplier_verdicts(rows.select("supplier"), tables)
    rows = rows.join(aliases, "alias", "left").join(verdicts.withColumnRenamed("row", "by_name"), "supplier", "left")
    applies = F.filter("prefixes", lambda r: F.startswith(C("num"), r["prefix"]) | F.contains(C("desc"), F.lower(r["prefix"])))
    rows = rows.select("record", "supplier", F.coalesce("by_alias", F.get(applies, F.lit(0))["row"], "by_keyword", "by_name").alias("pri"))
    names = tables.catalog.groupBy("pri").agg(F.min(F.struct("manufacturer", "brand")).alias("entry"))
    return rows.join(names, "pri", "left").select(
        "record.*", F.coalesce("entry.manufacturer", "supplier", F.lit(UNKNOWN[0])).alias(out[0]), F.coalesce("entry.brand", "supplier", F.lit(UNKNOWN[1])).alias(out[1]))


__all__ = ["CatalogTables", "NameIndex", "catalog_tables", "every_keyword", "first_keyword", "most_similar", "resolve_tables", "supplier_verdicts"]
