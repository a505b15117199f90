"""Benchmark decontamination with a generalised suffix automaton over words.

The test items are small against the corpus, but not bounded, so they are taken in blocks of at most
`block_words` words (a block is a fixed share of the item hashes; the number of blocks follows the
counted words). For each block one automaton of all its items is built and broadcast, and the whole
corpus streams past it; the results of the blocks are merged by document. Training words that are no
item word, and stretches whose word pairs occur in no item, cannot be part of a match and only reset
the automaton, so most of a text is settled by array operations; the rest steps through it, tracking
the longest match that ends at each word.

Words: A-Z lowered, then runs of bytes other than ASCII non-alphanumerics. A window is `window`
consecutive words of an item, or the whole of a shorter item. Every word inside an occurrence is hit.
Null texts have no words, items without a word or without an id never match, items with equal ids
count once. Extra columns of either table are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import LOWER, Words, chunks, free, small_batches, table

WINDOW = 10
BLOCK_WORDS = 1_000_000
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: dict[str, list[bytes]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        vocabulary = sorted({w for words in items.values() for w in words})
        self.codes = {w: i for i, w in enumerate(vocabulary)}
        scanned = Words(vocabulary, SEPARATORS).hashes()
        order = np.argsort(scanned)
        self.hashes, self.ids = scanned[order], order.astype(np.int64)
        coded = {k: [self.codes[w] for w in words] for k, words in items.items() if words}
        pairs = set()
        for seq in coded.values():
            self._add(seq)
            pairs.update(zip(seq, seq[1:]))
        self.pairs = np.array(sorted(a * len(vocabulary) + b for a, b in pairs), np.int64)
        self.shortest = min((min(len(s), window) for s in coded.values()), default=0)
        # items by the state of each window, and whole short items by state
        self.found: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for key, seq in coded.items():
            state, size = 0, 0
            for c in seq:
                state, size = self.step(state, size, c)
                if size >= window:
                    self.found.setdefault(self.cut(state, window), set()).add(key)
            if len(seq) < window:
                self.short.setdefault(state, []).append((len(seq), key))
        self.short_above = [-1] * len(self.link)  # nearest state on the suffix path, itself included
        for s in sorted(range(len(self.link)), key=self.size.__getitem__):
            self.short_above[s] = s if s in self.short else (self.short_above[self.link[s]] if s else -1)

    def _new(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(edges)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the longest string at p extended by c, when q stands for longer ones too."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
                continue
            new, p = self._new(self.size[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """Longest suffix of what was read, c included, that occurs in an item."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.size[state]
        return (self.next[state][c], size + 1) if c in self.next[state] else (0, 0)

    def cut(self, state: int, size: int) -> int:
        while self.size[self.link[state]] >= size:
            state = self.link[state]
        return state

    def code(self, h: np.ndarray) -> np.ndarray:
        """Item word codes of word hashes; -1 for words of no item."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], -1)

    def stretches(self, code: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that a match can lie in."""
        n = len(code)
        if not n or not self.shortest:
            return
        tied = np.zeros(n, bool)  # with the word before
        pair = code[:-1] * len(self.hashes) + code[1:]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            tied[1:] = (self.pairs[at] == pair) & (code[:-1] >= 0) & (code[1:] >= 0)
        tied[first[first < n]] = False
        begin = np.flatnonzero(~tied)
        end = np.append(begin[1:], n)
        keep = (end - begin >= self.shortest) & (code[begin] >= 0)
        yield from zip(begin[keep].tolist(), end[keep].tolist())

    def scan(self, words: Words) -> tuple[list[tuple[int, int]], list[set[str]]]:
        """Hit word ranges (may overlap), in word order, and the items of each."""
        code = self.code(words.hashes())
        ranges, items = [], []
        for begin, end in self.stretches(code, words.first):
            state, size = 0, 0
            for i, c in enumerate(code[begin:end].tolist(), begin + 1):
                state, size = self.step(state, size, c)
                if size >= self.window:
                    ranges.append((i - self.window, i))
                    items.append(self.found[self.cut(state, self.window)])
                s = self.short_above[state]
                while s > 0:
                    for m, key in self.short[s]:
                        if m <= size:
                            ranges.append((i - m, i))
                            items.append({key})
                    s = self.short_above[self.link[s]]
        return ranges, items


def item_words(text: str | None) -> list[bytes]:
    lowered = (text or "").encode().translate(LOWER)
    return lowered.translate(bytes(0x20 if b in SEPARATORS else b for b in range(256))).split()


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct column `match`: n_words, ranges array<struct<begin, end>> of hit words
    (merged), item_ids array<string> (sorted as strings). docs must have a text column."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    # words of all items, from above: every separator ends at most one word
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_words))
    schema = "n_words bigint, ranges array<struct<begin:int,end:int>>, item_ids array<string>"
    out = docs
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about block_words words
        texts: dict[str, list[bytes]] = {}
        for n, (key, text) in enumerate(rows):
            texts[f"{key}\0{n}"] = item_words(text)
        shared = spark.sparkContext.broadcast(Automaton(texts, window))

        @F.pandas_udf(schema)
        def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            automaton = shared.value
            for column in batches:
                texts = [b"" if t is None else t.encode().translate(LOWER) for t in column]
                counts, spans, keys = [], [], []
                for i, j in chunks(texts):
                    words = Words(texts[i:j], SEPARATORS)
                    found: list[dict] = [{"ranges": [], "items": set()} for _ in range(i, j)]
                    for (a, b), who in zip(*automaton.scan(words)):
                        d = int(np.searchsorted(words.first, a, "right")) - 1
                        f, base = found[d], int(words.first[d])
                        f["ranges"].append((a - base, b - base))
                        f["items"] |= who
                    counts += np.diff(words.first).tolist()
                    spans += [joined(f["ranges"]) for f in found]
                    keys += [sorted({x.split("\0")[0] for x in f["items"]}) for f in found]
                yield pd.DataFrame({"n_words": counts, "ranges": [[{"begin": a, "end": b} for a, b in s] for s in spans], "item_ids": keys})

        out = out.withColumn("match" if not k else "match_more", scan("text"))
        if k:
            m, n = F.col("match"), F.col("match_more")
            out = out.withColumn("match", F.struct(
                m["n_words"].alias("n_words"), F.concat(m["ranges"], n["ranges"]).alias("ranges"),
                F.array_sort(F.array_union(m["item_ids"], n["item_ids"])).alias("item_ids"))).drop("match_more")
    return out


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covered(ranges) -> int:
    return sum(b - a for a, b in joined([(r["begin"], r["end"]) for r in ranges]))


def without_spans(text: str | None, ranges) -> str | None:
    """The text without the bytes from the first to the last hit word of each range."""
    if text is None or not len(ranges):
        return text
    raw = text.encode()
    words = Words([raw.translate(LOWER)], SEPARATORS)
    for a, b in reversed(joined([(r["begin"], r["end"]) for r in ranges])):
        raw = raw[:words.start[a]] + raw[words.end[b - 1]:]
    return raw.decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs without contaminated spans; all columns of docs stay.

    A span is any run of hit words. A document of which more than `max_coverage` of the words are hit
    goes as a whole; of the others only the spans go. Rows with null text stay as they are.
    """
    columns = docs.columns

    @F.pandas_udf("struct<text:string,coverage:double>")
    def clean(text: pd.Series, n_words: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "text": [without_spans(t, r) for t, r in zip(text, ranges)],
            "coverage": [covered(r) / max(1, n) for n, r in zip(n_words, ranges)],
        })

    fresh = free("_clean", columns)
    found = matches(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text"), items, window)
    hit = F.size("match.ranges") > 0
    # clean documents pass by the second UDF's work: their ranges are empty
    done = found.withColumn(fresh, clean("text", "match.n_words", "match.ranges")).where(~hit | (F.col(fresh)["coverage"] <= max_coverage))
    return done.select(*[(F.col(fresh)["text"] if c == "text" else F.col("row")[c]).alias(c) for c in columns])


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = matches(docs.select("doc_id", "text"), items, window)
    hit = F.aggregate(
        F.array_sort("match.ranges"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["begin"], s["end"]))).alias("n"), F.greatest(s["end"], r["end"]).alias("end")),
        lambda s: s["n"].cast("bigint"))
    return found.select(
        "doc_id", F.col("match.n_words").alias("n_words"), hit.alias("n_hit"), F.size("match.item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("match.item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, m, p, item_id FROM dw JOIN bw USING (m, t)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS i FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
