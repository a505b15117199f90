"""Edit-aware token counts: a segment tree of pre-token blocks for each document.

A text is cut into pre-tokens by the tokenizer's pattern; a leaf is a block of LEAF pre-tokens with its
characters and tokens, and the inner nodes hold sums. An edit touches the leaves under it; counting
starts again at the leaf in front of the edit less the pattern's look-ahead (CONTEXT characters) and
ends at the first old leaf boundary behind the edit that the new pre-tokens hit. From there on the
pattern sees the same text at the same boundary, so every later leaf stays as it is; only sums on the
paths of the changed leaves are updated. Leaves that an edit swallowed stay as empty leaves, so the
tree keeps its shape.

Counts are those of the whole new text, exactly. The tree travels as a binary column (8 bytes a node);
the work is one pass in Arrow batches without a shuffle.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import small_batches, table

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of that vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 2
LEAF = 64
CACHE = 200_000


class Counter:
    """Tokens of pre-tokens; what was counted is kept up to CACHE pre-tokens."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def of(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for p in parts:
            n = known.get(p)
            if n is None:
                n = known[p] = len(self.encoding.encode_ordinary(p))
            out.append(n)
        return out

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    """Sums over leaves: column 0 characters, column 1 tokens; node i has the children 2i and 2i + 1."""

    def __init__(self, sums: np.ndarray, leaves: int) -> None:
        self.sums, self.leaves, self.width = sums, leaves, len(sums) // 2

    @classmethod
    def build(cls, text: str, count: Counter) -> Tree:
        parts = count.pattern.findall(text)
        cuts = np.arange(0, len(parts), LEAF)
        leaves = max(1, len(cuts))
        width = 1 << (leaves - 1).bit_length()
        sums = np.zeros((2 * width, 2), np.int32)
        if parts:
            n = len(parts)
            sums[width:width + leaves, 0] = np.add.reduceat(np.fromiter(map(len, parts), np.int32, n), cuts)
            sums[width:width + leaves, 1] = np.add.reduceat(np.array(count.of(parts), np.int32), cuts)
        while width > 1:
            sums[width // 2:width] = sums[width:2 * width:2] + sums[width + 1:2 * width:2]
            width //= 2
        return cls(sums, leaves)

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        flat = np.frombuffer(raw, "<i4").copy()
        return cls(flat[1:].reshape(-1, 2), int(flat[0]))

    def dump(self) -> bytes:
        return np.int32(self.leaves).tobytes() + self.sums.astype("<i4").tobytes()

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1]) if self.width > 1 else int(self.sums[1:, 1].sum())

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins; the last leaf for the text's end."""
        node, before = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            node, before = (2 * node, before) if char < before + left or not self.sums[2 * node + 1, 0] else (2 * node + 1, before + left)
        return node - self.width, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([chars, tokens], np.int32) - self.sums[node]
        while node >= 1:
            self.sums[node] += change
            node //= 2

    def edit(self, text: str, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, int]:
        """The text after the edits (begin, end, replacement; sorted, apart, in old offsets) and the
        number of pre-tokens counted anew."""
        pieces, at = [], 0
        for begin, end, new in edits:
            pieces += [text[at:begin], new]
            at = end
        after = "".join([*pieces, text[at:]])
        bounds = np.concatenate([[0], np.cumsum(self.sums[self.width:self.width + self.leaves, 0])]).tolist()
        ranges: list[list[int]] = []  # first leaf, leaf behind, growth before, growth with
        shift = 0
        for begin, end, new in edits:
            first = self.leaf_at(max(0, begin - CONTEXT))[0]
            last = min(self.leaves, bisect_right(bounds, max(begin, end - 1)))
            grown = shift + len(new) - (end - begin)
            if ranges and first < ranges[-1][1]:
                ranges[-1][1], ranges[-1][3] = max(ranges[-1][1], last), grown
            else:
                ranges.append([first, max(first + 1, last), shift, grown])
            shift = grown
        counted, k = 0, 0
        while k < len(ranges):
            first, stop, before, grown = ranges[k]
            k += 1
            begin = bounds[first] + before
            parts: list[str] = []
            goal = bounds[stop] + grown
            pos = begin
            for m in count.pattern.finditer(after, begin):
                if pos == goal and parts or pos == goal == begin:
                    break
                parts.append(m[0])
                pos = m.end()
                while pos > goal and stop < self.leaves:  # over the boundary: on to the next
                    stop += 1
                    while k < len(ranges) and ranges[k][0] < stop:
                        stop, grown = max(stop, ranges[k][1]), ranges[k][3]
                        k += 1
                    goal = bounds[stop] + grown
            counted += len(parts)
            self.put(first, pos - begin, sum(count.of(parts)))
            for leaf in range(first + 1, stop):
                self.put(leaf, 0, 0)
        return after, counted


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that delete lines equal to an earlier line, and runs of three or more equal symbols."""
    seen: set[str] = set()
    out, at = [], 0
    for line in text.split("\n"):
        end = at + len(line)
        if line and line in seen:
            out.append((at, min(len(text), end + 1), ""))
        else:
            seen.add(line)
            out += [(at + m.start(), at + m.end(), "") for m in re.finditer(r"([#*$%&|<>])\1{2,}", line)]
        at = end + 1
    return out


EDITS = "array<struct<begin:int,end:int,text:string>>"


def cleaning(text: Column) -> Column:
    """cleaning_edits of a text; null has none."""

    @F.pandas_udf(EDITS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"begin": a, "end": b, "text": t} for a, b, t in cleaning_edits(x)] if x else [] for x in texts], dtype=object)

    return run(text)


def trees(text: Column, path: str = RANKS_FILE) -> Column:
    """Binary segment tree of a text; null is an empty text."""

    @F.pandas_udf("binary")
    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in column:
            yield pd.Series([Tree.build(t or "", count).dump() for t in texts])

    return run(text)


UPDATED = "n_tokens bigint, n_tokens_after bigint, n_edits bigint, n_counted bigint, text string, tree binary"


def updated(text: Column, tree: Column, edits: Column, path: str = RANKS_FILE) -> Column:
    """struct of UPDATED: counts before and after, the new text and its tree.

    Edits are taken in order of `begin`; an edit that begins before the end of the one before it, or
    lies outside the text, is left out. Null edits and null texts mean none.
    """

    @F.pandas_udf(UPDATED)
    def run(column: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for texts, raw, lists in column:
            rows = []
            for text, bits, edits in zip(texts, raw, lists):
                t, body = Tree.load(bits), text or ""
                before, todo, at = t.tokens, [], 0
                for e in sorted(() if edits is None else edits, key=lambda e: (e["begin"], e["end"])):
                    if at <= e["begin"] <= e["end"] <= len(body):
                        todo.append((e["begin"], e["end"], e["text"] or ""))
                        at = e["end"]
                after, counted = t.edit(body, todo, count) if todo else (body, 0)
                rows.append((before, t.tokens, len(todo), counted, None if text is None else after, t.dump()))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_tokens_after", "n_edits", "n_counted", "text", "tree"])

    return run(text, tree, edits)


def recount(docs: DataFrame, edits: Column | None = None, path: str = RANKS_FILE) -> DataFrame:
    """docs (text and any columns but `counts`) with a struct `counts` of UPDATED."""
    small_batches(docs.sparkSession)
    text = F.col("text")
    return docs.withColumn("counts", updated(text, trees(text, path), cleaning(text) if edits is None else edits, path))


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recount(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "counts.n_tokens", "counts.n_tokens_after", "counts.n_edits", "counts.n_counted", F.sha2(F.coalesce("counts.text", F.lit("")), 256).alias("text_sha256"))
