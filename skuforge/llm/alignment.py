"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model. Both encode a space and the text. A
cut is a byte offset where a token of A and a token of B end; the tokens between two cuts are a group, and each
A token is linked with each B token of its group.

Where tokens end comes from the libraries' own spans: character offsets of A, turned into bytes, and the spans
of B's proto. These are coarse where several tokens share a character: A cuts multibyte characters, B falls
back to bytes, and their spans repeat or are empty. There the sizes of the decoded bytes refine the ends.

Neither tokenizer merges over a space that follows other characters (A's pre-token pattern; B as long as none of its
pieces holds a space behind another character, which is verified), so such spaces cut a text into segments
that are encoded and aligned on their own, and repeated segments once. A segment whose tokens do not give back its
bytes sends the text through both tokenizers as a whole.

Counts over the corpus: every text's distinct pairs of ids are written once, Spark counts them. The pairs that make up
at least 1 / HOT_PAIRS of all occurrences are at most HOT_PAIRS and are broadcast; rarer ones, none of them
hot, are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import chunks, encoded, small_batches, table
from skuforge.plans.results import written

BPE_FILE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs that are broadcast at most (17 bytes each).
HOT_PAIRS = 1 << 20
#: Characters of segments, and segments, that a worker remembers before it starts anew.
CACHE_CHARS = 1 << 22
CACHE_SEGMENTS = 1 << 18
#: Characters of new segments that are encoded as one text.
STRETCH = 1 << 15
#: Bytes of text that are aligned before rows are handed on.
CHUNK_BYTES = 1 << 21
#: Bits of an id; a pair is A's id << ID_BITS | B's id.
ID_BITS = 20
#: Links of a group up to which they are spelled out; larger groups count equal ids first.
SPELLED_LINKS = 64

_CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each token ends. begin, end: the library's spans in bytes, coarse; size: of the decoded bytes.

    A span that is empty, or that the next one starts inside of, belongs to a token that shares a character
    with the next; it ends as many decoded bytes after the last end that is certain as lie between.
    """
    shared = begin == end
    shared[:-1] |= begin[1:] < end[:-1]
    total = np.cumsum(size)
    certain = np.maximum.accumulate(np.where(shared, -1, np.arange(len(end))))
    since = np.where(certain < 0, 0, end[certain] - total[certain])
    return since + total


class Stream:
    """Both encodings of texts that stand one behind the other, and their groups.

    a, b: ids; a_group, b_group: group of each token; end: where each group ends, in bytes of all texts, each with its space.
    """

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> None:
        self.a, self.b = a, b
        self.a_last = b_ends[np.searchsorted(b_ends, a_ends)] == a_ends if len(a) else np.zeros(0, bool)
        self.b_last = a_ends[np.searchsorted(a_ends, b_ends)] == b_ends if len(b) else np.zeros(0, bool)
        self.a_group, self.b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        self.end = a_ends[self.a_last]
        self.n_a, self.n_b = np.bincount(self.a_group, minlength=len(self.end)), np.bincount(self.b_group, minlength=len(self.end))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs: group, pair, how often (a pair may come in several rows of a group)."""
        first = np.cumsum(self.n_b) - self.n_b
        small = self.n_a * self.n_b <= SPELLED_LINKS
        of = np.flatnonzero(small[self.a_group])
        group = self.a_group[of]
        width = self.n_b[group]
        at = np.repeat(first[group] - np.cumsum(width) + width, width) + np.arange(width.sum())
        group = np.repeat(group, width)
        pair = np.repeat(self.a[of], width) << ID_BITS | self.b[at]
        times = np.ones(len(pair), np.int64)
        more = []
        for g in np.flatnonzero(~small).tolist():
            x, n = np.unique(self.a[np.searchsorted(self.a_group, g):np.searchsorted(self.a_group, g + 1)], return_counts=True)
            y, m = np.unique(self.b[first[g]:first[g] + self.n_b[g]], return_counts=True)
            more.append((np.full(len(x) * len(y), g), (x[:, None] << ID_BITS | y).ravel(), (n[:, None] * m).ravel()))
        if more:
            group, pair, times = (np.concatenate(c) for c in zip((group, pair, times), *more))
            order = np.argsort(group, kind="stable")
            group, pair, times = group[order], pair[order], times[order]
        return group, pair, times


class Aligner:
    """Both tokenizers, and the segments met so far.

    A segment has a number; `texts`, `figures` (A tokens, B tokens, groups, links) and its stretch of `pairs` and `times` go by it.
    """

    def __init__(self, bpe: str, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(bpe), SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        # how an id is written inside a group and at its end
        self.written = [f"{i}{mark}" for i in range(len(self.a_bytes)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.b_bytes)) for mark in ",;"]
        kind = json.loads(bpe)
        pre = kind["pre_tokenizer"] or {}
        self.apart = (
            kind["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not any("▁" in p.lstrip("▁") for p in pieces))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str | None] = []
        self.figures = np.zeros((0, 4), np.int64)
        self.start = np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def stream(self, texts: list[str]) -> tuple[Stream, np.ndarray]:
        """The texts, each behind a space, that both sides give back byte for byte, and which those are."""
        spaced = [" " + t for t in texts]
        ok = np.zeros(len(texts), bool)
        begin_a, end_a, begin_b, end_b, ids_a, ids_b, kept = [], [], [], [], [], [], []
        chars = size = 0
        for k, (s, x, y) in enumerate(zip(spaced, self.a.encode_batch(spaced, add_special_tokens=False), self.b.encode(texts, return_type="proto", num_threads=1))):
            raw = s.encode()
            pieces = [(p.id, p.begin, p.end) for p in y.pieces]
            b, begin, end = zip(*pieces) if pieces else ((), (), ())
            a = x.ids
            if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
                continue
            ok[k] = True
            kept.append(raw)
            spans = np.array(x.offsets, np.int64) + chars
            begin_a.append(spans[:, 0])
            end_a.append(spans[:, 1])
            begin_b.append(np.array(begin, np.int64) + size + 1)
            begin_b[-1][0] -= 1  # the added space belongs to the first piece
            end_b.append(np.array(end, np.int64) + size + 1)
            ids_a.append(np.array(a, np.int64))
            ids_b.append(np.array(b, np.int64))
            chars, size = chars + len(s), size + len(raw)
        none = [np.zeros(0, np.int64)]
        begin_a, end_a, begin_b, end_b, a, b = (np.concatenate(x or none) for x in (begin_a, end_a, begin_b, end_b, ids_a, ids_b))
        if chars != size:
            buf = np.frombuffer(b"".join(kept), np.uint8)
            byte = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
            begin_a, end_a = byte[begin_a], byte[end_a]
        return Stream(a, ends(begin_a, end_a, self.a_size[a]), b, ends(begin_b, end_b, self.b_size[b])), ok

    def add(self, stretches: list[list[str]]) -> list[str]:
        """Learns the parts; a stretch is encoded as one text, its parts behind spaces. Returns parts of stretches that failed."""
        got, ok = self.stream([" ".join(parts) for parts in stretches])
        new = [p for parts, fine in zip(stretches, ok) if fine for p in parts]
        if new:
            stop = np.cumsum([len(p.encode()) + 1 for p in new])
            own = np.searchsorted(stop, got.end)  # part of each group
            n, spelled = len(new), np.zeros(len(got.a) + len(got.b), np.int64)
            spelled[np.arange(len(got.a)) + (np.cumsum(got.n_b) - got.n_b)[got.a_group]] = 2 * got.a + got.a_last
            spelled[np.arange(len(got.b)) + np.cumsum(got.n_a)[got.b_group]] = 2 * (len(self.a_bytes) + got.b) + got.b_last
            tokens = [np.bincount(own[g], minlength=n) for g in (got.a_group, got.b_group)]
            group, pair, times = got.links()
            owner = own[group]
            words = list(map(self.written.__getitem__, spelled.tolist()))
            last = np.cumsum(tokens[0] + tokens[1]).tolist()
            base = len(self.texts)
            self.texts += ["".join(words[i:j])[:-1] for i, j in zip([0, *last], last)]
            self.figures = np.concatenate([self.figures, np.stack([*tokens, np.bincount(own, minlength=n), np.bincount(owner, times, n).astype(np.int64)], axis=1)])
            self.pairs, self.times = np.concatenate([self.pairs, pair]), np.concatenate([self.times, times])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.bincount(owner, minlength=n))])
            self.known.update(zip(new, range(base, base + n)))
            self.held += int(stop[-1])
        return [p for parts, fine in zip(stretches, ok) if not fine for p in parts]

    def learn(self, parts: list[str]) -> None:
        """Makes the parts known, those that do not come back as a segment without tokens."""
        stretches, whole, held = [], [], 0
        for p in parts:
            if "▁" in p or p[-1].isspace():
                stretches.append([p])
            else:
                whole.append(p)
                held += len(p)
                if held > STRETCH:
                    stretches.append(whole)
                    whole, held = [], 0
        failed = self.add(stretches + [whole] * bool(whole))
        failed = self.add([[p] for p in failed]) if failed else []
        for p in failed:
            self.known[p] = len(self.texts)
            self.texts.append(None)
            self.figures = np.concatenate([self.figures, np.zeros((1, 4), np.int64)])
            self.start = np.append(self.start, self.start[-1])

    def segments(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the segments of each text; none for an empty text or one that does not come back."""
        if self.held > CACHE_CHARS or len(self.known) > CACHE_SEGMENTS:
            self.forget()
        parts = [(_CUT.split(t) if self.apart else [t]) if t else [] for t in texts]
        self.learn([p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in self.known])
        out = [[self.known[p] for p in own] for own in parts]
        bad = [k for k, own in enumerate(out) if any(self.texts[i] is None for i in own)]
        if bad:
            # a text with such a part is encoded as a whole
            self.learn([t for t in dict.fromkeys(texts[k] for k in bad) if t not in self.known])
            for k in bad:
                i = self.known[texts[k]]
                out[k] = [] if self.texts[i] is None else [i]
        return out


@lru_cache(maxsize=2)
def _aligner(bpe: str, model: bytes) -> Aligner:
    return Aligner(bpe, model)


def _load(spark: SparkSession, bpe_file: str, piece_file: str) -> Callable[[], Aligner]:
    """Both vocabularies, read once on the driver and broadcast (their files' size)."""
    with open(bpe_file, encoding="utf-8") as f, open(piece_file, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    return lambda: _aligner(*files.value)


def groups(docs: DataFrame, bpe_file: str = BPE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """Rows (doc_id, groups array<struct<begin, end, a, b>>): the groups with their byte offsets in space + text. One row
    per input row; a null or empty text, or one that either side does not give back, has none."""
    small_batches(docs.sparkSession)
    load = _load(docs.sparkSession, bpe_file, piece_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for i, j in chunks(texts, CHUNK_BYTES):
                rows = []
                for t in texts[i:j]:
                    got, _ = load().stream([t.decode()] if t else [])
                    a, b = (np.split(x, np.cumsum(n)[:-1]) if len(n) else [] for x, n in ((got.a, got.n_a), (got.b, got.n_b)))
                    rows.append([{"begin": x, "end": y, "a": p, "b": q} for x, y, p, q in zip([0, *got.end.tolist()], got.end.tolist(), a, b)])
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, kind)], ["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, groups array<struct<begin:int,end:int,a:array<int>,b:array<int>>>")


def linked(docs: DataFrame, bpe_file: str = BPE_FILE, piece_file: str = PIECE_FILE) -> DataFrame:
    """Per input row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with how often each is linked (times)."""
    small_batches(docs.sparkSession)
    load = _load(docs.sparkSession, bpe_file, piece_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for i, j in chunks(texts, CHUNK_BYTES):
                aligner = load()
                own = aligner.segments([t.decode() for t in texts[i:j]])
                sizes = np.array([len(x) for x in own])
                at = np.fromiter(chain.from_iterable(own), np.int64, sizes.sum())
                text = np.repeat(np.arange(len(own)), sizes)
                figures = np.zeros((len(own), 4), np.int64)
                np.add.at(figures, text, aligner.figures[at])
                # the pairs of all segments, by text
                width = aligner.start[at + 1] - aligner.start[at]
                where = np.repeat(aligner.start[at] - np.cumsum(width) + width, width) + np.arange(width.sum())
                key = np.repeat(text, width) << 2 * ID_BITS | aligner.pairs[where]
                order = np.argsort(key)
                key, times = key[order], aligner.times[where][order]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                offsets = np.searchsorted(key[first] >> 2 * ID_BITS, np.arange(len(own) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (
                    key[first] & (1 << 2 * ID_BITS) - 1, np.add.reduceat(times, first) if len(first) else times)]
                digests = [hashlib.sha256(";".join([aligner.texts[k] for k in x]).encode()).hexdigest() if x else "" for x in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array(c) for c in figures.T.copy()], pa.array(digests, pa.string()), *lists],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def pair_table(texts: DataFrame) -> DataFrame:
    """Rows (pair, n, best): in how many texts a pair is linked, and whether no pair of the same A id is linked in more."""
    counts = written(texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    a = F.shiftright("pair", ID_BITS).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, bpe_file: str = BPE_FILE, piece_file: str = PIECE_FILE, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that either side does not give back byte for byte, have no tokens: zeros and ''.
    Every input row counts as a document of its own, also where ids or texts repeat. Other columns of docs are not carried.
    """
    spark = docs.sparkSession
    texts = written(linked(docs, bpe_file, piece_file).withColumn("row", F.monotonically_increasing_id()), "align-texts")
    table_of = written(pair_table(texts), "align-pairs")
    total = table_of.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * F.lit(hot_pairs) >= F.lit(total)
    hot = table_of.where(is_hot).toArrow().sort_by("pair")  # hot_pairs rows at most
    shared = spark.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "n", "best")))

    def found(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = shared.value[0]
        if not len(known):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        return at, known[at] == pairs

    def flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(column)
        return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (pairs, owner), (times, _) = flat(batch, "pairs"), flat(batch, "times")
            at, hit = found(pairs)
            total, best = np.zeros((2, batch.num_rows), np.int64)
            n, is_best = shared.value[1][at[hit]], shared.value[2][at[hit]].astype(bool)
            np.add.at(total, owner[hit], times[hit] * n)
            np.add.at(best, owner[hit], times[hit] * is_best)
            keep = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(best), pa.array(total)], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (pairs, owner), (times, _) = flat(batch, "pairs"), flat(batch, "times")
            left = ~found(pairs)[1]
            row = batch.column("row").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(row[owner[left]]), pa.array(pairs[left]), pa.array(times[left])], ["row", "pair", "times"])

    known = texts.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times").mapInArrow(
        sums, "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    rare = texts.select("row", "pairs", "times").mapInArrow(rest, "row bigint, pair bigint, times bigint").join(table_of.where(~is_hot), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    return known.join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")


def op12_span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
