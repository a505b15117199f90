"""SentencePiece encoding, decoding, and sampling of segmentations without replacement.

Pieces come from a public model file; it is never trained. Its scores are merge ranks, so a piece of
rank r gets the Zipf log probability -log(r + 1) - log(sum of 1 / (i + 1)); a character that is no
piece falls back to its UTF-8 bytes, each PENALTY below the rarest piece. Blanks become "▁", one stands
before the text, and no piece reaches over a "▁", so the lattice of a text is a chain of word lattices:
log probabilities add up over the words (line ends, which are in no piece, cut the chain as well). A literal
"▁" in a text is written as bytes, so decoding gives back every text exactly.

Sampling is Gumbel top-k by A* search from the top down. The whole set of segmentations has a Gumbel
variable; a popped set gives its best member, drawn from the model, and what is left of it is split by
the first word that differs from that member. The Gumbel of each part is drawn below that of its
parent, so the agenda yields distinct segmentations in order of their perturbed log probability, as if
all of them had been perturbed and sorted. The next value on the agenda after the k-th is the threshold
kappa; the inclusion score of a sample is log(1 - exp(-exp(log_prob - kappa))), the log probability that
its perturbed value exceeds the threshold. Random numbers are hashes of the row key, the seed and a
counter: a row gives the same samples in every run and partitioning.

A batch builds the lattices of its distinct words once, as arrays, and draws all words at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import mix, small_batches, table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
PENALTY = 10.0
SAMPLES = 2
SEED = 7
SPACE = "▁"
UNITS = re.compile(r"[ \n][^ \n]*")
#: Characters whose lattices and walks are held at a time.
CHUNK_CHARS = 1 << 18
_U = np.uint64


class Pieces:
    """Piece strings, log probabilities, and a trie: a table of children for ASCII characters, sorted (node, character) keys for all."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SPACE not in self.text[i][1:]]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.log_p = np.full(n, -np.inf)
        ranks = np.arange(1, len(ranked) + 1)
        self.log_p[ranked] = -np.log(ranks) - np.log((1 / ranks).sum())
        for i in self.byte.values():
            self.log_p[i] = self.log_p[ranked].min() - PENALTY
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        raw = [of_byte.get(i, self.text[i].replace(SPACE, " ").encode()) for i in range(n)]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in plain:
            at = 0
            for c in self.text[i]:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            ends[at] = i
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.ascii = np.zeros((len(nodes) + 1, 128), np.int32)  # 0: no child
        plain_key = (keys & 0x1FFFFF) < 128
        self.ascii[keys[plain_key] >> 21, keys[plain_key] & 0x7F] = np.flatnonzero(plain_key) + 1
        self.piece = np.full(len(nodes) + 1, -1, np.int64)  # of each trie node
        for at, i in ends.items():
            self.piece[at] = i


    def children(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by a character, 0 for none."""
        out = self.ascii[node, char & 0x7F]
        wide = np.flatnonzero(char > 0x7F)
        if len(wide):
            key = (node[wide] << 21) | char[wide]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[wide] = np.where(self.keys[i] == key, self.child[i], 0)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def split_words(text: str) -> list[str]:
    """The text as units that begin with a blank or a line end; no piece reaches over either."""
    return UNITS.findall(" " + text) if text else []


class Lattices:
    """Lattices of distinct words: edges by node, most likely first; piece ids of each edge.

    A node is a character position; word i begins at node first[i] and ends at node first[i + 1] - 1.
    """

    def __init__(self, words: list[str], p: Pieces) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + 1)])
        n = int(self.first[-1])
        c = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32).astype(np.int64)
        is_end = np.zeros(n, bool)
        is_end[self.first[1:] - 1] = True
        literal = c == ord(SPACE)
        c[c == 32] = ord(SPACE)
        # pieces from every node on, one character further each round
        start = np.flatnonzero(~is_end & ~literal).astype(np.int32)
        at, here = start, np.zeros(len(start), np.int64)
        found = []
        single = np.zeros(n, bool)
        while len(start):
            child = p.children(here, c[at])
            ok = (child > 0) & ~is_end[at]
            start, at, here = start[ok], at[ok] + 1, child[ok].astype(np.int64)
            piece = p.piece[here]
            hit = piece >= 0
            found.append((start[hit], at[hit], piece[hit].astype(np.int32)))
            single[start[hit & (at == start + 1)]] = True
        # characters that are no piece: one edge of one or more byte pieces; ids below -1 point into `spelled`
        alone = np.flatnonzero(~single & ~is_end)
        spellings: dict[int, int] = {}
        self.spelled: list[list[int]] = []
        for x in np.unique(c[alone]).tolist():
            spellings[x] = len(self.spelled)
            self.spelled.append([p.byte[b] for b in chr(x).encode("utf-8", "surrogatepass")])
        number = np.array([spellings[x] for x in c[alone].tolist()], np.int64)
        length = np.array([len(x) for x in self.spelled], np.int64)
        only = np.array([x[0] if len(x) == 1 else -2 - i for i, x in enumerate(self.spelled)], np.int64)
        found.append(tuple(x.astype(np.int32) for x in (alone, alone + 1, only[number] if len(alone) else alone)))
        begin = np.concatenate([f[0] for f in reversed(found)])
        end = np.concatenate([f[1] for f in reversed(found)])
        ids = np.concatenate([f[2] for f in reversed(found)])
        score = np.concatenate([p.log_p[p.byte[0]] * length[number] if len(alone) else np.zeros(0), *(p.log_p[f[2]] for f in reversed(found[:-1]))])
        del found, start, at, here
        order = np.argsort(begin, kind="stable")  # of each node the longest piece first, byte pieces before all
        begin, end, ids, score = begin[order], end[order], ids[order], score[order]
        del order
        self.edge = np.searchsorted(begin, np.arange(n + 1))
        # backward sums and maxima, from the last character of all words on
        total, best = np.zeros(n), np.zeros(n)
        place = np.arange(n) - np.repeat(self.first[:-1], size + 1)
        nodes = np.flatnonzero(~is_end)
        nodes = nodes[np.argsort(-place[nodes], kind="stable")]
        cuts = np.flatnonzero(np.diff(place[nodes], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(nodes))):
            s = nodes[a:b]
            many = self.edge[s + 1] - self.edge[s]
            group = np.cumsum(many) - many
            e = np.repeat(self.edge[s] - group, many) + np.arange(many.sum())
            v = score[e] + total[end[e]]
            m = np.maximum.reduceat(v, group)
            total[s] = m + np.log(np.add.reduceat(np.exp(v - np.repeat(m, many)), group))
            best[s] = np.maximum.reduceat(score[e] + best[end[e]], group)
        self.log_z = total[self.first[:-1]]
        self.begin, self.end, self.ids, self.score = begin, end, ids, score
        self.share = score + total[end] - total[begin]
        # cumulative shares, node by node: the same numbers in whatever batch a word stands
        self.reach = np.exp(self.share)
        at, stop = self.edge[nodes] + 1, self.edge[nodes + 1]
        while len(at := at[on := at < stop]):
            stop = stop[on]
            self.reach[at] += self.reach[at - 1]
            at = at + 1
        self.reach[self.edge[nodes + 1] - 1] = np.inf
        # best path: of each node the edge with the highest score, the longest piece on a tie
        win = np.flatnonzero(score + best[end] == best[begin])
        lead = win[np.diff(begin[win], prepend=-1) > 0]
        self.top = np.full(n, -1, np.int64)
        self.top[begin[lead]] = lead


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(key + _U((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))) >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


class Walk:
    """Edges of one path for each word occurrence: word i has edges[at[i]:at[i + 1]]."""

    def __init__(self, lat: Lattices, word: np.ndarray, key: np.ndarray | None, salt: int) -> None:
        node, stop = lat.first[word].copy(), lat.first[word + 1] - 1
        who = np.flatnonzero(node < stop)
        node, stop, key = node[who], stop[who], None if key is None else key[who]
        steps, k = [], 0
        self.log_p = np.zeros(len(word))
        while len(who):
            if key is None:
                edge = lat.top[node]
            else:
                u = uniform(key, salt + 1000 * k)
                edge = lat.edge[node]
                more = np.flatnonzero(u >= lat.reach[edge])
                while len(more):
                    edge[more] += 1
                    more = more[u[more] >= lat.reach[edge[more]]]
            self.log_p[who] += lat.share[edge]
            steps.append((who, edge))
            node, k = lat.end[edge], k + 1
            on = node < stop
            who, node, stop, key = who[on], node[on], stop[on], None if key is None else key[on]
        count = np.zeros(len(word), np.int64)
        for w, _ in steps:
            count[w] += 1
        self.at = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        self.edges = np.zeros(self.at[-1], np.int64)
        for k, (w, e) in enumerate(steps):
            self.edges[self.at[w] + k] = e

    def of(self, i: int) -> list[int]:
        return self.edges[self.at[i]:self.at[i + 1]].tolist()


def below(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of location phi, given that they are at most `top`."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = phi - np.log(np.exp(phi - top) - np.log(u))
    return np.where(np.isneginf(phi), -np.inf, np.minimum(out, top))


def left_over(p: np.ndarray) -> np.ndarray:
    """log(1 - exp(p)); -inf where nothing is left."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(p, 0.0)) * (p < -1e-12))


def other_path(lat: Lattices, word: int, taken: list[list[int]], u: np.ndarray) -> tuple[list[int], float] | None:
    """A path of the word that is none of `taken`, drawn from the model; its log probability."""
    node, stop, path, log_p, k = int(lat.first[word]), int(lat.first[word + 1]) - 1, [], 0.0, 0
    while node < stop:
        edges = range(int(lat.edge[node]), int(lat.edge[node + 1]))
        mass = []
        for e in edges:
            gone = sum(float(np.exp(lat.share[t[k + 1:]].sum())) for t in taken if len(t) > k and t[k] == e)
            mass.append(float(np.exp(lat.share[e])) * max(0.0, 1.0 - gone if gone < 1 - 1e-12 else 0.0))
        total = sum(mass)
        if total <= 0:
            return None
        goal, i = float(u[k % len(u)]) * total, 0
        while i < len(mass) - 1 and (goal >= mass[i] or mass[i] == 0):
            goal -= mass[i]
            i += 1
        while mass[i] == 0:
            i -= 1
        e = edges[i]
        path.append(e)
        log_p += float(lat.share[e])
        taken = [t for t in taken if len(t) > k and t[k] == e]
        node, k = int(lat.end[e]), k + 1
    return path, log_p


class Sample:
    def __init__(self, base: int, word: int, path: list[int] | None, log_p: float, gumbel: float) -> None:
        self.base, self.word, self.path, self.log_p, self.gumbel = base, word, path, log_p, gumbel


def sample_batch(lat: Lattices, word: np.ndarray, first: np.ndarray, key: np.ndarray, k: int) -> tuple[list[list[Sample]], list[float], list[Walk]]:
    """k distinct segmentations of each text, fewer if it has no more; kappa of each; the walks.

    word: lattice of each word occurrence; text i has the occurrences first[i]:first[i + 1] and the
    random key key[i].
    """
    docs, sizes = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(docs), sizes)
    place = np.arange(len(word)) - np.repeat(first[:-1], sizes)
    own = mix(key[doc] + place.astype(_U) * _U(0xD1342543DE82EF95))
    walks, prefix, gumbel = [], [], []
    samples: list[list[Sample]] = [[] for _ in range(docs)]
    excluded: dict[tuple[int, int, int], list[list[int]]] = {}
    full = sizes > 0
    seg = first[:-1][full]

    def add(s: int, from_word: np.ndarray, start: np.ndarray, top: np.ndarray) -> None:
        """Walk s holds from occurrence from_word of each text on, where the log probability so far is start."""
        walk = Walk(lat, word, own, 31 + 7 * s)
        lp = np.where(place >= from_word[doc], walk.log_p, 0.0)
        run = np.empty_like(lp)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            np.cumsum(lp[a:z], out=run[a:z])
        before = start[doc] + run - lp
        phi = np.where(place >= from_word[doc], before + left_over(walk.log_p), -np.inf)
        walks.append(walk)
        prefix.append(before)
        gumbel.append(below(phi, top[doc], uniform(own, 500_009 + s)))

    def totals(s: int) -> np.ndarray:
        out = np.zeros(docs)
        last = first[1:][full] - 1
        out[full] = prefix[s][last] + np.where(place[last] >= begin[s][full], walks[s].log_p[last], 0.0)
        return out

    begin = [np.zeros(docs, np.int64)]
    root = -np.log(-np.log(uniform(key, 3)))
    add(0, begin[0], np.zeros(docs), root)
    whole = totals(0)
    for i in range(docs):
        samples[i].append(Sample(-1, -1, None, float(whole[i]), float(root[i])))

    def best() -> tuple[np.ndarray, np.ndarray]:
        top, who = np.full(docs, -np.inf), np.zeros(docs, np.int64)
        for s, g in enumerate(gumbel):
            if len(seg):
                m = np.full(docs, -np.inf)
                m[full] = np.maximum.reduceat(g, seg)
                who, top = np.where(m > top, s, who), np.maximum(m, top)
        return top, who

    for s in range(1, k):
        top, who = best()
        start, at = np.zeros(docs), sizes.astype(np.int64).copy()
        chosen: list[tuple | None] = [None] * docs
        for i in np.flatnonzero(~np.isneginf(top)).tolist():
            b = int(who[i])
            a, z = int(first[i]), int(first[i + 1])
            j = a + int(gumbel[b][a:z].argmax())
            taken = excluded.setdefault((i, b, j), [walks[b].of(j)])
            u = uniform(np.arange(64, dtype=_U) + own[j], 900_001 + s)
            drawn = other_path(lat, int(word[j]), taken, u)
            if drawn is None:
                gumbel[b][j] = -np.inf
                continue
            path, lp = drawn
            taken.append(path)
            rest = 1.0 - sum(float(np.exp(lat.share[t].sum())) for t in taken)
            phi = prefix[b][j] + np.log(rest) if rest > 1e-12 else -np.inf
            gumbel[b][j] = below(np.array([phi]), top[i:i + 1], u[-1:])[0]
            chosen[i] = (b, j - a, path, float(top[i]))
            start[i], at[i] = prefix[b][j] + lp, j - a + 1
        begin.append(at)
        add(s, at, start, top)
        whole = totals(s)
        for i, c in enumerate(chosen):
            if c:
                done = start[i] if at[i] >= sizes[i] else float(whole[i])
                samples[i].append(Sample(c[0], c[1], c[2], float(done), c[3]))
    kappa, _ = best()
    return samples, kappa.tolist(), walks


def edges_of(samples: list[Sample], s: int, walks: list[Walk], a: int, z: int) -> np.ndarray:
    """Edges of sample s of the text with the occurrences a:z."""
    x = samples[s]
    own = walks[s]  # a text that has no more segmentations gets none in later walks
    if x.path is None:
        return own.edges[own.at[a]:own.at[z]]
    head = edges_of(samples, x.base, walks, a, a + x.word)
    return np.concatenate([head, np.array(x.path, np.int64), own.edges[own.at[a + x.word + 1]:own.at[z]]])


def ids_of(lat: Lattices, edges: np.ndarray) -> np.ndarray:
    ids = lat.ids[edges]
    if not len(ids) or ids.min() >= 0:
        return ids
    many = np.ones(len(ids), np.int64)
    odd = np.flatnonzero(ids < 0)
    spelled = [lat.spelled[-2 - i] for i in ids[odd].tolist()]
    many[odd] = [len(x) for x in spelled]
    out = np.repeat(ids, many)
    out[out < 0] = np.concatenate([np.array(x, np.int64) for x in spelled])
    return out


def decoded_bytes(ids: np.ndarray, p: Pieces) -> bytes:
    """UTF-8 of the text of piece ids, without the blank that stands before every text."""
    size = p.size[ids]
    at = np.repeat(p.offset[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return p.flat[at].tobytes()[1:]


def decode(ids, path: str = MODEL_FILE) -> str:
    """The text of piece ids; inverse of every encoding here."""
    return decoded_bytes(np.asarray(ids, np.int64), pieces(path)).decode("utf-8", "surrogatepass")


def encode_texts(texts: list[str], keys: np.ndarray, k: int, path: str) -> list[dict]:
    """Best segmentation and k samples of each text."""
    p = pieces(path)
    units: list[str] = []
    first = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        units += split_words(t)
        first[i + 1] = len(units)
    word, distinct = pd.factorize(np.array(units, object))
    del units
    lat = Lattices(list(distinct), p)
    top = Walk(lat, word, None, 0)
    samples, kappa, walks = sample_batch(lat, word, first, keys, k)
    out = []
    for i in range(len(texts)):
        a, z = int(first[i]), int(first[i + 1])
        best = ids_of(lat, top.edges[top.at[a]:top.at[z]])
        rows = []
        for s, x in enumerate(samples[i]):
            rate = np.exp(min(x.log_p - kappa[i], 700.0)) if kappa[i] > -np.inf else np.inf
            score = x.log_p - kappa[i] if rate < 1e-12 else float(np.log(-np.expm1(-rate)))
            rows.append({"ids": ids_of(lat, edges_of(samples[i], s, walks, a, z)), "log_prob": x.log_p, "gumbel": x.gumbel, "log_inclusion": float(score)})
        out.append({"best": best, "samples": rows, "log_z": float(lat.log_z[word[a:z]].sum())})
    return out


def encode(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED, path: str = MODEL_FILE, key: str = "doc_id") -> DataFrame:
    """doc_id and text of docs with `best` (ids), `samples` (array of ids, log_prob, log_inclusion).

    Null and empty texts have no pieces and one empty sample. The row key seeds the samples; null is a
    key like any other, and rows with equal keys and texts get equal samples.
    """
    return docs.select(F.xxhash64(key, F.lit(seed)).alias("row_key"), F.col(key).alias("doc_id"), "text").mapInArrow(
        _runner(samples, path, False), "doc_id " + docs.schema[key].dataType.simpleString() + ", text string, best array<int>, samples array<struct<ids:array<int>,log_prob:double,log_inclusion:double>>")


def digests(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED, path: str = MODEL_FILE, key: str = "doc_id") -> DataFrame:
    """What encode() gives, as counts, SHA-256 of the ids and a decoding check: small rows for large texts."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.xxhash64(key, F.lit(seed)).alias("row_key"), F.col(key).alias("doc_id"), "text").mapInArrow(
        _runner(samples, path, True),
        f"doc_id {kind}, n_pieces bigint, ids_sha256 string, round_trip boolean, samples array<struct<n_pieces:bigint,ids_sha256:string,log_prob:double,log_inclusion:double>>")


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def _runner(k: int, path: str, short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            texts = [t or "" for t in batch.column(2).to_pylist()]
            begin, held = 0, 0
            for j in range(len(texts) + 1):
                if j < len(texts) and (begin == j or held + len(texts[j]) <= CHUNK_CHARS):
                    held += len(texts[j])
                    continue
                if begin == j:
                    continue
                p = pieces(path)
                got = encode_texts(texts[begin:j], keys[begin:j], k, path)
                ids = batch.column(1).slice(begin, j - begin)
                if short:
                    yield pa.RecordBatch.from_arrays([
                        ids, pa.array([len(g["best"]) for g in got], pa.int64()), pa.array([_sha(g["best"]) for g in got]),
                        pa.array([all(decoded_bytes(x, p) == t for x in (g["best"], *(s["ids"] for s in g["samples"]))) for g, t in zip(got, (t.encode() for t in texts[begin:j]))]),
                        pa.array([[{"n_pieces": len(s["ids"]), "ids_sha256": _sha(s["ids"]), "log_prob": s["log_prob"], "log_inclusion": s["log_inclusion"]} for s in g["samples"]] for g in got],
                                 pa.list_(pa.struct([("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())])))],
                        ["doc_id", "n_pieces", "ids_sha256", "round_trip", "samples"])
                else:
                    yield pa.RecordBatch.from_arrays([
                        ids, batch.column(2).slice(begin, j - begin), pa.array([g["best"] for g in got], pa.list_(pa.int32())),
                        pa.array([[{"ids": s["ids"], "log_prob": s["log_prob"], "log_inclusion": s["log_inclusion"]} for s in g["samples"]] for g in got],
                                 pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())])))],
                        ["doc_id", "text", "best", "samples"])
                begin, held = j, len(texts[j]) if j < len(texts) else 0
    return run


def op4_gumbel_topk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
