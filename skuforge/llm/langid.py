"""Language identification of mixed-language text.

A word is a run of letters. Its script (Unicode ranges) narrows the languages to those that use the
script in the training rows; their scores are sums of character n-gram log probabilities. Viterbi
over the words, with a penalty for each switch, gives every word a language, and runs of one language
are the spans. A document's language is the one that holds most of its letters.

Training: n-gram counts of labelled rows, by Spark; the rows are a hash sample of about `sample_docs`
(all, if there are fewer), whole texts. The model has `buckets` x languages numbers. Prediction is one
pass without a shuffle; each batch scores its distinct words once.

Viterbi is skipped where it cannot switch: if no stretch of words gains more than half the penalty in
another language over the best single one, the constant path is the best path.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import encoded, mix, small_batches, table

BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000
PENALTY = 24.0
OUTSIDE = -40.0  # a word in a script that the language does not use
SCRIPT_SHARE = 0.01
# word characters of Unicode that are numbers but no decimal digits, such as fractions and Roman numerals
NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and unicodedata.category(c) in ("Nl", "No"))
# these numbers, and all characters beyond the basic plane: a class of many of the latter is tried member by member
PERHAPS = re.compile(f"[{''.join(sorted(c for c in NUMBERS if c <= '\uffff'))}\U00010000-\U0010ffff]")
RUNS = re.compile(r"[^\W\d_]+")
UND = "und"

# First code point of each script range, in order; "other" fills the gaps.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB07, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFDD, "other"), (0x20000, "han"), (0x32000, "other"),
)
_NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS], np.uint32)
_IDS = np.array([_NAMES.index(s) for _, s in SCRIPTS])


def letter_runs(text: str) -> list[str]:
    """Runs of letters; numbers end a run."""
    return RUNS.findall(text if text.isascii() else PERHAPS.sub(lambda m: " " if m[0] in NUMBERS else m[0], text))


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: bucket and word number of each 1-, 2- and 3-gram (with the word's ends), scripts."""
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = c == 32
    word = np.cumsum(gap) - 1
    scripts = _IDS[np.searchsorted(_STARTS, c[np.flatnonzero(gap)[:-1] + 1].astype(np.uint32), "right") - 1]
    k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    one, two = c[:-1] * k1, (c[:-1] * k1 + c[1:]) * k2
    three = ((c[:-2] * k1 + c[1:-1]) * k2 + c[2:]) * k1 + np.uint64(3)
    at1, at2 = np.flatnonzero(~gap[:-1]), np.flatnonzero(~(gap[:-1] & gap[1:]))
    at3 = np.flatnonzero(~gap[1:-1])
    keys = np.concatenate([one[at1] + np.uint64(1), two[at2] + np.uint64(2), three[at3]])
    owner = np.concatenate([word[at1], word[at2], word[at3]])
    order = np.argsort(owner, kind="stable")
    return (mix(keys[order]) % np.uint64(buckets)).astype(np.int64), owner[order], scripts


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Languages, their log probabilities by bucket, and which scripts each uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        self.log_p = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))).astype(np.float32)
        self.uses = scripts / np.maximum(1, scripts.sum(0)) >= SCRIPT_SHARE  # script x language

    def scores(self, words: list[str]) -> np.ndarray:
        """word x language; 0 in all languages for a script that none uses."""
        bucket, owner, script = grams(words, len(self.log_p))
        out = np.add.reduceat(self.log_p[bucket], np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
        fits = self.uses[script]
        out = np.where(fits, out, OUTSIDE + out.min(1, keepdims=True))
        out[~fits.any(1)] = 0
        return out - out.max(1, keepdims=True)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, buckets: int = BUCKETS) -> Model:
    """Model from docs (text, lang, doc_id); rows without text or lang teach nothing."""
    small_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null")
    total = rows.count()
    share = min(1.0, sample_docs / max(1, total))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                by_lang.setdefault(lang, []).extend(letter_runs(text.decode().lower()))
            out: list[list] = [[], [], []]
            for lang, words in by_lang.items():
                if words:
                    bucket, _, script = grams(words, buckets)
                    keys, n = np.unique(np.concatenate([bucket, buckets + script]), return_counts=True)
                    out[0] += [lang] * len(keys)
                    out[1] += keys.tolist()
                    out[2] += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["lang", "key", "n"])

    seen = rows.select("lang", "text").mapInArrow(count, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(seen["lang"].unique())
    counts = np.zeros((buckets + len(_NAMES), len(langs)))
    counts[seen["key"].to_numpy(np.int64), np.searchsorted(langs, seen["lang"].to_numpy(str)) if langs else []] = seen["n"].to_numpy(float)
    return Model(langs, counts[:buckets], counts[buckets:])


def label(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best language of each word: highest sum of scores less the penalty for each switch."""
    best = int(scores.sum(0).argmax())
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, best:best + 1], axis=0, out=gain[1:])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(len(scores), best)
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        at, least = value.index(top), top - penalty
        back.append([k if v >= least else at for k, v in enumerate(value)])
        value = [s + (v if v >= least else least) for s, v in zip(row, value)]
    state = value.index(max(value))
    path = [state]
    for row in reversed(back):
        state = row[state]
        path.append(state)
    return np.array(path[::-1])


SCHEMA = "lang string, score double, spans array<struct<lang:string,begin:int,end:int>>"


def predict_batch(model: Model, texts: list[str | None], penalty: float = PENALTY) -> list[tuple]:
    """(language, share of the letters in it, spans in words) of each text."""
    found = [letter_runs(t.lower()) if t else [] for t in texts]
    number: dict[str, int] = {}
    ids = [[number.setdefault(w, len(number)) for w in ws] for ws in found]
    if not number or not model.langs:
        return [(UND, 0.0, [])] * len(texts)
    scores = model.scores(list(number))
    size = np.fromiter(map(len, number), np.int64, len(number))
    out = []
    for at in ids:
        if not at:
            out.append((UND, 0.0, []))
            continue
        at = np.array(at)
        path = label(scores[at], penalty)
        letters = np.bincount(path, weights=size[at], minlength=len(model.langs))
        top = int(letters.argmax())
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        out.append((model.langs[top], float(letters[top] / letters.sum()), [{"lang": model.langs[path[a]], "begin": a, "end": b} for a, b in zip(cuts, cuts[1:])]))
    return out


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """docs (text and any columns but `language`) with a struct `language` of SCHEMA.

    Null texts and texts without a letter are `und` with score 0 and no spans; so is everything if
    nothing was learned. Ties go to the language that sorts first.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def run(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            yield pd.DataFrame(predict_batch(shared.value, list(texts), penalty), columns=["lang", "score", "spans"])

    return docs.withColumn("language", run("text"))


def op3_script_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.size("language.spans").alias("n_spans"))
