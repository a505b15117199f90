r"""Quality rules: hashed n-gram log-likelihood ratio between trusted documents and the whole corpus.

Words are taken as they stand; unigrams and bigrams are hashed into buckets. Two multinomials over the
buckets are counted over every document, an n-gram once a document, so that a text that repeats itself has one voice: one of
the trusted target (documents that all their label rows call good and not toxic), one of the raw corpus. The target is smoothed by
PRIOR counts spread as in the raw corpus, so n-grams too rare to tell weigh nothing. A document's score is
the mean log ratio of its n-grams. It is rejected below THRESHOLD, and also if SEVERE n-grams or more have a ratio
below SEVERE_RATIO: words that trusted documents avoid (abuse) are few in a long text and vanish in its mean. Both are fixed,
so a document's fate depends on its text and the two models alone.

The number of buckets follows the counted n-grams up to MOST_BUCKETS. What else falls into an n-gram's bucket is, as a share of the
documents, at most (n-grams of a document) / buckets, whatever the size of the corpus, so n-grams more frequent than that are
told apart at any size. Built-in functions only: the counts are one hash aggregate by bucket; the ratios come back as a scalar subquery of
4 bytes a bucket, and scoring needs no shuffle.

Base rules: a document fails with fewer than 20 words, or if more than 30 of 100 words lie in 8-word
windows that occur twice or more in it. Windows are compared by 64-bit hash inside one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import free, table
from skuforge.operators.stages import sealed
from skuforge.plans.results import written

#: Bound of what is broadcast, 4 bytes each.
MOST_BUCKETS = 1 << 20
#: Buckets of one inner array of the ratios.
PART = 1 << 12
PRIOR = 16.0
THRESHOLD = -0.06
SEVERE_RATIO = -1.0
SEVERE = 2
#: Trusted ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of non-space characters; null has none."""
    bare = F.btrim(text, F.lit("\x20\t\n\x0b\x0c\r"))
    return F.when(bare != "", F.split(bare, SPACE)).otherwise(F.expr("cast(array() as array<string>)"))


def neighbours(h: Column, apart: int) -> Column:
    """Hashes of each element with the one `apart` places on."""
    rest = F.greatest(F.size(h) - apart, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(1 + apart), rest), lambda a, b: F.xxhash64(a, b))


def grams(w: Column) -> Column:
    """64-bit hashes of all unigrams and bigrams."""
    return F.concat(F.transform(w, lambda a: F.xxhash64(a)), neighbours(w, 1))


def repeated_words(pairs: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, from the hashes of its word pairs."""
    window = WINDOW

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            hits = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
            at = F.array_sort(F.transform(hits, lambda e: e["i"]))
            return F.aggregate(
                at, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
                lambda s, p: F.struct((s["n"] + p + window - F.greatest(p, s["end"])).alias("n"), (p + window).alias("end")), lambda s: s["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(ranked, flagged))

    return let(neighbours(pairs, 2), lambda fours: let(neighbours(fours, 4), covered))


def figures(text: Column, ratios: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long; llr: double; n_severe: int).

    ratios: array of arrays of PART log ratios. llr is the mean log ratio of the n-grams, 0 for a text without words.
    """
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(ratios: Column, w: Column, pairs: Column) -> Column:
        buckets = F.size(ratios) * PART
        at = lambda h: let(F.pmod(h, buckets).cast("int"), lambda b: F.get(F.get(ratios, F.shiftright(b, 12)), b.bitwiseAND(PART - 1)))
        score = let(F.concat(F.transform(w, lambda a: at(F.xxhash64(a))), F.transform(pairs, at)), lambda r: F.struct(
            (F.aggregate(r, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(r), F.lit(1))).alias("llr"), F.size(F.filter(r, lambda x: x < SEVERE_RATIO)).alias("n_severe")))
        return let(score, lambda r: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(pairs).alias("n_repeat_words"),
            F.when(F.size(w) == 0, F.lit(0.0)).otherwise(r["llr"]).alias("llr"), r["n_severe"].alias("n_severe")))

    # ratios has one reader: the optimizer merges a projection with one reader into the next, others would copy all ratios into every row
    return let(ratios, lambda r: let(words(t), lambda w: let(neighbours(w, 1), lambda pairs: of(r, w, pairs))))


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of documents that every label row calls good and not toxic."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0").select("doc_id")


def log_ratios(docs: DataFrame, target: DataFrame, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """One row: array of arrays of PART log ratios, by bucket. Counts cover every document and all its n-grams."""
    spark, target = docs.sparkSession, written(target, "quality-target")
    ids = target.select("doc_id", F.lit(1).alias("hit"))
    ids = F.broadcast(ids) if target.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    counts = (
        # explode_outer: explode would have the array worked out again to test that it is not empty
        marked.select(F.coalesce("hit", F.lit(0)).alias("hit"), let(words(F.col("text")), lambda w: F.array_distinct(grams(w))).alias("grams"))
        .select("hit", F.explode_outer("grams").alias("h")).where("h is not null")
        .groupBy(F.pmod("h", F.lit(most_buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.sum("hit").alias("hit"))
    )
    counts = written(counts, "quality-counts")
    found = counts.agg(F.count("*"), F.sum("raw"), F.sum("hit")).first()
    # a power of two that divides most_buckets, so counts of small corpora fold
    buckets = min(most_buckets, max(PART, 1 << (4 * found[0]).bit_length()))
    folded = counts.groupBy((F.col("bucket") % buckets).alias("bucket")).agg(F.sum("raw").alias("raw"), F.sum("hit").alias("hit"))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(folded, "bucket", "left").na.fill(0)
    # without a trusted document the ratio says nothing
    share = (found[2] or 0) / (found[1] or 1)
    ratio = F.log((F.col("hit") + PRIOR) / (F.col("raw") * share + PRIOR)) if share else F.lit(0.0)
    parts = every.groupBy(F.shiftright("bucket", 12).alias("part")).agg(F.sort_array(F.collect_list(F.struct("bucket", ratio.cast("float").alias("ratio"))))["ratio"].alias("ratios"))
    return written(parts.agg(F.sort_array(F.collect_list(F.struct("part", "ratios")))["ratios"].alias("ratios")), "quality-ratios")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_buckets: int = MOST_BUCKETS, name: str = "quality") -> DataFrame:
    """docs with a struct column `name`: the base figures, base_failed, llr, n_severe and kept.

    docs: doc_id, text and any other columns but `name`. Null and blank texts fail the base rules. Repeated rows are judged alike.
    A document is rejected if it fails the base rules, its mean log ratio is below the threshold or SEVERE of its n-grams are below SEVERE_RATIO.
    """
    ratios = log_ratios(docs, trusted(labels), most_buckets)
    held = free("_ratios", docs.columns)
    found = free("_figures", [*docs.columns, held])
    # the subquery stands below the lambdas, where the optimizer merges it into the same projection, see figures()
    out = docs.withColumn(held, ratios.scalar()).withColumn(found, figures(F.col("text"), F.col(held))).drop(held)
    f = F.col(found)
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEATED * f["n_words"])
    # sealed: a caller's filter on the verdict, pushed down to the scan, would work out the figures once for each field that it names
    return sealed(out.withColumn(name, F.struct(
        *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), f["llr"].alias("llr"), f["n_severe"].alias("n_severe"),
        (~failed & (f["llr"] >= threshold) & (f["n_severe"] < SEVERE)).alias("kept"))).drop(found), "quality")


def op1_quality_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "quality.*")
