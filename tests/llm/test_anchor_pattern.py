"""Licence scan: texts without the words of an anchor are left out before n-grams are made, and no other."""

import random

from pyspark.sql import functions as F

from skuforge.llm import licences


def test_the_pattern_finds_all_paragraphs_with_an_anchor(spark):
    docs = spark.createDataFrame([(i, f"plain line {i} of the work\nfree for any use in version {i}") for i in range(50)], "doc_id long, text string")
    fitted = licences.model(docs)
    pattern = licences.anchor_pattern(fitted)
    rnd = random.Random(3)
    words = [w for t in (*licences.TEMPLATES["gpl"], *licences.SHORT_FORMS["mit"], "a b é 7") for w in t.split()]
    gaps = [" ", "  ", "\n", "\nREM ", "\n  dnl\t", "\n# ", "\n\n", "-", "̇", "x"]
    texts = ["".join(rnd.choice(words).upper() + rnd.choice(gaps) for _ in range(rnd.randrange(1, 6))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # paragraphs of the lines as the scan makes them, judged by their n-grams alone
    lines = F.transform(F.split("text", "\n"), lambda t: F.when(t.rlike(r"[\p{L}\p{N}]"), F.regexp_replace(t, r"^\s*(?:(?i:rem|dnl)\s)?", "")).otherwise(F.lit("")))
    hot = rows.withColumn("lines", lines).withColumn("anchors", fitted.select("model.anchors").scalar()).withColumn("parts", licences.paragraphs(F.col("lines")))
    hot = hot.where(F.exists("parts", lambda s: F.arrays_overlap(licences.grams(s["text"]), F.col("anchors"))))
    want = {r["doc_id"] for r in hot.collect()}
    assert 50 < len(want) < 400
    assert {r["doc_id"] for r in licences.scan(rows, fitted).where(F.size("licences") > 0).collect()} == want
    assert want <= {r["doc_id"] for r in rows.where(F.lower("text").rlike(pattern)).collect()}
    plain = rows.where(~F.lower("text").rlike(pattern)).count()
    assert plain > 20
