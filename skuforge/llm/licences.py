"""Licence scan: a trained paragraph classifier with template comparison. Built-in functions only.

A paragraph is a run of lines between blank ones, joined without comment marks; its single lines are
judged as well, and a paragraph whose family one of its lines shows already is no further notice. Features are the word unigrams and bigrams that occur in a licence template
(all others weigh nothing), each 1 / sqrt(n-grams of the paragraph). A multinomial logistic regression
over the licence families and an unknown class is fitted by gradient descent on shortened templates,
hard negatives, and a bounded sample of NEGATIVES corpus paragraphs without a marker word. One row
holds this bounded training set and one aggregate() runs the descent, so fitting is one small task.
The unknown class is calibrated: a family must beat both FLOOR and the highest family probability that
was seen on rows of the unknown class. A prediction is confirmed by comparison with the family's templates: at
least CONFIRM of a template's n-grams must be in the paragraph. Of a short form all of them must, and be
SHORT_SHARE of the paragraph's.

Every paragraph that any template can confirm is scored: of a template with k n-grams, r of them asked
for, any k - r + 1 are anchors, and a paragraph without an anchor has too few n-grams of every template.
The rarest n-grams of the sample are taken. Their words are one pattern that a text, and then a paragraph or line, must have before its
n-grams are worked out. The model reaches the scan as a scalar subquery of fixed
size. The scan is one pass without a shuffle or join.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import table
from skuforge.llm.quality import let
from skuforge.plans.results import written

NEGATIVES = 200
ROUNDS = 150
RATE = 20.0
FLOOR = 1 / 3
CONFIRM = 0.6
SHORT_SHARE = 0.25
UNKNOWN = "unknown"
#: Words that keep a line out of the sample of the unknown class.
MARKERS = ("licen", "copyright", "permission", "redistribution", "public domain", "spdx")

# Licence families and short forms of their notices.
TEMPLATES = {
    "agpl-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS."),
    "bsd": (
        "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("Released into the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": (
        "Released under the MIT License.", "SPDX-License-Identifier: MIT", "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("Copyright. All rights reserved. No part of this work may be reproduced without written permission.", "Proprietary and confidential. Unlicensed copying is prohibited."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
#: Notices of a few words.
SHORT_FORMS = {
    "agpl-3.0": ("AGPLv3", "AGPL-3.0", "GNU AGPL"),
    "apache-2.0": ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"),
    "bsd": ("BSD License", "BSD-3-Clause", "BSD-2-Clause"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0"),
    "cc0": ("CC0", "CC0 1.0"),
    "gpl": ("GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0", "GNU GPL", "GNU General Public License"),
    "isc": ("ISC License",),
    "lgpl": ("LGPLv3", "LGPLv2.1", "LGPL-3.0", "LGPL-2.1", "GNU LGPL", "GNU Lesser General Public License"),
    "mit": ("MIT License", "The MIT License (MIT)"),
    "mpl-2.0": ("MPL-2.0", "Mozilla Public License 2.0"),
    "proprietary": ("All rights reserved.",),
    "unlicense": ("The Unlicense",),
}
HARD_NEGATIVES = (
    "He lost his driving license in version two of the story.", "The permission of the owner was never asked.", "She studies copyright law at the university.",
    "A licensed dealer released the software to the public.", "The work was granted a prize by the general public.", "The library is free of charge for any person.",
    "Public domain books are read in the following conditions.", "All rights and duties are listed in the terms of the lease.", "The license plate of the car was free of rust.",
    "Redistribution of wealth was the subject of the debate.", "The apache helicopter is under repair, version unknown.", "Common attribution errors are listed in the work.",
)
CLASSES = (*TEMPLATES, UNKNOWN)


def grams(paragraph: Column) -> Column:
    """Hashes of the distinct word unigrams and bigrams of lowered text."""
    words = F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rest = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return let(words, lambda w: F.array_distinct(F.concat(
        F.transform(w, lambda a: F.xxhash64(a)),
        F.zip_with(F.slice(w, F.lit(1), rest(w)), F.slice(w, F.lit(2), rest(w)), lambda a, b: F.xxhash64(a, b)))))


def known(all_grams: Column, vocabulary: Column) -> Column:
    """Numbers of the n-grams that the vocabulary has; 0 is the bias."""
    return F.concat(F.array(F.lit(0)), F.transform(F.array_intersect(all_grams, vocabulary), lambda g: F.array_position(vocabulary, g).cast("int")))


def margins(weights: Column, numbers: Column, scale: Column) -> Column:
    """Of each class the sum of the weights of the n-grams, and the bias in full."""
    return let(numbers, lambda n: let(F.slice(n, F.lit(2), F.size(n)), lambda rest: F.transform(
        weights, lambda w: F.aggregate(rest, F.get(w, F.lit(0)), lambda s, g: s + scale * F.get(w, g)))))


def softmax(v: Column) -> Column:
    powers = let(v, lambda u: let(F.array_max(u), lambda top: F.transform(u, lambda x: F.exp(x - top))))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(e, lambda x: x / t)))


def marked(paragraph: Column) -> Column:
    low = F.lower(paragraph)
    short = (t.lower().rstrip(".") for family in SHORT_FORMS.values() for t in family)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in (*MARKERS, *short)))


def paragraphs(lines: Column) -> Column:
    """Array of struct(line, n, text) of the runs of n lines that are not empty."""
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    empty = lambda i: F.coalesce(F.get(lines, i), F.lit("")) == ""
    return F.zip_with(
        F.filter(at, lambda i: ~empty(i) & empty(i - 1)), F.filter(at, lambda i: ~empty(i) & empty(i + 1)),
        lambda a, b: F.struct(a.alias("line"), (b - a + 1).alias("n"), F.array_join(F.slice(lines, a + 1, b - a + 1), " ").alias("text")))


def asked(k: Column, short: Column) -> Column:
    """Of a template's k n-grams those that a paragraph must have."""
    return F.when(short, k).otherwise(F.ceil(CONFIRM * k - 1e-9).cast("int"))


def model(docs: DataFrame, negatives: int = NEGATIVES, rounds: int = ROUNDS) -> DataFrame:
    """One row: vocabulary, weights (class x n-gram), threshold, templates (class, n-grams, short), anchors."""
    spark = docs.sparkSession
    total = docs.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("licence")), F.lit(1 << 20)) < min(1.0, 4 * negatives / max(1, total)) * (1 << 20)
    lines = docs.where(part).select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text")).where(F.trim("text") != "").where(~marked(F.col("text")))
    plain = lines.distinct().orderBy(F.xxhash64("text"), "text").limit(negatives).select(F.lit(len(CLASSES) - 1).alias("y"), "text", F.lit(False).alias("whole"), F.lit(False).alias("short"))
    fixed = [(y, t, True, False) for y, family in enumerate(TEMPLATES) for t in TEMPLATES[family]] + [(len(CLASSES) - 1, t, False, False) for t in HARD_NEGATIVES]
    fixed += [(y, t, True, True) for y, family in enumerate(TEMPLATES) for t in SHORT_FORMS[family]]
    base = spark.createDataFrame(fixed, "y int, text string, whole boolean, short boolean")
    # a template also teaches without its first or last fifth
    words = F.split("text", " ")
    fifth = F.greatest(F.lit(1), (F.size(words) / 5).cast("int"))
    short = base.where("whole and not short").select("y", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.size(words) - fifth), " "), F.array_join(F.slice(words, fifth + 1, F.size(words)), " "))).alias("text"), F.lit(False).alias("whole"), F.lit(False).alias("short"))
    rows = base.union(short).union(plain).withColumn("g", grams(F.col("text"))).where(F.size("g") > 0)
    one = written(rows.agg(
        F.array_sort(F.collect_list(F.struct("y", "g"))).alias("rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("whole"), F.col("g")))))).alias("vocabulary"),
        F.array_sort(F.collect_list(F.when(F.col("whole"), F.struct("y", "g", "short")))).alias("templates")), "licence-training")
    k = len(CLASSES)
    one = written(one.withColumn("x", F.transform("rows", lambda r: F.struct(
        r["y"].alias("y"), known(r["g"], F.col("vocabulary")).alias("numbers"), (1 / F.sqrt(F.size(r["g"]))).alias("scale")))), "licence-rows")
    # of each n-gram the training rows that have it
    one = written(one.withColumn("having", F.transform(F.sequence(F.lit(0), F.size("vocabulary")), lambda g: F.filter(
        F.transform("x", lambda r, i: F.when(F.array_contains(r["numbers"], g), i)), lambda i: i.isNotNull()))), "licence-index")
    n = F.size("x")
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.transform("having", lambda h: F.lit(0.0)))

    def descend(w: Column, _: Column) -> Column:
        errors = F.transform("x", lambda r: F.transform(softmax(margins(w, r["numbers"], r["scale"])), lambda p, c: p - F.when(c == r["y"], 1.0).otherwise(0.0)))
        return let(errors, lambda e: F.transform(w, lambda row, c: F.transform(row, lambda v, g: v * 0.999 - RATE / n * F.aggregate(
            F.get("having", g), F.lit(0.0), lambda s, i: s + F.get(F.get(e, i), c) * F.when(g == 0, 1.0).otherwise(F.get("x", i)["scale"])))))

    one = written(one.withColumn("weights", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, descend)), "licence-weights")
    # the highest family probability on a row of the unknown class
    seen = F.transform(F.filter("x", lambda r: r["y"] == k - 1), lambda r: F.array_max(F.slice(softmax(margins(F.col("weights"), r["numbers"], r["scale"])), F.lit(1), F.lit(k - 1))))
    # each n-gram with the rows of the unknown class that have it; of each template the rarest
    common = F.transform("vocabulary", lambda g: F.struct(F.size(F.filter("rows", lambda r: (r["y"] == k - 1) & F.array_contains(r["g"], g))).alias("n"), g.alias("g")))
    one = written(one.withColumn("common", F.array_sort(common)), "licence-common")
    rarest = F.transform("templates", lambda t: F.slice(F.filter(F.transform("common", lambda c: c["g"]), lambda g: F.array_contains(t["g"], g)), F.lit(1), F.size(t["g"]) - asked(F.size(t["g"]), t["short"]) + 1))
    one = one.withColumn("anchors", F.array_distinct(F.flatten(rarest)))
    return written(one.select(F.struct("vocabulary", "weights", F.greatest(F.lit(FLOOR), F.array_max(seen)).alias("threshold"), "templates", "anchors").alias("model")), "licence-model")


def anchor_pattern(fitted: DataFrame) -> str:
    """Pattern that lowered text with an anchor has: the word, or both words with anything but letters and digits between them and,
    before the second at the start of a line, a comment mark that paragraphs leave out."""
    forms = (re.findall("[a-z0-9]+", t.lower()) for family in (*TEMPLATES.values(), *SHORT_FORMS.values()) for t in family)
    named = sorted({(a, b) for w in forms for a, b in zip([*w, *w], [*([""] * len(w)), *w[1:]])})
    own = F.when(F.col("b") == "", F.xxhash64("a")).otherwise(F.xxhash64("a", "b"))
    rows = fitted.sparkSession.createDataFrame(named, "a string, b string").join(fitted.select(F.explode("model.anchors").alias("g")), own == F.col("g"), "left_semi").collect()
    after: dict[str, set[str]] = {}
    for r in rows:
        after.setdefault(r["a"], set()).add(r["b"])
    gap = r"[^\p{L}\p{N}]+"
    by_start: dict[str, list[str]] = {}
    for a, seconds in sorted(after.items()):
        by_start.setdefault(a[0], []).append(a[1:] + ("" if "" in seconds else f"{gap}(?:(?:rem|dnl){gap})?(?:{'|'.join(sorted(seconds))})"))
    if not by_start:
        return "(?!)"
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_start.items()) + r")(?![\p{L}\p{N}])"


def judge(paragraph: Column, m: Column) -> Column:
    """struct(family, probability, match): the family, or unknown."""
    k = len(CLASSES)

    def of(g: Column) -> Column:
        return let(softmax(margins(m["weights"], known(g, m["vocabulary"]), 1 / F.sqrt(F.size(g)))), lambda p: let(
            F.array_max(F.transform(F.slice(p, F.lit(1), F.lit(k - 1)), lambda x, i: F.struct(x.alias("p"), (-i).alias("c")))), lambda top: let(
                F.coalesce(F.array_max(F.transform(F.filter(m["templates"], lambda t: t["y"] == -top["c"]), lambda t: let(
                    F.size(F.array_intersect(t["g"], g)), lambda n: F.when(~t["short"], n / F.size(t["g"])).when((n == F.size(t["g"])) & (n >= SHORT_SHARE * F.size(g)), 1.0)))), F.lit(0.0)),
                lambda match: F.struct(
                    F.when((top["p"] > m["threshold"]) & (match >= CONFIRM), F.get(F.array(*[F.lit(c) for c in CLASSES]), -top["c"])).otherwise(F.lit(UNKNOWN)).alias("family"),
                    top["p"].alias("probability"), match.alias("match")))))

    return let(grams(paragraph), of)


def scan(docs: DataFrame, fitted: DataFrame) -> DataFrame:
    """docs (text and other columns but `licences`) with `licences`: array of struct(line, family,
    probability, match) of the paragraphs with an anchor (line: their first) and, of those with more than
    one line, the lines with an anchor; unknown ones included.

    Null and empty texts have none.
    """
    pattern = anchor_pattern(fitted)
    held = F.when(F.lower("text").rlike(pattern), F.col("text")).otherwise(F.lit(""))
    # marks of other characters than letters and digits are no words, so they need no stripping
    lines = F.transform(F.split(held, "\n"), lambda t: F.when(t.rlike(r"[\p{L}\p{N}]"), F.regexp_replace(t, r"^\s*(?:(?i:rem|dnl)\s)?", "")).otherwise(F.lit("")))
    anchored = lambda s: F.lower(s["text"]).rlike(pattern) & F.arrays_overlap(grams(s["text"]), F.col("_anchors"))
    own = lambda s: F.filter(F.transform(F.slice(F.col("_lines"), s["line"] + 1, F.when(s["n"] > 1, s["n"]).otherwise(0)), lambda t, i: F.struct(
        (s["line"] + i).alias("line"), F.lit(0).alias("n"), t.alias("text"))), anchored)
    judged = F.transform("_candidates", lambda s: let(judge(s["text"], F.col("_model")), lambda j: F.struct(
        s["line"].alias("line"), j["family"].alias("family"), j["probability"].alias("probability"), j["match"].alias("match"), s["n"].alias("n"))))
    shown = lambda r: F.exists("_judged", lambda o: (o["n"] == 0) & (o["family"] == r["family"]) & (o["line"] >= r["line"]) & (o["line"] < r["line"] + r["n"]))
    found = F.transform(F.filter("_judged", lambda r: (r["family"] == UNKNOWN) | ~shown(r)), lambda r: F.struct(
        *[r[c].alias(c) for c in ("line", "family", "probability", "match")]))
    rows = docs.withColumn("_anchors", fitted.select("model.anchors").scalar()).withColumn("_lines", lines)
    rows = rows.withColumn("_hot", F.filter(paragraphs(F.col("_lines")), anchored))
    rows = rows.withColumn("_candidates", F.flatten(F.transform("_hot", lambda s: F.concat(F.array(s), own(s)))))
    rows = rows.withColumn("_model", fitted.scalar()).withColumn("_judged", judged)
    return rows.withColumn("licences", found.cast("array<struct<line:int,family:string,probability:double,match:double>>")).drop("_anchors", "_lines", "_hot", "_candidates", "_model", "_judged")


def op8_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, model(docs))
    named = F.filter("licences", lambda x: x["family"] != UNKNOWN)
    return found.select(
        "doc_id", F.size("licences").alias("n_candidates"), F.size(named).alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(named, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform(named, lambda x: F.round(x["probability"], 6))), F.lit(0.0)).alias("probability"))
