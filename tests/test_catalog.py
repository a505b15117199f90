"""Catalog tables: keyword automaton, similarity search and the whole cascade against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.operators import catalog as ct
from skuforge.operators.normalize import normalize
from skuforge.plans.pipeline import run

RND = random.Random(2)
STEMS = ["".join(RND.choice("abcdeé") for _ in range(RND.randrange(2, 9))) for _ in range(40)]
CATALOG = [(i, " ".join(RND.choice(STEMS) for _ in range(RND.randrange(1, 4)))) for i in range(150)] + [(150, ""), (151, None), (152, "  "), (3, "long " * 40)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_similar(name, floor):
    best = None
    a = " ".join(sorted(name.split()))
    for pri, other in CATALOG:
        b = " ".join(sorted((other or "").split()))
        if a and b:
            sim = (1.0 - (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b))) * 100 / 100
            if sim >= floor and (best is None or (sim, -pri) > best):
                best = sim, -pri
    return best and (-best[1], round(best[0], 9))


@pytest.mark.parametrize("floor,block", [(0.7, 1 << 15), (0.7, 20), (0.4, 64), (1.0, 64)])
def test_most_similar_is_exact(spark, floor, block):
    names = [n for _, n in CATALOG] + [n[1:] + "x" for _, n in CATALOG if n] + [(n or "").upper() for _, n in CATALOG] + ["long " * 39, " ".join(STEMS[:3])]
    frame = spark.createDataFrame([(n, i) for i, n in enumerate(names * 2)], "name string, sim int")
    catalog = spark.createDataFrame([(p, n, "x") for p, n in CATALOG], "pri long, name string, tokens string")
    got = {r["name"]: (r["pri"], round(r["sim"], 9)) for r in ct.most_similar(frame, catalog, floor, block).collect()}
    assert got == {n: b for n in names if n and (b := brute_similar(n, floor))}


@pytest.mark.parametrize("chars", [1 << 20, 9])
def test_keywords_are_found_in_blocks(spark, chars):
    words = [("ab", 5), ("b", 9), ("abc", 1), ("ab", 4), ("", 0), (None, 0), ("zé", 2), ("no", 3)]
    texts = [None, "", "xxabx", "abc", "bbb", "éz zé", "no ab", "x"]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "k int, t string, pri int")
    table = spark.createDataFrame(words, "word string, pri long")
    hits = [sorted({min(p for v, p in words if v == w) for w, _ in words if w and t and w in t}) for t in texts]
    assert [r["o"] for r in ct.first_keyword(rows, "t", table, "o", chars).sort("k").collect()] == [min(h, default=None) for h in hits]
    assert [r["o"] for r in ct.every_keyword(rows, "t", table, "o", chars).sort("k").collect()] == hits
    assert ct.first_keyword(rows, "t", table.where("false"), "o").where("o is null").count() == len(texts)


def test_tables_answer_like_the_built_in_catalog(spark, results):
    feed = results.select("row_id", "raw.*")
    plain = {r["row_id"]: r["enriched"] for r in results.collect()}
    got = {r["row_id"]: r["enriched"] for r in run(feed, ct.catalog_tables(spark)).collect()}
    assert got == plain


def test_empty_tables(spark):
    empty = ct.CatalogTables(
        spark.createDataFrame([], "pri long, manufacturer string, brand string, keywords array<string>"),
        spark.createDataFrame([], "alias string, brand string"), spark.createDataFrame([], "pri long, distributor string, prefix string, manufacturer string"))
    feed = spark.createDataFrame([("a", "drill", "", "", "", "Acme (A1)"), ("b", "drill", None, None, None, None)], ", ".join(f"{c} string" for c in rules.REQUIRED_COLUMNS))
    rows = normalize(feed, empty).select("MANUFACTURER_NAME", "BRAND_NAME").sort(F.desc("MANUFACTURER_NAME")).collect()
    assert [tuple(r) for r in rows] == [("Unknown Manufacturer", "Unknown Brand"), ("Acme", "Acme")]


def test_plan_has_no_names(spark):
    catalog = spark.createDataFrame([(p, n) for p, n in CATALOG], "pri long, name string")
    plan = ct.most_similar(spark.createDataFrame([("a",)], "name string"), catalog)._jdf.queryExecution().toString()
    assert "levenshtein" not in plan and CATALOG[5][1] not in plan


def test_similar_names_are_dealt_over_tasks(spark, monkeypatch):
    """Names of few bytes end in one partition by size, however long each search takes; a later block keeps the best of an earlier one."""
    monkeypatch.setattr(ct, "PAIRS_A_TASK", 1000)
    names = spark.createDataFrame([(f"{n} {i}",) for i, (_, n) in enumerate(CATALOG) if n and n.strip()], "name string")
    catalog = spark.createDataFrame([(p, n) for p, n in CATALOG], "pri long, name string")
    found = ct.most_similar(names, catalog, 0.7).select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in found}) > 4
    assert {r["name"]: (r["pri"], round(r["sim"], 9)) for r in found} == {n: b for (n,) in names.collect() if (b := brute_similar(n, 0.7))}


def test_name_index_of_long_and_wide_texts():
    """Names beyond one 64-bit word and beyond the bits of the bitmap, with characters outside the BMP."""
    rnd = random.Random(8)
    names = sorted({"".join(rnd.choice("abcé𝔘") for _ in range(rnd.choice([5, 63, 64, 65, 130, 400]))) for _ in range(40)})
    index = ct.NameIndex([(n, i) for i, n in enumerate(names)], 0.5)
    for asked in [names[3], *(n[1:-1] + "x" for n in names)]:
        score = lambda n: (1.0 - (len(n) + len(asked) - 2 * lcs(n, asked)) / (len(n) + len(asked))) * 100 / 100
        assert index.best(asked) == max(((score(n), i) for i, n in enumerate(names)), key=lambda x: (x[0], -x[1]))


def test_many_keywords_take_one_pass(spark, monkeypatch):
    """Keyword tables beyond one automaton: the rows are written once, not once for each block, and pieces of equal hash bits are told apart."""
    passes, write = [], ct.written
    monkeypatch.setattr(ct, "written", lambda df, name: passes.append(name) or write(df, name))
    monkeypatch.setattr(ct, "SLOT_BITS", 10)
    monkeypatch.setattr(ct, "SCAN_CHARS", 50)
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abé𝔘 ") for _ in range(rnd.randrange(1, 9))) for _ in range(300)})
    texts = ["".join(rnd.choice("abé𝔘 ") for _ in range(rnd.randrange(0, 30))) for _ in range(120)] + [None, "", "a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "k int, t string")
    table = spark.createDataFrame([(w, i // 2) for i, w in enumerate(words)], "word string, pri long")
    hits = [sorted({i // 2 for i, w in enumerate(words) if t and w in t}) for t in texts * 2]
    assert [r["o"] for r in ct.every_keyword(rows, "t", table, "o", 64).sort("k").collect()] == hits
    assert [r["o"] for r in ct.first_keyword(rows, "t", table, "o", 64).sort("k").collect()] == [min(h, default=None) for h in hits]
    assert passes == ["keywords", "keyword-rows"] * 2
