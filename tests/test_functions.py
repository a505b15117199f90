"""Scalar expressions, similarity against brute force, sources."""

import random

import pytest
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.functions import similarity, text, units
from skuforge.operators.resolve import deciding_keywords, with_fuzzy_row
from skuforge.sources import feed as fd

C = F.col


def values(spark, build, *rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, a string" + (", b string" if isinstance(rows[0], tuple) else ""))
    return [r[0] for r in df.orderBy("i").select(build).collect()]


def test_trade_fraction(spark):
    got = values(spark, units.trade_fraction(C("a")), "50.25", "0.25", "24.0", "0.5", "0.045", "6.5", "0.094", "24d", "", None, "-0.5", "1e3")
    assert got == ["50-1/4", "1/4", "24", "1/2", "0.045", "6-1/2", "3/32", "24d", "", "", "-0.5", "1000"]


def test_units(spark):
    assert values(spark, units.standardize_uom(C("a")), "inches", "IN.", "volts", "amps", "dba", "lbs", "Zork ", None) == ["in", "in", "V", "A", "dBA", "lb", "Zork", ""]
    assert values(spark, units.normalize_uom(C("a")), "24in", "120v", "47dba", "1.5GPM", "feet", "0.5in") == ["24 in", "120 V", "47 dBA", "1.5 gpm", "ft", "1/2 in"]
    assert values(spark, units.format_measurement(C("a"), C("b")), ("50.25", "in"), ("15", "amps"), ("24", "in"), ("x", "in"), ("2.50", ""), ("", "in")) == [
        "50-1/4 in", "15 A", "24 in", "x in", "2-1/2", ""]
    assert values(spark, units.std_dimensions(C("a")), '12"x20mm', "3/4x60'", "Box", "plain") == ["12 in x 20 mm", "3/4 in x 60 ft", "Bo x ", "plain"]
    assert values(spark, units.fraction_to_double(C("a")), "1-1/4", "5/16", ".5", "1/0", "x") == [1.25, 0.3125, 0.5, None, None]
    assert values(spark, units.fraction_16ths(C("a")), "1.5", "0.0625", "0.3", "x") == ["1-1/2", "1/16", "0.3", "x"]


def test_cleaning(spark):
    assert values(spark, text.clean_supplier(C("a")), "Freud Inc (2435)", "-- Unbranded --", "Acme (A) (B)", "(X)", None) == ["Freud Inc", None, "Acme (A)", None, None]
    assert values(spark, text.clean_desc(C("a")), "A SS - Display Only", '5""x.045""  y', "N/A", "a “b” ’c’\t\td") == ["A SS", '5"x.045" y', "", "a \"b\" 'c' d"]


def test_deciding_keywords_keep_every_decision():
    groups = [["laser level", "laser"], ["cross line laser", "blade"], ["saw blade", "saw"]]
    kept = deciding_keywords(groups)
    assert kept == [["laser"], ["blade"], ["saw"]]

    def first(gs, t):
        return next((i for i, g in enumerate(gs) if any(k in t for k in g)), None)

    rnd = random.Random(1)
    words = [w for g in groups for w in g] + ["x", " "]
    for _ in range(300):
        t = "".join(rnd.choice(words) for _ in range(4))
        assert first(groups, t) == first(kept, t)


def test_prefix_tree_search_equals_keyword_scan(spark):
    table = {kw: i for i, r in enumerate(rules.TAXONOMY) for kw in r.keywords}
    rnd = random.Random(2)
    pieces = list(table) + ["steel", "profile", "sealed", "zz", "1"]
    texts = ["".join(rnd.choice(pieces)[: rnd.randint(2, 12)] + rnd.choice(["", " "]) for _ in range(4)) for _ in range(400)]
    got = values(spark, F.expr(text.first_rank("a", table)), *texts)
    want = [min((i for kw, i in table.items() if kw in t), default=None) for t in texts]
    assert got == want


def test_whole_word_tokens_equal_regex_scan(spark):
    import re

    rnd = random.Random(3)
    pieces = [t for t, _ in rules.MATERIALS] + ["stainlesssteel", "x", "cast-iron", "fir."]
    texts = [rnd.choice(["", "-"]).join([" ".join(rnd.choice(pieces) for _ in range(3)), ""]) for _ in range(300)]
    got = values(spark, text.first_token("a", rules.MATERIALS), *texts)
    want = [next((v for t, v in rules.MATERIALS if re.search(rf"\b{re.escape(t)}\b", x)), None) for x in texts]
    assert got == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, other in enumerate(b):
            new.append(row[j] + 1 if ch == other else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return (1 - (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b))) * 100 if a or b else 100.0


def test_similarity_equals_brute_force(spark):
    rnd = random.Random(4)
    names = [r.manufacturer for r in rules.CATALOG] + ["", "a", "Freud Inc", "é ü", "x" * 90]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(150)]
    got = values(spark, similarity.token_sort_ratio(C("a"), C("b")), *pairs)
    assert got == pytest.approx([brute(a, b) for a, b in pairs])
    assert got[0] is not None


def test_fuzzy_row_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = ["Freud Inc"]
    for r in rules.CATALOG:
        for _ in range(6):
            chars = list(r.manufacturer)
            for _ in range(rnd.randint(0, 9)):
                chars[rnd.randrange(len(chars))] = rnd.choice("abc, Inc.LCX ")
            texts.append("".join(chars))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string")
    long_name = rules.CatalogRow("An Extraordinarily Long Manufacturer Name Of More Than Sixty Characters, Incorporated", "Long", ())
    catalog = [*rules.CATALOG, long_name]
    got = [r[0] for r in with_fuzzy_row(df, C("a"), "row", catalog).orderBy("i").select("row").collect()]
    for value, row in zip(texts, got):
        sims = [brute(value, r.manufacturer) / 100 for r in catalog]
        best = max(sims)
        want = sims.index(best) if best >= 0.70 else None
        assert row == want, (value, row, want)


def test_feed_file(spark, tmp_path):
    head = "Mfg_Part_Num,Part_Desc,E1_Brand,Unilog_Brand,DIB_Brand,Part_Manuf"
    good = tmp_path / "good.csv"
    good.write_bytes(("﻿" + head.lower() + '\r\n0012,"5""x7"" a, b",,,,Acme\r\nA2,short\r\nA3,"two\nlines",,,,M,extra\r\n').encode())
    rows = fd.with_row_ids(fd.read_feed(spark, str(good))).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [1, 2, 3]
    assert rows[0]["Mfg_Part_Num"] == "0012" and rows[0]["Part_Desc"] == '5"x7" a, b'
    assert rows[1]["Part_Manuf"] == "" and rows[2]["Part_Desc"] == "two\nlines"
    for name, content, message in (
        ("dup.csv", head + ",part_desc\na,b,c,d,e,f,g\n", "duplicate"), ("missing.csv", "Mfg_Part_Num,Part_Desc\na,b\n", "missing"),
        ("head.csv", head + "\n", "no data"), ("empty.csv", "", "empty"),
    ):
        (tmp_path / name).write_text(content)
        with pytest.raises(fd.FeedError, match=message):
            fd.read_feed(spark, str(tmp_path / name))


def test_token_sort_ratio_of_any_length(spark):
    """Columns and constant names below, at and beyond one, two and several words of the scan."""
    import random

    from pyspark.sql import functions as F

    from skuforge.functions import similarity

    r = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rows = [(None, None), ("", ""), ("a", ""), (None, "x"), ("b a", "a  b"), ("\x1ca\x85b", "b a"), ("é😀x", "😀é")]
    for n in (5, 59, 60, 61, 119, 120, 121, 400):
        rows += [tuple("".join(r.choice("abcde fé😀") for _ in range(r.randrange(n // 2, n + 1))) for _ in range(2)) for _ in range(4)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.token_sort_ratio(F.col("a"), F.col("b")).alias("s"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    for x in df.collect():
        a, b = (" ".join(sorted((t or "").split())) for t in (x["a"], x["b"]))
        total = len(a) + len(b)
        assert x["s"] == pytest.approx((1.0 - (total - 2 * lcs(a, b)) / total) * 100 if total else 100.0)
    names = ["".join(r.choice("abcde") for _ in range(n)) for n in (10, 59, 60, 61, 100, 130)]
    given = spark.createDataFrame([(n[1:] + "q",) for n in names], "s string").withColumn("c", F.split("s", ""))
    for x in given.select("s", *[F.expr(similarity._lcs_with_name("c", n)).alias(f"l{i}") for i, n in enumerate(names)]).collect():
        assert [x[f"l{i}"] for i in range(len(names))] == [lcs(x["s"], n) for n in names]
