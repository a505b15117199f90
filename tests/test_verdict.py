"""Rule lists in full, decisions with ties and unknown actions, the shared folder, the entry guard."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from skuforge import rules
from skuforge.operators import delivery, serve
from skuforge.operators.resolve import deciding_keywords
from skuforge.operators.taxonomy import classify
from skuforge.plans import results as tables
from skuforge.sources import feed as fd


def test_context_lists_are_complete():
    assert len(rules.FASTENER_WORDS) == 10 and len(rules.ABRASIVE_WORDS) == 16 and rules.UNITS["dBA"] == "dBA"


def test_taxonomy_is_complete_and_may_be_reordered(spark):
    assert sum(len(r.keywords) for r in rules.TAXONOMY) == 364
    assert sum(map(len, deciding_keywords([r.keywords for r in rules.TAXONOMY]))) == 291
    texts = [k for r in rules.TAXONOMY for k in r.keywords] + ["nothing", "hunter fan with led lamp", "impact driver bit 5pk"]
    for table in (rules.TAXONOMY, rules.TAXONOMY[::-1]):
        got = classify(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), F.lit(""), F.lit(""), table)
        for r in got.select("t", "product_name").collect():
            want = next((x.product_name for x in table if any(k in r["t"] for k in x.keywords)), rules.FALLBACK_RULE.product_name)
            assert r["product_name"] == want, r


def test_feed_files_of_several_layouts(spark, tmp_path):
    names = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf"]
    feed = tmp_path / "my feed"
    feed.mkdir()
    (feed / "a.csv").write_text("\n" + ",".join(names) + ',Dept\nA0,"two\nlines, ""x""",,,,M,D1\n')
    (feed / "b.csv").write_text(",".join(n.upper() for n in reversed(names)) + "\n" + "".join(f"M,,,,desc {i} loooong,B{i}\n" for i in range(50)))
    (feed / "c.csv").write_text("")
    rows = fd.with_row_ids(fd.read_feed(spark, str(feed), positions=True)).orderBy("row_id").collect()
    assert [(r["row_id"], r["Mfg_Part_Num"]) for r in rows] == [(1, "A0")] + [(i + 2, f"B{i}") for i in range(50)]
    assert rows[0]["Part_Desc"] == 'two\nlines, "x"' and rows[0]["Dept"] == "D1" and rows[9]["Part_Desc"] == "desc 8 loooong" and rows[9]["Dept"] == ""
    assert {x.broken for x in fd.layouts(spark, str(feed))} == {True, False}
    for head, message in ((names[:-1], "missing columns: Part_Manuf.*d.csv"), ([*names, "PART_DESC"], "duplicate columns: part_desc.*d.csv")):
        (feed / "d.csv").write_text(",".join(head) + "\n")
        with pytest.raises(fd.FeedError, match=message):
            fd.read_feed(spark, str(feed))


def test_export_status_tells_what_is_wrong(results):
    good = delivery.export_status(results).first()
    assert good["valid"] and good["errors"] == [] and good["delivery_columns"] == 252

    def broken(rows, keep):
        out = delivery.to_delivery(rows, keep)
        return out.withColumn("Warranty", F.lit(None).cast("string")).drop("MFR URL")

    bad = delivery.export_status(results, broken).first()
    assert not bad["valid"] and bad["errors"] == ["expected 252 columns, got 251", "missing columns: ['MFR URL']", f"{bad['row_count']} NULL cells"]


def test_decisions_of_one_moment_and_unknown_actions(spark):
    rows = spark.range(1, 4).select(F.col("id").alias("row_id"), F.struct(F.lit(True).alias("needs_review")).alias("review"))
    at = "timestamp'2024-01-01 00:00:00'"
    made = spark.sql(f"select * from values (1L, 'approve', 'a', {at}), (1L, 'reject', 'b', {at}), (2L, 'delete', 'c', {at}) as t(row_id, action, comment, at)")
    got = {r["row_id"]: r for r in serve.apply_decisions(rows, made).collect()}
    assert got[1]["decision"]["action"] == "reject" and not got[1]["review"]["needs_review"]
    assert got[2]["decision"] is None and got[2]["review"]["needs_review"]


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        tables.shared_folder(Cluster)


def test_entry_imports_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(tables.__file__)))
    shutil.copytree(root, tmp_path / "skuforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(os.path.dirname(root), "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'enrich' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
