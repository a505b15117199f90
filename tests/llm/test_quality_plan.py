"""The verdict of op1 is worked out once for each row, and the ratios are not copied into rows."""

from skuforge.llm import quality


def test_a_filter_on_the_verdict_does_not_repeat_the_figures(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.judged(docs, labels).where("quality.kept").drop("quality")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[#*$%&|<>]") == 1
    # a column of its own would be some megabytes in every row
    assert plan.count("scalar-subquery") == 1 and "AS _ratios" not in plan
    assert kept.collect() == []
