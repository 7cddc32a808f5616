"""Texts go to Python in small batches."""

from worksight.operators import pairs


def test_texts_are_normalized_outside_of_arrow_batches(spark):
    df = spark.createDataFrame([(1, "Stra\u00dfe  \uff21-1!"), (2, None), (3, "")], "id long, t string")
    out = pairs.normalize_texts(df, "t", "n")
    assert [r.n for r in out.orderBy("id").collect()] == ["strasse a 1", None, ""]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" in plan
