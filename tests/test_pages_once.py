"""The texts of pages are made once, however many steps of their chunks read them."""

from pyspark.sql import functions as F

from worksight.operators import passages


def test_a_page_is_read_once_for_its_chunks(spark):
    made = spark.sparkContext.accumulator(0)

    def told(n):
        made.add(1)
        return f"# Part {n // 3}\n\n1.{n % 4} some words\nof page {n}"

    pages = spark.range(40).select(F.concat(F.lit("d"), (F.col("id") % 2).cast("string")).alias("doc"), F.col("id").alias("page"), F.udf(told)("id").alias("text"))
    rows = passages.chunks(pages).collect()
    assert len(rows) == 40 and all(r.chapter == f"Part {r.page // 3}" for r in rows)
    assert made.value == 40
