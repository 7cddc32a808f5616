"""Deterministic synthetic lifecycle tables of any size, made on the executors from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTORS = ("Roads", "Water", "Education", "Health", "Sanitation", "Energy")


def draw(seed: int, tag: str, n: int, *columns: str) -> Column:
    """A pseudo-random integer below n that depends on seed, tag and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *columns), F.lit(n))


def synth_works(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    d = lambda tag, k: draw(seed, tag, k, "id")
    base = spark.range(n).withColumns({"state": F.format_string("STATE-%02d", d("state", 8)), "district": F.format_string("D-%02d", d("district", 40)), "sector": F.get(F.array(*[F.lit(s) for s in SECTORS]), d("sector", len(SECTORS)).cast("int"))})
    start = F.date_add(F.lit("2024-01-01").cast("date"), d("start", 700).cast("int"))
    return base.select(F.format_string("W-%08d", "id").alias("work_id"), "state", "district", "sector", start.alias("recommended_on"), F.date_add(start, (15 + d("sanction", 45)).cast("int")).alias("sanctioned_on"), F.date_add(start, (120 + d("plan", 300)).cast("int")).alias("expected_on"), (F.lit(250_000) + d("amount", 5_000_000)).alias("sanctioned"), (d("done", 100) < 40).alias("completed"))


def synth_payments(works: DataFrame, seed: int = 42) -> DataFrame:
    """One to six released payments per work, monthly from the sanction on."""
    n = (1 + draw(seed, "payments", 6, "work_id")).cast("int")
    rows = works.select("work_id", "sanctioned", "sanctioned_on", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("stage"))
    return rows.select("work_id", F.concat_ws("-", "work_id", "stage").alias("payment_id"), F.add_months("sanctioned_on", F.col("stage")).alias("released_on"), (F.col("sanctioned") / F.col("n")).cast("bigint").alias("amount"), F.col("stage").cast("int").alias("stage"), (F.col("stage") == F.col("n")).alias("is_final"))


def synth_progress(works: DataFrame, seed: int = 42, months: int = 12) -> DataFrame:
    """A report a month; physical progress never falls."""
    rows = works.select("work_id", "sanctioned_on", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("m"))
    step = 100 * F.col("m") / months
    return rows.select("work_id", F.concat_ws("-", "work_id", "m").alias("progress_id"), F.add_months("sanctioned_on", F.col("m")).alias("report_date"), step.alias("physical"), F.least(F.lit(100.0), step + draw(seed, "gap", 30, "work_id")).alias("financial"))
