"""Described works, their text vectors, and the pairs that these give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.operators import neighbours, pairs, vectors
from worksight.sources import domain


def search_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, vectors.Weighed]:
    return vectors.search_vectors(domain.register(spark, d))


def description_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, vectors.Weighed]:
    return vectors.search_vectors(domain.register(spark, d), {"description": "work"})


def near_pairs(found: DataFrame, k: int, unpack: neighbours.Unpack | None = None, exact: bool = False) -> DataFrame:
    """Pairs (a, b, cosine) of works among each other's k nearest by vectors (work_id, v), packed where `unpack` reads them."""
    return pairs.canonical_pairs(neighbours.directed(found.select(F.col("work_id").alias("id"), "v"), k, unpack=unpack, exact=exact))


def text_pairs(found: tuple[DataFrame, vectors.Weighed], k: int, exact: bool = False) -> DataFrame:
    return near_pairs(found[0], k, found[1], exact)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of works near in text, with evidence, score and the review policy's failed checks."""
    rows = pairs.scored_pairs(text_pairs(search_vectors(spark, d), 10), domain.register(spark, d).drop("description"))
    return rows.withColumn("reasons", pairs.review_reasons())


def summary(spark: SparkSession, d: str) -> DataFrame:
    """The pair summary of all described works; pairs without a failed check are review candidates."""
    rows = scored(spark, d).select("a", "b", "score", (F.size("reasons") == 0).alias("review"))
    ids = domain.register(spark, d).where("work_id is not null").select(F.col("work_id").alias("id")).distinct()
    return pairs.pair_summary(ids, rows, "score", "review")
