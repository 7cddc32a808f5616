"""The corpus pipeline: quality, near duplicates, contamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

Nothing here trusts that a doc_id names one row: a decision holds for the rows that have
both its doc_id and its text. Every stage gives an empty table for an empty one, passes
other columns by whatever name, and treats texts whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.llm import decontaminate, mixing, near_dedup, pii, quality
from worksight.llm.common import durable, table, unused
from worksight.llm.queries import fold


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of these documents, doesn't reject.

    Null and empty texts get the score of an empty one, repeated rows each their own. Columns
    of docs named score or predicted come back unchanged.
    """
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    names = [f"in{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    kept = quality.with_quality(docs.toDF(*names), model).where("predicted = 1")
    return kept.select(*names).toDF(*docs.columns)


def mark() -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.xxhash64("text")


def chosen(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id and text are (left_semi) or aren't (left_anti) among keys (doc_id, mark)."""
    found = keys.select(F.col("doc_id").alias("key__"), F.col("mark").alias("mark__")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("key__")) & (mark() == F.col("mark__")), how)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id.

    Of rows with that doc_id and equal texts one stays, any where other columns differ.
    Documents without words, or without a doc_id, are in no group and stay.
    """
    found = durable(near_dedup.near_duplicates(docs.select("doc_id", "text", mark().alias("mark")), tag="mark"))
    kept = found.where("kept and group is not null").groupBy("group", "doc_id", "mark").agg(F.count("*").alias("rows"))
    # Where a group's smallest doc_id has several texts, one of them stays.
    first = kept.groupBy("group").agg(F.min("mark").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    others = kept.join(first, "group").where("mark <> first").select("doc_id", "mark")
    left = chosen(docs, found.where("not kept").select("doc_id", "mark").unionByName(others), "left_anti")
    again = durable(kept.where("rows > 1").select("doc_id", "mark"))
    if again.isEmpty():
        return left
    name = unused(docs, "mark")
    return chosen(left, again, "left_anti").unionByName(chosen(left, again, "left_semi").withColumn(name, mark()).dropDuplicates(["doc_id", name]).drop(name))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold too much of the benchmark; null and empty texts stay."""
    found = decontaminate.contamination(docs.select("doc_id", "text", mark().alias("mark")), table(spark, sf_dir, "benchmark"), tag="mark")
    return chosen(docs, found.where("contaminated"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars set anew.

    Null texts stay null. Rows stand for themselves, repeated ones too.
    """
    columns = [F.col("redacted__").alias("text") if c == "text" else F.length("redacted__").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return pii.with_personal_data(docs, redact=True).select(*columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row per copy of a document that its source's rate asks for.

    copy counts from 1; words is how many words of the text the copy has, all of them but
    in the one partial copy of a bucket, whose text ends after these words.
    """
    carried = {f"in__{c}": F.col(c) for c in docs.columns}
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source", *[v.alias(k) for k, v in carried.items()]), keep=tuple(carried)).where("taken > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    copies = copies.withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    pieces = F.regexp_extract_all("in__text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")).otherwise(F.col("in__text"))
    own = [text.alias("text") if c == "text" else F.col(f"in__{c}").alias(c) for c in docs.columns]
    return copies.select(*own, *[F.col(c) for c in ("copy", "words", "taken", "target") if c not in docs.columns])


STAGES = [("quality classifier", quality_classifier), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_decontamination), ("PII", personal_data), ("mixing sources to target weights", source_mix)]

#: Fitted models, components and redaction have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reread(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def reread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written as Parquet to the checkpoint folder that the executors share, and read again."""
    durable(spark.range(0))  # sets a folder where none is set
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
