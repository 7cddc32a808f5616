"""Decisions of the pipeline's stages where doc_ids repeat, are null, or columns clash."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

TEXT = " ".join(f"w{i}" for i in range(60))
ITEM = " ".join(f"bench{i}" for i in range(20))
OTHER = " ".join(f"v{i}" for i in range(40))
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], FIELDS).withColumns({"score": F.lit("a"), "predicted": F.lit("b"), "mark": F.lit("c"), "kept": F.lit("d"), "in0": F.lit("e"), "found": F.lit("f")})


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_copies_under_one_id(spark, folder):
    rows = [(1, TEXT), (1, TEXT), (2, TEXT), (2, OTHER), (3, OTHER + " more"), (None, TEXT), (5, None), (5, None), (6, "")]
    docs = table(spark, rows)
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns
    assert rows_of(got) == sorted([(1, TEXT), (2, OTHER), (None, TEXT), (5, None), (5, None), (6, "")], key=str)
    one_group = table(spark, [(1, TEXT), (1, TEXT + " tail"), (4, TEXT)])
    assert len(rows_of(corpus_pipeline.near_duplicates(spark, one_group, folder))) == 1


def test_contamination_under_one_id_and_without(spark, folder):
    docs = table(spark, [(1, ITEM), (1, OTHER), (None, "x " + ITEM), (None, OTHER), (None, None)])
    assert rows_of(corpus_pipeline.benchmark_decontamination(spark, docs, folder)) == sorted([(1, OTHER), (None, OTHER), (None, None)], key=str)


def test_empty_tables_and_clashing_columns(spark, folder):
    docs = table(spark, [(1, TEXT), (2, "a@b.c " + OTHER)])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("false"), folder).count() == 0
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == docs.columns
            assert {(r.score, r.predicted, r.mark, r.kept, r.in0, r.found) for r in out.collect()} == {tuple("abcdef")}
