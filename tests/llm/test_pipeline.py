"""The pipeline against brute force, stage by stage, and the operators' queries on the smallest tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_searches import base_spans
from tests.llm.test_searches import brute as contamination
from worksight.llm import pii
from worksight.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    base = " ".join(f"w{i}" for i in range(60))
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [(i, f"plain words number {i} " + " ".join(f"v{i}x{j}" for j in range(30)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, base, "en", "s0", 1), (101, base, "en", "s1", 1), (102, base + " extra", "en", "s1", 1), (103, "before " + item + " after", "en", "s2", 1), (104, "mail jo.e@mail.example.com or call +1 (555) 555-0100 " + " ".join(f"q{i}" for i in range(40)), None, None, None), (105, None, "en", "s0", None), (106, "", "en", "s0", 0), (None, "no id at all here", "en", "s1", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("z")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r) for r in docs.collect()]
        docs = corpus_pipeline.reread(spark, stage(spark, docs, folder))
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if k < 4:
            assert docs.columns == columns, name
        if k == 0:
            assert len(after) == len(before)  # all labels say 1
        elif k == 1:
            keep = {d for d, _, c in components([(d, t) for d, t, _ in before if d is not None]) if d == c} | {None}
            assert set(ids) == keep and {101, 102}.isdisjoint(ids)
        elif k == 2:
            gone = {x[0] for x in contamination([(d, t) for d, t, _ in before], [(1, spark.read.parquet(f"{folder}/benchmark.parquet").first().text)]) if x[-1]}
            assert gone == {103} and set(ids) == {d for d, _, _ in before} - gone
        elif k == 3:
            want = {d: pii.redacted(t, pii.find(t)) if t else t for d, t, _ in before}
            assert {r.doc_id: r.text for r in after} == want
            assert not any(base_spans(r.text or "") for r in after)
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in after)
        else:
            sizes, source = {d: len((t or "").split()) for d, t, _ in before}, {d: r.source for d, _, r in before}
            words, target = {}, {}
            for r in after:
                assert r.words == len(r.text.split()) and r.words <= sizes[r.doc_id] and r.copy <= 2
                words[r.source] = words.get(r.source, 0) + r.words
                target[r.source] = r.target
            total = {s: sum(sizes[d] for d in sizes if source[d] == s) for s in set(source.values())}
            assert all(abs(words[s] - target[s]) <= 1 for s in target)
            assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))


def test_run_is_repeatable(spark, folder):
    one, two = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert one == two and len(one) > 40


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in df.collect()]
    table = "pages" if name.startswith("op4") else "conversations" if name.startswith("op6") else "documents"
    source = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    assert len(rows) == (source.select("conv_id").distinct().count() + 1 if table == "conversations" else source.count())
    if name in ORACLE_SQL:
        import duckdb

        connection = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "conversations"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        cursor = connection.execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        plain = lambda v: "" if v is None else str(v)
        assert sorted([plain(r[n]) for n in sorted(names)] for r in rows) == sorted([plain(v) for _, v in sorted(zip(names, x))] for x in cursor.fetchall())
