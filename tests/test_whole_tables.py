"""Queries take every row of their tables."""

from pathlib import Path

import numpy as np
import pytest

from worksight.operators import checks, serving
from worksight.plans import catalog

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@needs_tables
def test_every_twentieth_vector_is_a_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in rows}
    got = {}
    for r in catalog.queries()["retrieve_topk"](spark, FOLDER).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    assert set(got) == {i for i in v if i % 20 == 0}
    for q, found in got.items():
        score = {c: np.floor(v[q] @ v[c] * 1e5 + 0.5) / 1e5 for c in v if c != q}
        assert found == pytest.approx({c: score[c] for c in sorted(score, key=lambda c: (-score[c], c))[:5]}, abs=1e-4)


def test_queries_and_chunks_meet_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)]) for i in range(30)] + [(30, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(serving, "BLOCK", 4)
    got = {}
    for r in serving.cosine_topk(df.where("id % 5 = 0"), df, 3).collect():
        got.setdefault(r.query_id, set()).add((r.place, r.chunk_id, r.score))
    assert got == {q: {(n + 1, c, 1.0) for n, c in enumerate([c for c in range(q % 3, 30, 3) if c != q][:3])} for q in range(0, 30, 5)}


@needs_tables
def test_every_event_is_folded_and_all_transitions_can_occur(spark):
    got = catalog.queries()["workflow_fold"](spark, FOLDER).collect()
    assert sum(r.events for r in got) == spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert {r.state for r in got} & {"IN_PROGRESS", "COMPLETED"}
    assert {e for _, e in serving.TRANSITIONS} == {e for steps in catalog.STEPS.values() for e in steps}


@needs_tables
def test_no_document_is_hidden(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    labels = [r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id").collect()]
    orphans = catalog.queries()["dq_orphans"](spark, FOLDER).collect()
    assert sorted(r.record_id for r in orphans) == sorted(str(i) for i in labels if i not in docs)
    faults = catalog.queries()["grounding_check"](spark, FOLDER).collect()
    assert faults and "WORK_ID_MISMATCH" not in {r.fault for r in faults}


def test_invented_orphans(spark):
    labels = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "doc_id long, work_id long")
    docs = spark.createDataFrame([(1,), (3,)], "doc_id long")
    assert [r.record_id for r in checks.orphans(labels, "doc_id", docs, "doc_id", "ORPHAN_FOREIGN_KEY", "labels", "doc_id").collect()] == ["2"]
