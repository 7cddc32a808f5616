"""Slices of the neighbour index are few and small in bytes but long in work, so each has a task of its own."""

import numpy as np

from tests.test_index_shuffles import next_stage, stages
from worksight.operators import neighbours, pairs
from worksight.plans import register


def test_slices_get_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST", 64)
    x = np.random.default_rng(3).normal(size=(1500, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "work_id long, v array<double>").repartition(4).cache()
    df.count()
    first = next_stage(spark)
    got = {(r.a, r.b): r.cosine for r in register.near_pairs(df, 3).collect()}
    # 24 slices; the session has 4 partitions.
    assert max(s.numTasks() for s in stages(spark) if s.stageId() >= first) >= 24
    rows = neighbours.neighbours(df.select(df.work_id.alias("id"), "v"), 3)
    assert got == {(r.a, r.b): r.cosine for r in pairs.canonical_pairs(rows).collect()} and rows.count() == 4500
