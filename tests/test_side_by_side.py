"""Evidence that doesn't build on each other is made side by side."""

import threading
from types import SimpleNamespace

from worksight.plans import catalog


def test_models_run_side_by_side(spark, monkeypatch):
    barrier = threading.Barrier(3)

    def meets(rows, schema):
        df = spark.createDataFrame(rows, schema)
        return lambda *_: barrier.wait(60) is not None and df

    monkeypatch.setattr(catalog.models, "isolation_forest", meets([(1, "EXECUTION", 0.5), (2, "EXECUTION", 0.7)], "work_id long, lifecycle string, anomaly_score double"))
    monkeypatch.setattr(catalog, "overrun_warning", meets([(1, 0.2, "S"), (2, 0.1, "S")], "work_id long, probability double, status string"))
    monkeypatch.setattr(catalog.register, "summary", meets([(1, 1, 95.0), (2, 0, None)], "id long, reviews long, best_review_score double"))
    profile = spark.range(1, 3).withColumnRenamed("id", "work_id")
    e = catalog.modelled(SimpleNamespace(profile=profile, assets=None, spark=spark, sf_dir=""))
    assert {r.work_id: r.odd for r in e.odd.collect()} == {1: 0.0, 2: 100.0}
    assert {r.work_id: r.duplicate_score for r in e.duplicates.collect()} == {1: 95.0, 2: 0.0}
    assert {r.work_id: r.serving_percentile for r in e.warned.collect()} == {1: 100.0, 2: 0.0}
