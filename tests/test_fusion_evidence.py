"""The evidence that fusion joins: similar-record pairs, anomalies and the guarded model."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from worksight.operators import fusion, models
from worksight.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables, but works 0 and 1 are described by one text."""
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    folder = tmp_path_factory.mktemp("tables")
    for f in Path(FOLDER).iterdir():
        if f.stem != "documents":
            os.symlink(f, folder / f.name)
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    df.where("doc_id <> 1").unionByName(df.where("doc_id = 0").withColumn("doc_id", F.lit(1).cast("long"))).write.parquet(f"{folder}/documents.parquet")
    return catalog.Tables(spark, str(folder))


def test_a_record_written_twice_is_a_review_candidate(spark, tables):
    got = {r.work_id: r for r in fusion.duplicate_family(catalog.register.summary(tables.spark, tables.sf_dir)).collect()}
    assert {got[i].duplicate_code for i in (0, 1)} == {"DUPLICATE_REVIEW_CANDIDATE"} and got[0].duplicate_score >= 90
    assert len(got) == 200 and sum(r.duplicate_score == 0 for r in got.values()) > 100


def test_wide_signals_hold_evidence(spark, tables):
    wide, *rest = catalog.wide_signals(tables)
    got = {r.work_id: r for r in wide.collect()}
    assert got[0].DUPLICATE_REVIEW_code == "DUPLICATE_REVIEW_CANDIDATE" and got[0].DUPLICATE_REVIEW_available
    assert not any(r.DUPLICATE_REVIEW_available for i, r in got.items() if i >= 200)
    alerts = fusion.review_alerts(wide, *rest).where("alert_type = 'DUPLICATE_REVIEW_CANDIDATE'")
    assert {r.work_id for r in alerts.collect()} >= {0, 1}
    assert all(r.COST_OVERRUN_PREDICTION_available == (r.COST_OVERRUN_PREDICTION_code not in ("UNAVAILABLE", "NOT_APPLICABLE_STAGE")) for r in got.values())
    odd = {r.work_id: r.anomaly_percentile for r in catalog.stats.percentile_exclusive(models.isolation_forest(tables.profile, catalog.METRICS), ["lifecycle"], "anomaly_score", "anomaly_percentile").collect()}
    assert all(r.ANOMALY_score == pytest.approx(odd[i], abs=1e-5) for i, r in got.items())


def test_probabilities_are_guarded(spark):
    r = random.Random(5)
    rows = [(i, x := r.random(), int(x + r.gauss(0, 0.1) > 0.5), r.randint(0, 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "work_id long, x double, told int, noise int")
    serving = spark.createDataFrame([(1, 0.05), (2, 0.95)], "work_id long, x double")
    warned = lambda label, few=df: {w.work_id: w for w in models.guarded_probability(models.split(few, label), serving, ["x"], label).collect()}
    told = warned("told")
    assert told[1].probability < 0.2 < 0.8 < told[2].probability
    assert (told[1].status, told[2].status) == ("NO_EARLY_WARNING", "HIGH_EARLY_WARNING")
    for unfit in (warned("noise"), warned("told", df.where("work_id < 60"))):
        assert {(w.probability, w.status) for w in unfit.values()} == {(None, "UNAVAILABLE")}
